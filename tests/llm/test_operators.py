"""Each operator against a plain version over whole tables, with odd rows among them."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quantspark.llm import kneser_ney, log_bilinear, lsh, mixing, packing, pii, rules, simhash, substrings, token_store, tokens
from quantspark.llm.common import shared_path

WORD = re.compile("[^\x20\x09-\x0d]+")


def key(r):
    return tuple((x is None, x) for x in r)


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


# -- personal data ---------------------------------------------------------------------------------------------------------

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text, kind):
    for m in re.finditer(PLAIN[kind], text):
        d = re.sub("[^0-9]", "", m[0])
        if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
            continue
        if kind == "card" and not (13 <= len(d) <= 19 and sum((int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10))) for i, c in enumerate(reversed(d))) % 10 == 0):
            continue
        if kind == "phone" and not 9 <= len(d) <= 15:
            continue
        yield kind, m.start(), m.end()


def test_pii(docs, rows):
    found = pii.find_pii(docs)
    assert found.columns == [*docs.columns, "pii"]
    got = found.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), pii.listed(pii.KINDS[:4]).alias("b"), pii.listed(pii.KINDS).alias("all"), pii.redact(F.coalesce("text", F.lit("")), F.col("pii")).alias("r")).collect()
    want = [(d, t, ",".join(f"{k}:{a}:{b}" for kind in PLAIN for k, a, b in plain_spans(t, kind))) for d, t in rows]
    same([(r.doc_id, r.t, r.b) for r in got], want)
    secrets = 0
    for r in got:
        assert r["all"].startswith(r.b)
        spans = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in r["all"].split(",") if s))
        for a, b, k in spans:
            assert k == "secret" or r.t[a:b] not in r.r or b - a < 4
            secrets += k == "secret"
        planted = [m.span() for m in re.finditer(r"password=[0-9a-f]{18}|AKIA[A-Z0-9]{16}", r.t)]
        assert all(any(a <= x and y <= b for a, b, _ in spans) for x, y in planted)
        if not spans:
            assert r.r == r.t
    assert secrets


@pytest.mark.parametrize("text", ["a@b.com_x@y.org", "a@b.c@d.e", "..@x.y.", "1.2.3.4.5.6.7.8", "0001.2.3.4", "1 2-3 4", "+1 234 567 890-", "@", "+", "9" * 5000, "a@" + "b." * 4000 + "c"])
def test_pii_patterns(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    for kind in PLAIN:
        got = df.select(F.explode(pii.base_spans(F.col("text"), kind)).alias("s")).select("s.*").collect()
        assert [tuple(r) for r in got] == [(a, b) for _, a, b in plain_spans(text, kind)]


def test_pii_reliabilities():
    votes = {"agree": (2, 2, 2, 2), "against": (0, 1, 0, 0), "mixed": (2, 1, 2, 2)}
    code = {k: sum(v * 3**i for i, v in enumerate(x)) for k, x in votes.items()}
    p, reliability = pii.expectation_maximisation({code["agree"]: 50, code["against"]: 400, code["mixed"]: 60})
    assert p[code["agree"]] > 0.99 and p[code["mixed"]] > 0.9 and p[code["against"]] < 0.01
    assert all(math.isclose(sum(x), 1) for both in reliability for x in both) and reliability[0][0][2] > 0.9 and reliability[0][1][0] > 0.9


def plain_candidates(text):
    """(start, end, votes, features) of each candidate, span by span."""
    low = r"(?i)(?:^|[^a-z])(?:" + "|".join(pii.NAMES_OF_SECRETS) + ")(?:[^a-z]|$)"
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
        v, before = m[0], text[max(0, m.start() - 32) : m.start()]
        if len(v) < 9 or not re.search("[0-9]", v):
            continue
        n, turns = len(v), len(re.findall("[A-Za-z][0-9]|[0-9][A-Za-z]", v))
        known, digits, letters = bool(re.search(pii.KNOWN, v)), len(re.findall("[0-9]", v)), len(re.findall("[A-Za-z]", v))
        votes = [
            1 if known else -1 if not turns else 0,
            1 if re.search(low, before + " " + v) else 0,
            1 if re.search("[A-Za-z_]=[A-Za-z0-9+/_-]{8,}$", before + v) or re.search(pii.ASSIGNED, before) else -1 if re.search(pii.PROSE, before) else 0,
            1 if turns >= 3 and digits >= 3 and letters >= 3 and n >= 12 else -1 if turns <= 1 and not known else 0,
        ]
        features = (
            sum(n >= k for k in (12, 16, 24, 48)), 5 + min(turns // 2, 3), 9 if "=" in v else 10 if before[-1:] in ("'", '"') else 11 if before[-1:] == " " else 12,
            13 if re.fullmatch("[A-Z0-9]+", v) else 14 if re.fullmatch("[0-9+/=-]+", v) else 15 if re.fullmatch("[a-z0-9=_-]+", v) else 16,
        )
        yield m.start(), m.end(), sum((x + 1) * 3**i for i, x in enumerate(votes)), features


def test_pii_classifier(spark, docs, rows):
    """Candidates, counts, the fitted model and the added spans, one by one in plain Python."""
    extra = [(900_001, "x" * 300 + "1a2b3c and token = " + "A" * 250 + "9f8e7d6c end"), (900_002, "id=12345678 " * 400), (900_003, "")]
    more = docs.select("doc_id", "text").unionAll(spark.createDataFrame(extra, "doc_id long, text string"))
    texts = [*rows, *extra]
    counts = Counter((c[2], c[3]) for _, t in texts for c in plain_candidates(t))
    model = pii.train(more)
    assert model == pii.fit(dict(counts)) and sum(counts.values()) > 400
    want = []
    for d, t in texts:
        base = [(a, b) for kind in PLAIN for _, a, b in plain_spans(t, kind)]
        own = [(a, b) for a, b, _, f in plain_candidates(t) if model.prior + sum(model.weights[k] for k in f) > math.log(pii.ACCEPT / (1 - pii.ACCEPT)) and all(b <= x or y <= a for x, y in base)]
        want.append((d, t, ",".join(f"secret:{a}:{b}" for a, b in own)))
    got = pii.find_pii(more, model).select("doc_id", F.coalesce("text", F.lit("")), pii.listed(("secret",)))
    same(got.collect(), want)


def test_pii_columns(spark, sf):
    assert pii.op2_pii(spark, sf).columns[:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]


# -- mixing ----------------------------------------------------------------------------------------------------------------


def test_mixing(docs, rows):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for r in docs.collect():
        size[r.source] += len(WORD.findall(r.text or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(size.values())
    while True:  # reshare until none is above
        level = left / sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * level > 2 * size[s]}
        if not above:
            break
        for s in above:
            target[s] = 2.0 * size[s]
            left -= target[s]
        free -= above
    target |= {s: weight[s] * level for s in free}
    by = defaultdict(int)
    of = {(r.doc_id, r.text): r.source for r in docs.collect()}
    assert of
    sources = docs.select("doc_id", "source").distinct().collect()
    source = {r.doc_id: r.source for r in sources if r.doc_id is not None}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        if r.doc_id is not None:
            s = source[r.doc_id]
            assert r.source_size == size[s] and math.isclose(r.target, target[s], rel_tol=1e-9, abs_tol=1e-9)
            by[s] += r.taken
    for s in order:
        if s != "a" and s is not None:  # a holds rows without doc_id
            assert abs(by[s] - target[s]) <= 1
    same(mixing.mix_sources(docs.repartition(5)).collect(), map(tuple, got))


def test_mixing_prefers_quality(spark):
    text = "word " * 20
    rows = [(i, text + ("#" * 90 if i % 2 else ""), s) for i in range(2000) for s in ("a",)] + [(5000 + i, text, "b") for i in range(4000)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 3), share=0.5).where("doc_id < 5000").collect()
    clean = sum(r.taken for r in got if r.doc_id % 2 == 0)
    assert clean > 1.5 * sum(r.taken for r in got if r.doc_id % 2)


def test_mixing_slices_are_even(spark):
    """Keys of every quality weight spread evenly over a source's slices."""
    text = F.concat(F.lit("word "), F.repeat(F.lit("#"), (F.col("id") % 40).cast("int")))
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("a").alias("source"))
    w = mixing.quality_weight(F.col("text"))
    rows = docs.select(F.col("source").alias("s"), w.alias("w"), (-F.log(mixing.uniform(F.col("doc_id"), F.col("text"))) / w).alias("k"))
    x = rows.join(mixing._bands(rows), "s").withColumn("slice", F.floor(mixing._below(F.col("k"), F.col("bands")) * 100)).groupBy("slice").count()
    assert x.count() >= 99 and x.agg(F.max("count")).first()[0] < 1.5 * 600
    assert rows.withColumn("slice", F.floor((1 - F.exp(-F.col("k"))) * 100)).groupBy("slice").count().agg(F.max("count")).first()[0] > 4 * 600


# -- SimHash ---------------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    n, ones = len(shingles), [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > n)


def components(n, links):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash(docs, rows):
    got = simhash.simhash_components(docs.select("doc_id", "text")).collect()
    known = sorted((d, t) for d, t in rows if d is not None)
    fp = [plain_fingerprint(t) for _, t in known]
    links = [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 4]
    root = components(len(fp), links)
    want = [(d, f - (1 << 64) if f >> 63 else f, known[r][0]) for (d, _), f, r in zip(known, fp, root, strict=True)]
    same([tuple(r) for r in got if r.doc_id is not None], want)
    assert len(got) == len(rows)


def test_bit_slices():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fp = np.concatenate([base, base ^ np.uint64(0b1011), base ^ np.uint64(1 << 63), rng.integers(0, 1 << 63, 300, dtype=np.uint64), np.repeat(base[:1], 200) ^ (np.uint64(1) << rng.integers(0, 60, 200).astype(np.uint64))])
    group = np.sort(rng.integers(0, 4, len(fp)))
    for radius in (0, 3, 4, 7):
        i, j = simhash.bit_sliced_links(fp, group, radius, most=97)
        want = {(a, b) for b in range(len(fp)) for a in range(b) if group[a] == group[b] and int(fp[a] ^ fp[b]).bit_count() <= radius}
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_simhash_split_blocks(spark):
    rng = np.random.default_rng(2)
    fp = np.unique(np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 60, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 60, 400).astype(np.uint64)))
    df = spark.createDataFrame([(int(f), i) for i, f in enumerate(fp.tolist())], "fp long, node long")
    from quantspark.llm.components import connected_components

    links = [(i, j) for i in range(len(fp)) for j in range(i) if int(fp[i] ^ fp[j]).bit_count() <= 4]
    for n in (400, 10**8, 10**11):  # one, two and three agreeing blocks as keys
        found = {r.node: r.component for r in connected_components(simhash.simhash_edges(df, simhash.pigeonhole_masks(4, n), chunk=16)).collect()}
        assert [found.get(i, i) for i in range(len(fp))] == components(len(fp), links)


def test_simhash_repeated_ids(spark):
    """Texts of one doc_id are compared each for itself."""
    a, b, c = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    df = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b), (4, c), (None, c), (None, a + b)], "doc_id long, text string")
    for found in (simhash.simhash_components(df), simhash.near_copies(df)):
        same(found.select("doc_id", "component_id").collect(), [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (None, 4), (None, None)])
    df = spark.createDataFrame([(5, a), (5, b), (2, a), (3, b)], "doc_id long, text string")
    same(simhash.simhash_components(df).select("doc_id", "component_id").collect(), [(5, 2), (5, 3), (2, 2), (3, 3)])


# -- rules -----------------------------------------------------------------------------------------------------------------


def test_rules(docs, rows):
    got = rules.apply_policy(rules.rule_ledger(docs.select("doc_id", "text"))).collect()
    want = []
    for d, t in rows:
        w = WORD.findall(t)
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        places = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(places)))
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got], want)
    for r in got:
        bad = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert bool(r.failed & rules.BASE) == bad and (not bad or not r.kept)


def test_rules_keep_clean_documents(spark, sf):
    ledger = rules.apply_policy(rules.rule_ledger(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")))
    x = ledger.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("n_words >= 50").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("k")).collect()
    k = {r.quality: r.k for r in x}
    assert k[1] > 0.97 and k.get(0, 0) < 0.3


def test_ablations(docs):
    ledger = rules.rule_ledger(docs.select("doc_id", "text")).cache()
    failed = [r.failed for r in ledger.collect()]
    for r in rules.ablations(ledger).collect():
        bit, mask = rules.BITS[r.rule], rules.POLICIES[r.version]
        assert r.n_failed == sum(bool(f & bit) for f in failed) and r.n_only == sum(f & mask == bit for f in failed)


# -- embeddings ------------------------------------------------------------------------------------------------------------


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(30, 16))
    rows = [(i, (centre[i % 30] + rng.normal(size=16) * 0.08).tolist(), i % 3) for i in range(400)]
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(3)] + [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] + [1.0] * 15, 1), (2003, [None] + [1.0] * 15, 1), (2004, rows[5][1], None), (2005, [1.0, 2.0], 1), (2006, [float("inf")] * 16, 1), (2007, [], 1), (None, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in lsh.embedding_components(df).collect()}
    assert len(got) == len(rows)
    x = np.array([np.array(r[1], np.float32) for r in rows[:403]], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = (x @ x.T >= 0.93) & (np.array([r[2] for r in rows[:403]])[:, None] == np.array([r[2] for r in rows[:403]]))
    np.fill_diagonal(near, False)
    ids = [r[0] for r in rows[:403]]
    want, found = near.sum(axis=1), np.array([got[i].n_links for i in ids])
    assert (found <= want).all() and found.sum() >= 0.97 * want.sum() and want.sum() > 1000
    root = components(403, [(i, j) for i, j in zip(*np.nonzero(near), strict=True)])
    assert np.mean([got[i].component_id == ids[r] for i, r in zip(ids, root, strict=True)]) > 0.97
    for i in (*range(2000, 2008), None):
        assert got[i].n_links == 0 and got[i].component_id == i and got[i].kept


def test_embedding_planes_follow_the_rows(spark):
    assert lsh.tables_for(1000) == (18, 12) and lsh.tables_for(200_000) == (18, 12) and lsh.tables_for(10**12)[1] == 24
    for n in (10**6, 10**8):
        tables, planes = lsh.tables_for(n)
        same = 1 - math.acos(0.93) / math.pi
        assert n / 2**planes <= 64 and 1 - (1 - same**planes) ** tables >= 1 - (1 - same**12) ** 18
    rng = np.random.default_rng(9)
    centre = rng.normal(size=(200, 12))
    rows = [(i, (centre[i % 200] + rng.normal(size=12) * 0.05).tolist(), 1) for i in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    few = lsh.embedding_components(df, tables=lsh.tables_for(10**7)[0], planes=lsh.tables_for(10**7)[1]).agg(F.sum("n_links")).first()[0]
    assert few >= 0.97 * lsh.embedding_components(df).agg(F.sum("n_links")).first()[0] > 0


def test_embedding_chunks(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (np.ones(8) + rng.normal(size=8) * 0.01).tolist(), 1) for i in range(300)]
    df = spark.createDataFrame([(str(1), r[0], 1, r[1]) for r in rows], "label string, node long, n long, embedding array<double>")
    links = lsh.embedding_links(df, chunk=40).groupBy("node").agg(F.sum("links").alias("n")).collect()
    assert {r.n for r in links} == {299}


def test_embeddings_repeated_ids(spark):
    """Two different vectors of one vec_id do not join what each of them is near."""
    a, b = np.eye(8)[0], np.eye(8)[1]
    rows = [(1, a.tolist(), 1), (1, b.tolist(), 1), (2, (a + 0.05 * b).tolist(), 1), (3, (b + 0.05 * a).tolist(), 1)]
    got = lsh.embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    same(got.select("vec_id", "n_links", "component_id", "kept").collect(), [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)])


# -- token files and packing -----------------------------------------------------------------------------------------------


@cache
def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path(name))


def plain_ids(name, text):
    return [*tokenizer(name).encode(text, add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_pieces_give_the_library_s_ids():
    """Every letter that pieces are made of, and random texts of letters, stops, spaces and rarer characters."""
    rng = np.random.default_rng(8)
    alphabet = [*"abcXYZ  .,!?\n\t-'0", *"äÉßøİıŞĞœǆǅŉĳſÿ", "İ", "i\u0307", "\u00a0", "\u3000", "é", "Σς", "日", "<|", "\u200b"]
    letters = [chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250))]
    texts = [f"{c} a{c}b {c}{c}, x{c}" for c in letters] + ["".join(rng.choice(alphabet, rng.integers(1, 40))) for _ in range(6000)] + ["İstanbul güzel", "İzmir ve İstanbul.", "ŞİMDİ gel"]
    for name, byte_level in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        encoder = tokens.TokenIds(tokens.tokenizer_path(name), byte_level)
        for t in texts:
            assert np.frombuffer(encoder.encode(t), "<u4").tolist() == plain_ids(name, t)[:-1], (name, t)


def test_token_ranges_split_one_id(spark):
    """Rows of one doc_id, or of none, are dealt to all tasks."""
    df = spark.createDataFrame([(None if i % 2 else 7, f"text {i % 5}") for i in range(4000)], "doc_id long, text string").repartition(4)
    path = token_store.write_tokens(df, shared_path(spark, "t"))
    sizes = [r.n for r in spark.read.parquet(path).groupBy("part").agg(F.sum("n_ids").alias("n")).collect()]
    assert len(sizes) >= 4 and max(sizes) < 0.5 * sum(sizes)
    got = sorted(token_store.read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 2000 + [7] * 2000


def test_token_files(spark, docs, rows, monkeypatch):
    path = token_store.write_tokens(docs, shared_path(spark, "t"))
    got = token_store.read_tokens(spark, path).collect()
    ids = [(d, plain_ids("byte_bpe_50k.json", t)) for d, t in rows]
    same([(r[0], *r[2:]) for r in map(tuple, got)], [(d, len(x), crc(x)) for d, x in ids])
    at, last = 0, None
    for d, start, n, _ in sorted(map(tuple, got), key=lambda r: r[1]):
        assert start == at and (last is None or d is not None and d >= last)
        at, last = at + n, d


def test_elias_fano():
    rng = np.random.default_rng(5)
    for values in ([], [0], [0, 0, 0], [5], np.cumsum(rng.integers(0, 4000, 3000)), np.sort(rng.integers(0, 1 << 40, 2000)), np.arange(1000)):
        v = np.asarray(values, np.int64)
        e = token_store.EliasFano.load(token_store.EliasFano.encode(v).dump())
        assert [e.select(i) for i in range(len(v))] == v.tolist()
        if len(v) > 100:
            assert 8 * len(e.dump()) <= len(v) * (3 + math.log2(max(2, v[-1] / len(v)))) + 300


def test_token_block():
    ids = np.arange(70_000, dtype=np.int64) % 66_000
    b = token_store.Block(token_store.encode_block([None, -5, 3, 3, 9], [10, 0, 40_000, 0, 29_990], ids))
    assert [b.doc_id(i) for i in range(b.n)] == [None, -5, 3, 3, 9] and b.document(2).tolist() == ids[10:40_010].tolist() and len(b.document(1)) == 0


def test_packing(docs, rows):
    got = packing.pack_pieces(packing.token_pieces(docs), group=150).collect()
    want = []
    for d, t in rows:
        ids = plain_ids("word_bpe_49k.json", t)
        want += [(d, k, a, len(ids[a : a + 2048]), crc(ids[a : a + 2048])) for k, a in enumerate(range(0, len(ids), 2048))]
    same([tuple(r)[:5] for r in got], want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        end = 0
        for offset, length in sorted(items):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(bins) <= 1.02 * -(-sum(w[3] for w in want) // 2048) + len(got) / 150


def test_swaps_over_many_underfull_bins():
    """All pieces of middling length: the search goes through every giver, keeps all items and ends."""
    rng = np.random.default_rng(9)
    for sizes, slack in ((rng.integers(700, 1300, 2000), 1.05), (rng.integers(300, 900, 2000), 1.01), (rng.integers(1, 2048, 2000), 1.01)):
        first = packing.best_fit(sizes, 2048)
        bins = packing.SwapSearch(sizes, first, 2048).run()
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert max(int(sizes[b].sum()) for b in bins) <= 2048 and len(bins) <= len(first)
        pairs = sum(sizes > 1024)  # no two of these share a bin
        assert len(bins) <= slack * max(pairs, -(-int(sizes.sum()) // 2048)) + 2


def test_swaps_empty_bins():
    sizes = np.array([6, 6, 3, 3, 3, 3, 2, 2, 2, 4, 4, 4, 5, 5, 7])
    bins = packing.best_fit(sizes, 12)
    better = packing.SwapSearch(sizes, bins, 12).run()
    assert sorted(i for b in better for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[b]) <= 12 for b in better) and len(better) <= len(bins)
    a, b = packing.SwapSearch(np.array([7, 4, 5, 6]), [[0, 1], [2], [3]], 12).run(), -(-22 // 12)
    assert len(a) == b


# -- substrings ------------------------------------------------------------------------------------------------------------


def plain_removal(rows, n=50):
    least, data = {}, [(d, t.encode()) for d, t in rows]
    for d, t in data:
        if d is not None:
            for i in range(len(t) - n + 1):
                w = t[i : i + n]
                if least.get(w, d) >= d:
                    least[w] = d
    for d, t in data:
        gone = np.zeros(len(t) + 1, bool)
        if d is not None:
            for i in range(len(t) - n + 1):
                if least[t[i : i + n]] < d:
                    gone[i : i + n] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = np.frombuffer(t, np.uint8)[~gone[:-1]].tobytes()
        yield d, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()


def test_substrings(docs, rows):
    same(substrings.remove_repeated(docs).collect(), list(plain_removal(rows)))


def test_substrings_hard_cases(spark):
    rng = np.random.default_rng(6)
    p = bytes(rng.integers(97, 100, 400).astype(np.uint8)).decode()
    rows = [(i, p[: 200 + i] + "ab" * (i % 60) + p[i : 300 - i]) for i in range(80)] + [(3, p), (3, "q" + p), (200, "é" * 60), (201, "x" + "é" * 50), (202, "a" * 49), (203, "b" + "a" * 49), (None, p), (204, "ab" * 300), (205, "ba" * 400), (206, "\0" * 80), (207, "\0" * 60 + "z")]
    same(substrings.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect(), list(plain_removal(rows)))


def test_run_length_index():
    """Predecessors, match lengths and least labels against sorted suffixes."""
    rng = np.random.default_rng(10)
    for n in (1, 3, 40):
        strings = list(dict.fromkeys(bytes(rng.integers(0, 3, rng.integers(1, 60)).astype(np.uint8)) * rng.integers(1, 3) for _ in range(n)))
        labels = rng.integers(0, 20, len(strings))
        index = substrings.RunLengthIndex(strings)
        before, match = index.matches()
        assert len(index.heads) <= index.total
        suffixes = sorted((tuple(c + 1000 for c in s[i:]) + (k,), p, s[i:]) for k, (s, e) in enumerate(zip(strings, index.ends.tolist(), strict=True)) for i, p in enumerate(range(e - len(s), e + 1)))
        for (_, q, y), (_, p, x) in zip(suffixes, suffixes[1:], strict=False):
            want = next((i for i, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
            assert match[p] == want and (not x or before[p] == q)
        least = index.least_labels(labels, 5)
        for k, (s, e) in enumerate(zip(strings, index.ends.tolist(), strict=True)):
            for i in range(len(s) - 4):
                assert least[e - len(s) + i] == min(labels[j] for j, t in enumerate(strings) if s[i : i + 5] in t)


def test_substrings_common_passages(spark):
    """A passage in most documents, copies by the hundred, and more buckets than shuffle partitions."""
    rng = np.random.default_rng(11)
    passage = "".join(chr(97 + c) for c in rng.integers(0, 26, 160))
    rows = [(i, "".join(chr(97 + c) for c in rng.integers(0, 26, 90)) + (passage if i % 3 else passage[:120]) + str(i)) for i in range(400)] + [(1000 + i, passage) for i in range(200)] + [(5, f"{i} {passage[i % 7 :]}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for size in (substrings.GROUP_BYTES, 4096):
        keep, substrings.GROUP_BYTES = substrings.GROUP_BYTES, size
        try:
            same(substrings.remove_repeated(df).collect(), list(plain_removal(rows)))
        finally:
            substrings.GROUP_BYTES = keep


# -- language models -------------------------------------------------------------------------------------------------------


def test_quality(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = kneser_ney.classify(docs, labels)
    assert got.columns == [*docs.columns, "quality"]
    k = {r.quality: r.k for r in got.select("doc_id", F.col("quality.kept").alias("kept")).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("k")).collect()}
    assert k[1] > 0.97 and k[0] < 0.5


def test_quality_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 0), (None, 1, 0), (9, 0, None), (1, 1, 0)], "doc_id long, quality int, toxic int")
    got = kneser_ney.classify(odd, labels).select("doc_id", "quality.*").collect()
    assert len(got) == 17 and all(r.kept for r in got if r.doc_id in (1, 2, 3))
    assert all(r.kept and r.perplexity is None for r in kneser_ney.classify(odd, labels.limit(0)).select("quality.*").collect())


def plain_kneser_ney(texts):
    """Chance of a class after its context, as the formulas say."""
    grams = Counter(g for t in texts for s in [kneser_ney.symbols(t, False).tolist()] for g in zip(s, s[1:], s[2:], s[3:], strict=False))
    counts = {4: grams}
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discount = {}
    for n, c in counts.items():
        r = Counter(c.values())
        y = r[1] / (r[1] + 2 * r[2]) if r[1] + 2 * r[2] else 0
        discount[n] = [min(k - 0.05, max(0.05, k - (k + 1) * y * r[k + 1] / r[k])) if r[k] and r[k + 1] else 0.5 * k for k in (1, 2, 3)]
    followers = {n: defaultdict(list) for n in counts}
    for n, c in counts.items():
        for g, k in c.items():
            followers[n][g[:-1]].append(k)

    def chance(g):
        if not g:
            return 1 / kneser_ney.CLASSES
        n, of = len(g), followers[len(g)].get(tuple(g[:-1]))
        if not of:
            return chance(g[1:])
        d = lambda k: min(k, discount[n][min(k, 3) - 1])
        k = counts[n].get(tuple(g), 0)
        return ((k - d(k)) / sum(of) if k else 0) + sum(map(d, of)) / sum(of) * chance(g[1:])

    return chance


def test_kneser_ney_against_formulas(spark):
    texts = ["the cat sat on the mat. " * 5, "a dog, a log and the fog", "Ünïcode, die 7 Öfen!", "кот и пёс"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    table, chance = kneser_ney.log_table(kneser_ney.train(docs)), plain_kneser_ney(texts)
    for t in (*texts, "the dog sat; 99 кот", ""):
        s = kneser_ney.symbols(t, False).tolist()
        want = [-math.log10(chance(g)) for g in zip(s, s[1:], s[2:], s[3:], strict=False)]
        assert np.allclose(table[kneser_ney.codes(t, False)] / kneser_ney.SCALE, want, atol=0.6 / kneser_ney.SCALE)


def test_kneser_ney_chances_add_up(spark):
    docs = spark.createDataFrame([("the cat sat on the mat. " * 5,), ("a dog, a log and the fog",)], "text string")
    p = 10 ** (-kneser_ney.log_table(kneser_ney.train(docs)).reshape(-1, 64).astype(np.float64) / kneser_ney.SCALE)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-3)
    seen = kneser_ney.codes("the cat sat")
    assert p.reshape(-1)[seen].mean() > 0.4


def test_scores(docs, rows):
    got = log_bilinear.score_documents(docs.select("doc_id", "text")).collect()
    assert len(got) == len(rows)
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    split = lambda t: [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t)), ""]
    c = Counter(w for d, t in rows if not held(d) for w in split(t))
    n, v = sum(c.values()), len(c)
    want = defaultdict(list)
    for d, t in rows:
        w = split(t)
        want[d].append((held(d), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)))
    for r in got:
        assert any(tuple(r)[1:5] == x[:4] and math.isclose(r.base_score, x[4], rel_tol=1e-9) for x in want[r.doc_id])
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_scores_do_not_depend_on_the_layout(docs):
    one, other = ({tuple(r)[:5]: r.score for r in log_bilinear.score_documents(docs.select("doc_id", "text").repartition(n)).collect()} for n in (3, 7))
    assert one.keys() == other.keys() and np.allclose(list(one.values()), [other[k] for k in one], rtol=1e-5)


def test_scores_against_a_plain_model(spark):
    """One shard, learned in the order of the rows' hashes; chances are plain softmax sums."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{i}" for i in rng.zipf(1.4, 30) % 60) for _ in range(60)]
    data = [*enumerate(texts), (7, texts[7]), (7, texts[7]), (60, "never seen w1"), (61, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, round(r.score, 3)) for r in log_bilinear.score_documents(docs, vocabulary=20).collect())
    train = [(d, t or "") for d, t in data if zlib.crc32(str(d).encode()) % 7 != 2]
    counts = Counter(w.encode() for _, t in train for w in t.split())
    top = sorted(counts, key=lambda w: (-counts[w], w))[:20]
    outside = sum(k for w, k in counts.items() if w not in top)
    mass = np.array([len(train), outside, *(counts[w] for w in top)], float) + 1
    u = mass / mass.sum()
    number = lambda t: [0, 0, *(top.index(w) + 2 if w in top else 1 for w in t.encode().split()), 0]
    by_hash = docs.select(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("h"), "doc_id", "text").collect()
    held = Counter((r.h, r.text or "") for r in by_hash if zlib.crc32(str(r.doc_id).encode()) % 7 != 2)
    model = log_bilinear.LogBilinear.start(u)
    state = [np.zeros_like(x) for x in (model.r, model.q, model.b, model.c)]
    steps = [(x[i], x[i + 1], x[i + 2], k) for (_, t), k in sorted(held.items()) for x in [number(t)] for i in range(len(x) - 2)]
    a, b, w, k = (np.array(x) for x in zip(*steps, strict=True))
    noise, cdf = np.random.default_rng((11, 0)), np.cumsum(u)
    cdf[-1] = 1
    order = noise.permutation(len(w))
    for at in range(0, len(order), log_bilinear.BATCH):
        o = order[at : at + log_bilinear.BATCH]
        model.learn(np.stack([a[o], b[o]], axis=1), w[o], k[o].astype(np.float32), np.log(u).astype(np.float32), cdf, noise, state)
    rare = len(counts) - len(top)

    def score(t):
        x, words, total = number(t), [*t.encode().split(), None], 0.0
        for i, word in enumerate(words):
            h = model.r[x[i]].astype(float) * model.c[0] + model.r[x[i + 1]] * model.c[1]
            s = model.q @ h + model.b
            total += math.log10(math.exp(s[x[i + 2]]) / np.exp(s).sum())
            if x[i + 2] == 1:
                total += math.log10((counts[word] + 1) / max(1, outside + rare + 1))
        return total

    want = [(d, score(t or "")) for d, t in data]
    for (d, s), k in got.items():
        assert sum(d == e and abs(s - v) < 2e-3 for e, v in want) >= k


def test_log_bilinear_is_normalised():
    rng = np.random.default_rng(7)
    model = log_bilinear.LogBilinear.start(np.full(40, 1 / 40))
    context = rng.integers(0, 40, (5000, 2)).astype(np.int32)
    word = ((context[:, 0] + 1) % 40).astype(np.int32)
    u = np.full(40, 1 / 40)
    state = [np.zeros_like(x) for x in (model.r, model.q, model.b, model.c)]
    for _ in range(400):
        model.learn(context, word, np.ones(5000, np.float32), np.log(u).astype(np.float32), np.cumsum(u), rng, state)
    for a, b in ((3, 4), (39, 0)):
        p = [10 ** model.log10(np.array([a, b, w], np.int32))[0] for w in range(40)]
        assert math.isclose(sum(p), 1, rel_tol=1e-4) and int(np.argmax(p)) == (a + 1) % 40


# -- empty tables, clashing columns ----------------------------------------------------------------------------------------


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path = token_store.write_tokens(none, shared_path(spark, "t"))
    for df in (kneser_ney.classify(none, labels), pii.find_pii(none), log_bilinear.score_documents(none), mixing.mix_sources(none), simhash.simhash_components(none), rules.apply_policy(rules.rule_ledger(none)), token_store.read_tokens(spark, path), packing.pack_pieces(packing.token_pieces(none)), substrings.remove_repeated(none), lsh.embedding_components(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))):
        assert df.count() == 0


def test_clashing_columns(odd, spark):
    wide = odd.withColumns({c: F.lit(1) for c in ("key", "u", "v", "g", "c", "o", "s", "size", "k", "slice", "h", "w", "t", "l", "n", "data", "label", "pattern", "kept", "doc_key", "rest", "target", "level", "node", "component", "rep", "__c", "__email", "__ip", "__card", "__phone", "__s", "__lang", "__limit", "__other", "__id", "w", "bands", "bs")})
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for df in (kneser_ney.classify(wide, labels), pii.find_pii(wide), log_bilinear.score_documents(wide), mixing.mix_sources(wide), simhash.simhash_components(wide), rules.rule_ledger(wide), substrings.remove_repeated(wide), packing.token_pieces(wide)):
        assert df.count() >= 17
    for df in (kneser_ney.classify(wide, labels), pii.find_pii(wide)):
        assert set(wide.columns) <= set(df.columns)
