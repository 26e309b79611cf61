"""The word model of the quality classifier against plain formulas, with tables small enough to be sent and without."""

import math
import os
from collections import Counter, defaultdict

import numpy as np
import pytest

from quantspark.llm import kneser_ney, word_model

TRUSTED = ["the cat sat on the mat and the dog sat on the cat", "The dog saw the cat on the mat", "a dog and a cat sat", "а кот сидел on the mat", "the the end"]
OTHER = ["the cat sat on the log", "mat the on sat cat the", "zzz qqq the the the", "", None, "кот кот dog " * 50]


def discounts(values):
    r = Counter(values)
    y = r[1] / max(1, r[1] + 2 * r[2])
    return [max(0.05, min(k - 0.05, k - (k + 1) * y * r[k + 1] / r[k])) if r[k] and r[k + 1] else 0.5 * k for k in (1, 2, 3)]


def plain_model(texts, spelling):
    """Chance of a word after another, leaving out n-grams of one document if asked."""
    words = lambda t: t.encode().lower().split()
    pairs, holders, holds = Counter(), defaultdict(set), defaultdict(set)
    for d, t in enumerate(texts):
        w = [word_model.BEGIN, *words(t), word_model.END]
        for g in zip(w, w[1:], strict=False):
            pairs[g] += 1
            holders[g].add(d)
        for x in w:
            holds[x].add(d)
    seen, after = Counter(w for _, w in pairs), defaultdict(list)
    for (u, _), n in pairs.items():
        after[u].append(n)
    d1, d2 = discounts(seen.values()), discounts(pairs.values())
    off = lambda n, d: d[min(n, 3) - 1]
    share = sum(off(n, d1) for n in seen.values()) / len(pairs)
    spelled = lambda w: 10.0 ** (-int(word_model.spelled(spelling, [w])[0]) / kneser_ney.SCALE)

    def score(text, alone):
        w, total = [word_model.BEGIN, *words(text), word_model.END], 0.0
        w = [w[0], *(word_model.REPEAT if a == b else b for a, b in zip(w, w[1:], strict=False))]
        out = lambda h: alone and len(h) == 1
        for u, v in zip(w, w[1:], strict=False):
            p = share * spelled(v)
            if v in seen and not out(holds[v]):
                p += (seen[v] - off(seen[v], d1)) / len(pairs)
            freed = sum(off(n, d2) for n in after[u]) if u in after else None
            if u in after and not out(holds[u]):
                p *= freed / sum(after[u])
            if (u, v) in pairs and not out(holders[u, v]):
                p += (pairs[u, v] - off(pairs[u, v], d2)) / sum(after[u])
            total += math.log10(p)
        return len(w) - 1, total

    return score


@pytest.mark.parametrize("known", [0, 12, 500_000])
def test_chances_are_those_of_words(spark, monkeypatch, known):
    monkeypatch.setattr(word_model, "KNOWN", known)
    rows = [(i, t, "en") for i, t in enumerate(TRUSTED + OTHER)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(len(TRUSTED))] + [(len(TRUSTED), 0, 0)], "doc_id long, quality int, toxic int")
    spelling = kneser_ney.log_table(kneser_ney.train(spark.createDataFrame([(t,) for t in TRUSTED], "text string")))
    score = plain_model(TRUSTED, spelling)
    got = {r.doc_id: r for r in kneser_ney.classify(docs, labels).select("doc_id", "quality.*").collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        n, want = score(t or "", i < len(TRUSTED))
        assert got[i].n_tokens == n and abs(got[i].log10_prob - want) <= 1.5 * (n + 1) / kneser_ney.SCALE
    limit = kneser_ney.MARGIN * max(got[i].perplexity for i in range(len(TRUSTED)))
    assert all(math.isclose(r.threshold, limit) and r.kept == (r.perplexity <= limit) for r in got.values())
    assert got[len(TRUSTED)].perplexity < got[len(TRUSTED) + 1].perplexity  # the same letters nearly, words in another order


def test_equal_texts_in_slices_of_their_own(spark, monkeypatch):
    """Slices that hold equal texts share their answers."""
    monkeypatch.setattr(word_model, "KNOWN", 0)
    docs = spark.createDataFrame([(i, TRUSTED[i % 2], "en") for i in range(12)], "doc_id long, text string, lang string").repartition(12)
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    got = kneser_ney.classify(docs, labels).select("doc_id", "quality.*").where("doc_id > 1").collect()
    assert len(got) == 10 and len({(r.n_tokens, r.log10_prob) for r in got}) == 2


def test_keys_of_pairs_are_sparks(spark):
    rows = [(1, 2), (-5, 7), (2**62, -(2**63)), (0, 0)]
    got = [r[0] for r in spark.createDataFrame(rows, "u long, w long").selectExpr("xxhash64(u, w)").collect()]
    u, w = (np.array(x, np.int64).view(np.uint64) for x in zip(*rows, strict=True))
    assert word_model.pair_keys(u, w).view(np.int64).tolist() == got


def test_tables_are_shuffled_in_parts_and_packed_once(spark, monkeypatch):
    """What lies on disk at once: half of the pairs on the way to their words; then the table packed once for all parts of the texts."""
    names, shared = [], spark.sparkContext
    stored = word_model.stored
    monkeypatch.setattr(word_model, "stored", lambda df, name: names.append(name) or stored(df, name))
    monkeypatch.setattr(word_model, "KNOWN", 12)
    docs = spark.createDataFrame([(t,) for t in TRUSTED], "text string").repartition(3)
    trusted = stored(docs, "trusted")
    held = shared.broadcast(kneser_ney.train(trusted))
    table, unseen = word_model.train(trusted, held)
    files = table.inputFiles()
    scores = word_model.score(docs.selectExpr("xxhash64(text) key", "text"), table, unseen, held)
    assert names.count("packed") == 1 and names.count("values") >= 3 and names[-word_model.PARTS :] == ["scores"] * word_model.PARTS
    folders = {f.rpartition("/")[0] for f in files}
    assert len(folders) >= 3 and not any(os.path.exists(f.removeprefix("file:").replace("///", "/")) for f in folders)
    assert scores.count() == len(TRUSTED)
