"""Near copies by five-word shingles against all pairs."""

import random

import numpy as np

import corpus_pipeline
from quantspark.llm import components, jaccard, simhash


def test_stage_joins_near_copies_of_any_fingerprint(spark):
    rng = random.Random(5)
    rows, far = [], 0
    for i in range(0, 60, 2):
        words = [f"w{rng.randrange(5000)}" for _ in range(150)]
        copy = [*words[:-6], *(f"x{rng.randrange(5000)}" for _ in range(6)), *(f"y{rng.randrange(5000)}" for _ in range(6))]
        rows += [(i, " ".join(words)), (i + 1, " ".join(copy))]
        a, b = (jaccard.shingles(t.encode()) for _, t in rows[-2:])
        assert jaccard.similarity(a, b) >= 0.8
        far += (simhash.fingerprint(rows[-2][1].encode()) ^ simhash.fingerprint(rows[-1][1].encode())).bit_count() > simhash.RADIUS
    assert far
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == list(range(0, 60, 2))


def plain_components(rows, threshold=0.8):
    sets = [(d, jaccard.shingles((t or "").encode())) for d, t in rows]
    root = {d: d for d, _ in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (u, a) in enumerate(sets):
        for v, b in sets[:i]:
            if min(len(a), len(b)) >= threshold * max(len(a), len(b)) and jaccard.similarity(a, b) >= threshold:
                x, y = sorted((top(u), top(v)))
                root[y] = x
    return {d: top(d) for d in root}


def test_components_against_all_pairs(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.component_id for r in simhash.near_copies(df).collect()} == plain_components(rows)


def test_large_groups_in_three_steps(spark):
    """Chains and clusters whose members meet in different chunks only."""
    rng = random.Random(6)
    rows = []
    for g in range(3):
        words = [f"g{g}w{k}" for k in range(300)]
        for i in range(60):
            own = list(words)
            for k in rng.sample(range(300), 4 if g == 0 else 2):
                own[k] = f"r{rng.randrange(10**6)}"
            rows.append((1000 * g + i, " ".join(own if g < 2 else words[5 * i :] + [f"t{k}" for k in range(5 * i)])))
    sets = [jaccard.shingles(t.encode()) for _, t in rows]
    prints = np.array([np.frombuffer(simhash.wide_fingerprint(h), "<u8") for h in sets])
    radius = 128  # every pair of a group is a candidate here
    nodes = [jaccard.set_key(h) for h in sets]
    groups = spark.createDataFrame([(k, d // 1000, bytearray(p.tobytes())) for k, (d, _), p in zip(nodes, rows, prints, strict=True)], "node long, component long, fp binary")
    texts = spark.createDataFrame([(t,) for _, t in rows], "text string").repartition(3)
    want = plain_components(rows)
    name = dict(zip(nodes, (d for d, _ in rows), strict=True))
    for chunk in (7, 25, 1000):
        found = {r.node: r.component for r in jaccard.exact_components(groups, texts, radius, chunk=chunk).collect()}
        parts = {}
        for k in nodes:
            parts.setdefault(found.get(k, k), []).append(name[k])
        assert sorted(map(sorted, parts.values())) == sorted(sorted(d for d in want if want[d] == r) for r in set(want.values()))


def test_unrelated_fingerprints_are_no_candidates():
    """In 7 * 10^7 pairs of random fingerprints none comes within the radius: candidates do not hang together as tables grow."""
    prints = np.random.default_rng(9).integers(0, 2**64, (12_000, simhash.WIDE // 64), np.uint64)
    a, _ = simhash.bit_sliced_links(prints, np.zeros(len(prints), int), simhash.wide_radius(0.8))
    assert not len(a)


def test_rounds_of_masks(spark, monkeypatch):
    """Any number of masks a round gives the components of all masks at once, and no round has the keys of all of them."""
    rng = np.random.default_rng(10)
    prints = np.repeat(rng.integers(0, 2**64, (40, simhash.WIDE // 64), np.uint64), 12, axis=0)
    for x in prints:
        for k in rng.choice(simhash.WIDE, 16, replace=False):
            x[k // 64] ^= np.uint64(1 << int(k % 64))
    known = spark.createDataFrame([(i, bytearray(x.tobytes()), -i) for i, x in enumerate(prints)], "node long, fp binary, rep long")
    masks, radius = simhash.sampled_masks(0.8, 300_000), simhash.wide_radius(0.8)
    whole = {r.node: r.component for r in simhash.connected_components(simhash.simhash_edges(known, masks, radius)).collect()}
    assert len(masks) > simhash.ROUND and len(set(whole.values())) == 40
    plain, taken = simhash.simhash_edges, []
    monkeypatch.setattr(simhash, "simhash_edges", lambda rows, part, *a: taken.append(len(part)) or plain(rows, part, *a))
    got = simhash.candidate_components(known, masks, radius).collect()
    assert {r.node: r.component for r in got} == {i: whole.get(i, i) for i in range(len(prints))} and all(r.rep == -r.node for r in got)
    assert max(taken) == simhash.ROUND and sum(taken) == len(masks)


def test_stars_take_no_round(spark, monkeypatch):
    """Links that are stars already are given back as they are; a chain and a node of two roots are not taken for stars."""
    kept, written = components.checkpoint, []
    monkeypatch.setattr(components, "checkpoint", lambda df: written.append(1) or kept(df))
    found = lambda rows: sorted(tuple(r) for r in components.connected_components(spark.createDataFrame(rows, "u long, v long")).collect())
    assert found([(1, 2), (3, 1), (5, 4)]) == [(2, 1), (3, 1), (5, 4)] and len(written) == 1
    assert found([(2, 1), (3, 2)]) == [(2, 1), (3, 1)] and found([(3, 1), (3, 2)]) == [(2, 1), (3, 1)] and found([]) == []
