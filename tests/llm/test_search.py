"""Ranked search against plain scores of every document."""

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quantspark.llm import treaps

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def plain(docs, items, k=treaps.TOP):
    bags = [(d, TERM.findall((t or "").translate(LOWER))) for d, t in docs]
    n, size = sum(1 for _, b in bags if b), sum(len(b) for _, b in bags)
    counts = [(d, len(b), Counter(b)) for d, b in bags]
    df = Counter(t for _, _, c in counts for t in c)
    for item, text in items:
        query = [t for t in TERM.findall((text or "").translate(LOWER)) if df[t]]
        w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in query}
        scores = []
        for d, length, c in counts:
            m = 75 + (25 * length * n) // size if size else 0
            s = sum(w[t] * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in query if c[t])
            if s > 0:
                scores.append((-s, d is None, d))
        for rank, (s, _, d) in enumerate(sorted(scores)[:k], 1):
            yield item, rank, d, -s


def key(r):
    return tuple((x is None, x) for x in r)


def test_whole_tables(spark, sf, docs, rows):
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    odd = [(900, "the the the of"), (900, "the the the of"), (901, None), (902, ""), (903, "nowhere-such-a-term"), (None, "alpha BETA omega"), (904, "tèxt Ünï aaaa 　x")]
    items = items.unionAll(spark.createDataFrame(odd, items.schema))
    got = sorted(map(tuple, treaps.search(docs, items).collect()), key=key)
    assert got == sorted(plain(rows, [tuple(r) for r in items.collect()]), key=key)


def test_query_columns_and_clashes(spark, odd):
    items = spark.createDataFrame([(1, "alpha omega", 5)], "item_id long, text string, rank int")
    clash = odd.withColumn("n", F.lit(1)).withColumn("terms", F.lit("x")).withColumn("item_id", F.lit(3))
    out = treaps.search(clash, items)
    assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() > 3


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert treaps.search(docs, items).count() == 0 and treaps.search(items.toDF("doc_id", "text"), items.where("false")).count() == 0
    assert treaps.search(spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string"), items).count() == 0


def test_blocks_of_queries(spark, docs, rows, monkeypatch):
    items = [(i, t) for i, t in rows[:40] if i is not None]
    monkeypatch.setattr(treaps, "BLOCK_ITEMS", 7)
    got = treaps.search(docs, spark.createDataFrame(items, "item_id long, text string"), k=3)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(rows, items, 3), key=key)


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(treaps, "PART", 7)
    text = "Some words, é3 x" * 50 + "z" * 40
    assert [t for part in treaps.terms(text.encode()) for t in part] == [t.encode() for t in TERM.findall(text.translate(LOWER))]


def test_treaps_are_heaps_in_search_order():
    rng = np.random.default_rng(3)
    first = np.array([0, 0, 1, 40, 40, 300, 301])
    for impact in (rng.integers(0, 9, 301), np.arange(301), np.arange(301)[::-1].copy(), np.ones(301, np.int64)):
        left, right, roots = treaps.treap_links(impact, first)
        for run in range(len(first) - 1):
            def walk(x, lo, hi):
                if x == len(impact):
                    assert lo == hi
                    return
                assert lo <= x < hi and impact[x] == impact[lo:hi].max()
                stack.extend([(left[x], lo, x), (right[x], x + 1, hi)])

            stack = [(roots[run], first[run], first[run + 1])]
            while stack:
                walk(*stack.pop())


def test_shards_prune_and_keep_ties():
    rng = np.random.default_rng(4)
    n, v, k = 6000, 12, 20
    hit = rng.random((n, v)) < np.linspace(0.02, 0.6, v)
    worth = rng.integers(1, 60, (n, v)) * hit
    worth[: n // 3] = worth[0]  # a third are copies
    ids = rng.permutation(n)
    weight = np.zeros(v, np.int64)
    visited = 0
    for own, times in ((np.array([0, 3, 11]), np.array([1, 1, 2])), (np.arange(v), np.ones(v, np.int64)), (np.array([5]), np.array([1]))):
        weight[:] = 0
        weight[own] = times
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for part in np.array_split(np.arange(n), 3):
            part = part[np.argsort(ids[part])]
            doc, term = np.nonzero(worth[part])
            shard = treaps.Shard(ids[part], doc, term, worth[part][doc, term], v)
            best = shard.search(own, times, weight, best, k)
            visited += shard.visited
        total = worth @ weight
        want = np.lexsort((ids, -total))[:k]
        want = want[total[want] > 0]
        assert best[0].tolist() == total[want].tolist() and best[1].tolist() == ids[want].tolist()
    assert visited < 3 * n / 2
