"""Nearest neighbours: codes within a radius against all codes, and answers against all products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantspark.llm import multi_index as mi


def exact(rows, k=mi.TOP):
    """(query, rank, vec_id, score) by all products; rows are (vec_id, vector)."""
    x, ids = np.array([v for _, v in rows], np.float64), np.array([i for i, _ in rows])
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -s)) if j != i][:k]
        yield from ((ids[i], r, ids[j], s[j]) for r, j in enumerate(order, 1))


def recall(got, want):
    want = {(q, v) for q, _, v, _ in want}
    return len({(r.query_id, r.vec_id) for r in got} & want) / len(want)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 32)).astype(np.float32) * rng.uniform(0.2, 3, 3000)[:, None].astype(np.float32)
    x[:1000] = 30 * x[0] / np.sqrt((x[0] ** 2).sum())  # a third are copies
    x[1000:1200] = x[1000] + 0.01 * rng.standard_normal((200, 32)).astype(np.float32)
    return [(int(i), v.tolist()) for i, v in zip(rng.permutation(3000), x, strict=True)]


def test_pigeonhole_finds_every_code():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((500, 24))
    model = mi.learn(x, float(mi.norms(x).max()))
    index = mi.Index(model, x, np.arange(500), np.arange(500))
    for q in model.codes(model.query(rng.standard_normal((9, 24)))):
        apart = np.bitwise_count(index.codes ^ q)
        for radius in (0, 3, 8, 13, 24, 40, 64):
            assert index.within(q, radius).tolist() == np.flatnonzero(apart <= radius).tolist()
            assert index.within(q, radius, 3).tolist() == np.flatnonzero((apart <= radius) & (apart > 3)).tolist()


def test_radii_fall_with_similarity():
    x = np.random.default_rng(2).standard_normal((400, 70))
    model = mi.learn(x, float(mi.norms(x).max()))
    assert (np.diff(model.radius) <= 0).all() and model.reach(1) < model.reach(0.5) < model.reach(0) <= mi.BITS
    assert np.allclose(model.turn.T @ model.turn, np.eye(mi.BITS), atol=1e-9)
    unit = model.lifted(x)
    assert np.allclose((unit**2).sum(axis=1), 1) and np.allclose((model.query(x) @ unit.T) * np.outer(mi.norms(x), np.full(400, model.length)), x @ x.T)


def test_products_of_vectors_of_many_lengths(spark, vectors):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(3)
    got, want = mi.nearest(df, "vec_id % 20 = 0").collect(), list(exact(vectors))
    assert len(got) == len(want) and recall(got, want) >= 0.95
    exact_score = {(q, v): s for q, _, v, s in exact(vectors, 3000)}
    by_query = {}
    for r in got:
        assert np.isclose(r.score, exact_score[r.query_id, r.vec_id], rtol=1e-12, atol=1e-12)
        by_query.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    for rows in by_query.values():
        assert sorted(rows) == sorted(rows, key=lambda x: x[1:]) and [x[0] for x in sorted(rows)] == list(range(1, len(rows) + 1))
    copy = min(i for i, v in vectors if v == vectors[0][1] and i % 20 == 0)
    assert [x[2] for x in sorted(by_query[copy])] == sorted(i for i, v in vectors if v == vectors[0][1] and i != copy)[:20]


def test_recall_on_the_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = mi.op13_neighbours(spark, sf).collect()
    assert recall(got, list(exact(rows))) >= 0.95 and len(got) == 20 * sum(i % 20 == 0 for i, _ in rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [0.0, 2.0]), (1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (None, [1.0, 0.0]), (None, [1.0, 0.0]), (8, [3.0]), (20, [2.0]), (40, None), (60, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = mi.nearest(df.withColumn("rank", F.lit("x")).withColumn("row", F.lit(1)), "vec_id % 20 = 0")
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    got = sorted((r.query_id, r.score != 0, r["rank"], r.vec_id, r.score) for r in out.where("query_id <> 0").collect())
    assert got == [(20, True, 1, 8, 6.0)]
    zero = sorted((r["rank"], r.vec_id is None, r.vec_id, r.score) for r in out.where("query_id = 0").collect())
    assert sorted(x[3] for x in zero) == [0, 0, 0, 0, 0, 1, 1, 1] and sum(x[1] for x in zero) == 4 and max(x[0] for x in zero) == 4
    assert mi.nearest(df.where("false"), "vec_id % 20 = 0").count() == 0 and mi.nearest(df.where("vec_id = 2"), "vec_id % 20 = 0").count() == 0


def test_blocks_of_queries(spark, vectors, monkeypatch):
    df = spark.createDataFrame(vectors[900:1500], "vec_id long, embedding array<float>")
    one = sorted(map(tuple, mi.nearest(df, "vec_id % 20 = 0").collect()))
    monkeypatch.setattr(mi, "BLOCK", 9)
    assert sorted(map(tuple, mi.nearest(df, "vec_id % 20 = 0").collect())) == one
