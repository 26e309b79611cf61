"""Approximate nearest neighbours by multi-index hashing: learned rotated binary codes, indexed by substrings, reranked exactly.

A code has 64 bits: signs of the principal directions after a rotation learned to lose least by taking signs (iterative
quantization). Codes are cut into eight substrings, each with its own inverted lists. By the pigeonhole principle, a code within
radius r of a query's agrees with it in some substring up to r / 8 bits, so probing those lists retrieves every such code. The
radius follows the k-th product found so far: it is the distance that codes of so similar vectors exceed with chance MISS.
The largest inner product becomes the largest cosine by one more coordinate, which gives all vectors the greatest length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import stored, table

BITS, PARTS, TOP, MISS = 64, 8, 20, 0.03
#: Rows from which the rotation and the radii are learned: those with the smallest hashes.
SAMPLE = 4096
#: Rows of a shard, rows a task takes at least, queries and bytes of a block.
SHARD, TASK_ROWS, BLOCK, BLOCK_BYTES = 32768, 4096, 16384, 16 << 20
GRID = 80
LAST = np.iinfo(np.int64).max
#: Bytes that differ from 0 in at most a bits.
BALLS = [np.flatnonzero(np.bitwise_count(np.arange(256, dtype=np.uint8)) <= a) for a in range(PARTS + 1)]


def norms(x: np.ndarray) -> np.ndarray:
    most = np.abs(x).max(axis=1)
    return most * np.sqrt(((x / most[:, None]) ** 2).sum(axis=1))


@dataclass
class Model:
    """``length`` is the greatest norm; ``radius[i]`` belongs to cosines from ``2 i / GRID - 1`` on."""

    length: float
    mean: np.ndarray
    turn: np.ndarray
    radius: np.ndarray

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors of one more coordinate, whose cosines with a query's are products over both lengths."""
        x = x.astype(np.float64) / self.length
        return np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))])

    def query(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.column_stack([x / norms(x)[:, None], np.zeros(len(x))])

    def codes(self, unit: np.ndarray) -> np.ndarray:
        bits = np.packbits((unit - self.mean) @ self.turn > 0, axis=1)
        return bits.reshape(len(unit), PARTS).copy().view(np.uint64)[:, 0]

    def reach(self, cosine: float) -> int:
        return int(self.radius[min(GRID, max(0, int((cosine + 1) * GRID / 2)))])


def learn(sample: np.ndarray, length: float, rounds: int = 30, seed: int = 5) -> Model:
    """Rotation and radii from a sample of vectors. Radii come from pairs made of the sample at every cosine of a grid."""
    rng = np.random.default_rng(seed)
    model = Model(length, np.zeros(0), np.zeros(0), np.zeros(0))
    unit = model.lifted(sample)
    model.mean = unit.mean(axis=0)
    _, _, axes = np.linalg.svd(unit - model.mean, full_matrices=False)
    axes = axes[:BITS].T
    axes = np.column_stack([axes, np.zeros((len(axes), BITS - axes.shape[1]))])
    flat, turn = (unit - model.mean) @ axes, np.linalg.qr(rng.standard_normal((BITS, BITS)))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
        turn = (u @ v).T
    model.turn = axes @ turn
    a, w = model.query(sample), unit[rng.permutation(len(unit))] + 1e-9 * rng.standard_normal(unit.shape)
    w -= (w * a).sum(axis=1, keepdims=True) * a
    w /= np.sqrt((w * w).sum(axis=1, keepdims=True))
    own, radius = model.codes(a), []
    for s in np.linspace(-1, 1, GRID + 1):
        apart = np.bitwise_count(own ^ model.codes(s * a + np.sqrt(1 - s * s) * w))
        radius.append(np.quantile(apart, 1 - MISS, method="higher"))
    model.radius = np.maximum.accumulate(np.array(radius, int)[::-1])[::-1]
    return model


class Index:
    """Inverted lists of the substrings of a shard's codes. Of equal vectors only the k + 1 first ids can be answers."""

    def __init__(self, model: Model, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int = TOP):
        same = np.unique(np.ascontiguousarray(x).view(f"V{x.shape[1] * x.itemsize}")[:, 0], return_inverse=True)[1]
        order = np.lexsort((rows, ids, same))
        first = np.searchsorted(same[order], np.arange(same.max() + 1))
        order = order[np.arange(len(order)) - first[same[order]] <= k]
        self.x, self.ids, self.rows, self.model, self.k = x[order], ids[order], rows[order], model, k
        unit = model.lifted(self.x)
        self.codes, self.near = model.codes(unit), np.ascontiguousarray(unit[:, :-1], np.float32)
        parts = self.codes.view(np.uint8).reshape(-1, PARTS)
        lists, starts = [], []
        for j in range(PARTS):
            order = np.argsort(parts[:, j], kind="stable")
            lists.append(order)
            starts.append(j * len(order) + np.searchsorted(parts[order, j], np.arange(257)))
        self.lists, self.starts = np.concatenate(lists), starts

    def within(self, code: np.uint64, radius: int, beyond: int = -1) -> np.ndarray:
        """Every row whose code differs from ``code`` in more than ``beyond`` and at most ``radius`` bits."""
        a, b = divmod(min(radius, BITS), PARTS)
        own = np.array([code]).view(np.uint8)
        begin, end = [], []
        for j in range(PARTS):
            most = a if j <= b else a - 1
            if most >= 0:
                values = BALLS[min(most, PARTS)] ^ own[j]
                begin.append(self.starts[j][values])
                end.append(self.starts[j][values + 1])
        begin, size = np.concatenate(begin), np.concatenate(end) - np.concatenate(begin)
        flat = np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)
        seen = np.zeros(len(self.codes), bool)
        seen[self.lists[flat]] = True
        found = np.flatnonzero(seen)
        apart = np.bitwise_count(self.codes[found] ^ code)
        return found[(apart <= radius) & (apart > beyond)]

    def search(self, x: np.ndarray, row: int, code: np.uint64, best: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        """``best`` (products falling, ids, rows) of a query after this shard: the radius grows until it holds for the k-th."""
        k, length = self.k, norms(x[None])[0] * self.model.length
        near, slack = (x / norms(x[None])[0]).astype(np.float32), 1e-6 * (8 + len(x))
        beyond, radius = -1, self.model.reach(best[0][-1] / length) if len(best[0]) == k else BITS // 4
        while True:
            c = self.within(code, radius, beyond)
            c = c[self.rows[c] != row]
            product = self.near[c] @ near
            least = best[0][-1] / length if len(best[0]) == k else -2
            if len(c) > k:
                least = max(least, np.partition(product, len(c) - k)[len(c) - k])
            c = c[product >= least - slack]
            score = np.concatenate([best[0], (self.x[c].astype(np.float64) * x).sum(axis=1)])
            ids, rows = np.concatenate([best[1], self.ids[c]]), np.concatenate([best[2], self.rows[c]])
            order = np.lexsort((rows, ids, -score))[:k]
            best = score[order], ids[order], rows[order]
            need = self.model.reach(best[0][-1] / length) if len(best[0]) == k else radius + 8
            if need <= radius or radius >= BITS:
                return best
            beyond, radius = radius, min(need, BITS)


def _flat(kind: str):
    """Sound vectors as bytes, with their norms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                vectors = [np.array(v, kind) for v in b.column(2).to_pylist()]
                sizes, length = np.array([len(v) for v in vectors], np.int32), np.zeros(len(vectors))
                for dim in np.unique(sizes):
                    own = np.flatnonzero(sizes == dim)
                    length[own] = norms(np.array([vectors[i] for i in own], np.float64))
                yield pa.record_batch([b.column(0), b.column(1), pa.array(sizes), pa.array(length), pa.array([v.tobytes() for v in vectors], pa.binary())], ["row", "vec_id", "dim", "norm", "vector"])

    return run


def _matrix(column, kind: str) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def _search(block, kind: str, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, queries, own = block.value
        queries = queries.astype(np.float64)
        codes = model.codes(model.query(queries))
        none = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        best, held, size = [none] * len(queries), [], 0

        def flush():
            t = pa.Table.from_batches(held)
            index = Index(model, _matrix(t.column(2), kind), t.column(1).fill_null(LAST).to_numpy(), t.column(0).to_numpy(), k)
            for i in range(len(queries)):
                best[i] = index.search(queries[i], own[i], codes[i], best[i])

        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
            if size >= SHARD:
                flush()
                held, size = [], 0
        if held:
            flush()
        for i, (score, ids, _) in enumerate(best):
            if len(ids):
                yield pa.record_batch([pa.array(np.full(len(ids), own[i])), pa.array(ids, mask=ids == LAST), pa.array(score)], ["query", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: str, k: int = TOP) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k rows of ``vectors(vec_id, embedding)`` with the largest products for each row that meets ``queries``.

    ``queries`` is a condition on vec_id. Vectors that are null, empty, zero, or hold null or non-finite components take no part.
    Vectors of different lengths are not compared. Rows of one vec_id are rows of their own; a row without vec_id may be an
    answer, and comes last among equals; ties go to the smaller vec_id. Fewer candidates than k are all returned.
    """
    spark = vectors.sparkSession
    kind = "<f4" if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else "<f8"
    sound = F.coalesce(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf")))) & F.exists("embedding", lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), "embedding").where(sound)
    tasks = min(max(1, -(-vectors.count() // TASK_ROWS)), 4 * spark.sparkContext.defaultParallelism)
    flat = stored(rows.mapInArrow(_flat(kind), "row long, vec_id long, dim int, norm double, vector binary").repartition(tasks, "row"), "vectors")
    found = []
    for dim, n, length in flat.groupBy("dim").agg(F.count_if(F.expr(queries)), F.max("norm")).collect():
        if not n:
            continue
        index = flat.where(F.col("dim") == dim)
        sample = index.select("vector", F.xxhash64("vector").alias("h")).orderBy("h").limit(SAMPLE).toArrow()
        model = learn(np.unique(_matrix(sample.column(0), kind), axis=0), length)
        blocks = -(-n // max(1, min(BLOCK, BLOCK_BYTES // (8 * dim))))
        for b in range(blocks):
            own = index.where(queries).where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).select("row", "vector").toArrow()
            if own.num_rows:
                block = spark.sparkContext.broadcast((model, _matrix(own.column(1), kind), own.column(0).to_numpy()))
                near = index.select("row", "vec_id", "vector").mapInArrow(_search(block, kind, k), "query long, vec_id long, score double")
                order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
                near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
                found.append(near if blocks == 1 else stored(near, "near"))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    names = flat.where(queries).select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return out.join(names, "query").select("query_id", "rank", "vec_id", "score")


def op13_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id % 20 = 0")
