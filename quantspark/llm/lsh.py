"""Embedding near-duplicates: random-hyperplane sign hashes in several tables, exact cosine checks, components."""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log1p, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import checkpoint, table, union_roots
from .components import connected_components

THRESHOLD, TABLES, PLANES, SEED = 0.93, 18, 12, 7
#: Different vectors of a block on average, which sets the number of planes beyond PLANES, and planes at most.
BLOCK_VECTORS, MOST_PLANES = 64, 24
CHUNK = 1024
#: Types of codes up to 16 planes and beyond.
CODES = ("<u2", "<u4")


def _unit(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def sign_codes(unit: np.ndarray, tables: int, planes: int, seed: int = SEED) -> np.ndarray:
    """Codes of each vector in each table: the signs of its products with that table's random directions."""
    normals = np.random.default_rng([seed, unit.shape[1]]).standard_normal((unit.shape[1], tables * planes))
    bits = (unit @ normals > 0).reshape(len(unit), tables, planes)
    return (bits << np.arange(planes)).sum(axis=2).astype(np.int32)


def tables_for(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(tables, planes) for a label of n vectors: blocks stay as small when n grows, and recall at the threshold as high.

    Two vectors at the threshold agree in a plane with chance 1 - angle / pi; the tables follow from what TABLES of PLANES miss.
    """
    planes = min(MOST_PLANES, max(PLANES, ceil(log2(max(n, 1) / BLOCK_VECTORS))))
    same = 1 - acos(threshold) / pi
    missed = TABLES * log1p(-(same**PLANES))
    return TABLES if planes == PLANES else ceil(missed / log1p(-(same**planes))), planes


def _tables(tables: int, planes: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                b = batch.slice(at, 2048)
                vectors = [np.asarray(v, np.float64) for v in b.column(3).to_pylist()]
                dims = np.array([len(v) for v in vectors])
                for dim in np.unique(dims):
                    own = np.flatnonzero(dims == dim)
                    codes = sign_codes(_unit(np.concatenate([vectors[i] for i in own]), int(dim)), tables, planes)
                    sub = b.take(pa.array(own))
                    packed, raw = [c.tobytes() for c in codes.astype(CODES[planes > 16])], [vectors[i].astype(kind).tobytes() for i in own]
                    for t in range(tables):
                        key = pa.array((np.int64(t) << 48) | (np.int64(dim & 0xFFFFFF) << 24) | codes[:, t].astype(np.int64))
                        yield pa.record_batch([sub.column(0), key, sub.column(1), sub.column(2), pa.array(raw, pa.binary()), pa.array(packed, pa.binary())], ["label", "key", "node", "n", "vector", "codes"])

    return run


def _verify(threshold: float, kind: str, wide: bool):
    def group(label, key, lo, hi, side, ids, n, vectors, codes):
        unit = _unit(np.frombuffer(b"".join(vectors), kind), len(vectors[0]) // np.dtype(kind).itemsize)
        code = np.frombuffer(b"".join(codes), CODES[wide]).reshape(len(ids), -1)[:, : key >> 48]
        a = np.flatnonzero(side == lo)
        b = a if lo == hi else np.flatnonzero(side == hi)
        near = unit[a] @ unit[b].T >= threshold
        if lo == hi:
            np.fill_diagonal(near, False)
        i, j = np.nonzero(near)
        fresh = (code[a[i]] != code[b[j]]).all(axis=1)  # counted in the first table where the two meet
        i, j = a[i], b[j]
        root = union_roots(len(ids), i, j)
        links = np.bincount(i[fresh], n[j[fresh]], len(ids))
        if lo != hi:
            links += np.bincount(j[fresh], n[i[fresh]], len(ids))
        out = np.flatnonzero((links > 0) | (root != np.arange(len(ids))))
        return pa.record_batch([pa.array(ids[out]), pa.array(links[out].astype(np.int64)), pa.array(ids[root[out]])], ["node", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None

        def done():
            cols = list(zip(*held, strict=True))
            order = np.argsort(np.array(cols[5]), kind="stable")
            return group(*(cols[k][0] for k in range(4)), np.array(cols[4])[order], np.array(cols[5])[order], np.array(cols[6], np.float64)[order], [cols[7][i] for i in order], [cols[8][i] for i in order])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(9)), strict=True):
                if last is not None and row[:4] != last:
                    if len(held) > 1:
                        yield done()
                    held = []
                last = row[:4]
                held.append(row)
        if len(held) > 1:
            yield done()

    return run


def embedding_links(distinct: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, planes: int = PLANES, chunk: int = CHUNK) -> DataFrame:
    """``distinct(label, node, n, embedding)`` -> ``(node, links, root)`` by table and block.

    Within a block all cosines are computed exactly. ``links`` counts the vectors (each for its n copies) that a vector
    meets there first: pairs that share a code in an earlier table are left to it, so sums over blocks count each link
    once. ``root`` is the smallest node that the block's links reach. Blocks over ``chunk`` vectors are split by a hash, and every
    pair of chunks is compared in a group of its own, in sorted order, so a task holds two chunks at most. Single
    precision vectors travel as such.
    """
    if not 0 < planes <= MOST_PLANES:
        raise ValueError(f"planes must be 1 to {MOST_PLANES}")
    kind = "<f4" if isinstance(distinct.schema["embedding"].dataType.elementType, FloatType) else "<f8"
    schema = "label string, key long, node long, n long, vector binary, codes binary"
    rows = distinct.select(F.col("label").cast("string"), "node", "n", F.col("embedding").cast("array<double>")).mapInArrow(_tables(tables, planes, kind), schema)
    hot = rows.groupBy("label", "key").count().where(F.col("count") > chunk).select("label", "key", F.ceil(F.col("count") / chunk).cast("int").alias("g"))
    rows = rows.join(hot, ["label", "key"], "left")
    rows = rows.withColumn("c", F.when(F.col("g").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), "g")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("g") - 1, F.lit(0)))))
    rows = rows.select("label", "key", F.least("c", "o").alias("lo"), F.greatest("c", "o").alias("hi"), F.col("c").alias("side"), "node", "n", "vector", "codes")
    rows = rows.repartition("label", "key", "lo", "hi").sortWithinPartitions("label", "key", "lo", "hi")
    return rows.mapInArrow(_verify(threshold, kind, planes > 16), "node long, links long, root long")


def embedding_components(vectors: DataFrame, threshold: float = THRESHOLD, tables: int | None = None, planes: int | None = None) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row of ``vectors(vec_id, embedding, label)``.

    A vector that is null, empty, all zero, or holds a null or non-finite component, one without label and one without
    vec_id link with nothing: n_links 0, its own component, kept. Vectors of different lengths are never linked.
    Equal vectors of a label are collapsed before the search and count as links of one another. Different vectors of one
    vec_id are searched apart: nodes of the search are numbered rows, and vec_ids come in last.
    """
    x = F.col("embedding")
    sound = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(
        F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf")))) & F.exists("embedding", lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long"), x.alias("embedding"), "label", sound.alias("sound"))
    good = rows.where("sound")
    distinct = checkpoint(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()))
    if tables is None or planes is None:
        most = distinct.groupBy("label").count().agg(F.max("count")).first()[0]
        tables, planes = tables_for(most or 0, threshold)
    links = checkpoint(embedding_links(distinct, threshold, tables, planes))
    root = connected_components(links.select(F.col("node").alias("u"), F.col("root").alias("v")))
    found = distinct.join(links.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(root, "node", "left")
    found = checkpoint(found.select("label", "embedding", "node", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")))
    least = found.join(root.select("component").distinct(), "component").groupBy("component").agg(F.min("least").alias("component_id"))
    found = found.join(least, "component", "left").select("label", "embedding", "n_links", F.coalesce("component_id", "least").alias("component_id"))
    out = good.join(found, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    out = out.unionAll(rows.where("not sound").select("vec_id", F.lit(0).cast("long"), F.col("vec_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op7_embeddings(spark, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
