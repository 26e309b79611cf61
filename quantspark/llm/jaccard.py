"""Exact Jaccard similarity of word shingle sets, checked among the near fingerprints that SimHash names."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, sent_if_small, utf8
from .components import connected_components

SEED, SHINGLE, THRESHOLD = 42, 5, 0.8
#: Members that a chunk has at most, and bytes of their sets on average at most; a task compares two chunks at once.
CHUNK, CHUNK_BYTES = 2048, 8 << 20


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles; a shorter text is one shingle, one without words has none."""
    words = text.lower().split()
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    cut = [joined[a : b - 1] for a, b in zip([0, *ends], ends[size - 1 :])]  # noqa: B905
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(SEED)), np.uint64, len(cut)))


def set_key(h: np.ndarray) -> int:
    """A name for the set, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(h.tobytes(), SEED)).view(np.int64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def linked(sets: list[np.ndarray], prints: np.ndarray, label: np.ndarray, side: np.ndarray | None, radius: int, threshold: float) -> np.ndarray:
    """For each member the smallest index that links join it to, beginning with members of equal label as joined.

    A link is a pair whose fingerprints (rows of ``prints``) differ in at most ``radius`` bits and whose sets reach the
    threshold. Members that are joined already are not compared again. With ``side``, only pairs of different sides are.
    """
    n = len(sets)
    size = np.array([len(h) for h in sets])
    _, first, back = np.unique(label, return_index=True, return_inverse=True)
    of = first[back]
    for x in range(1, n):
        small, large = np.minimum(size[:x], size[x]), np.maximum(size[:x], size[x])
        near = (of[:x] != of[x]) & (small >= threshold * large - 1e-9)
        if side is not None:
            near &= side[:x] != side[x]
        near = np.flatnonzero(near)
        near = near[np.bitwise_count(prints[near] ^ prints[x]).sum(axis=1) <= radius]
        while len(near):
            j, near = near[0], near[1:]
            if similarity(sets[j], sets[x]) >= threshold - 1e-12:
                a, b = sorted((of[j], of[x]))
                of[of == b] = a
                near = near[of[near] != of[x]]
    return of


_GROUP = "component long, lo int, hi int, side int, node long, label long, fp binary, members binary"


def _verify(radius: int, threshold: float):
    """Rows of _GROUP, sorted by group: an edge from each member to the member that it is joined to."""

    def group(rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: (r[3], r[4]))
        node, label, side = (np.array([r[k] for r in rows]) for k in (4, 5, 3))
        prints = np.frombuffer(b"".join(r[6] for r in rows), "<u8").reshape(len(rows), -1)
        of = linked([np.frombuffer(r[7], "<u8") for r in rows], prints, label, side if rows[0][1] != rows[0][2] else None, radius, threshold)
        moved = np.flatnonzero(of != np.arange(len(rows)))
        return pa.record_batch([pa.array(node[moved], pa.int64()), pa.array(node[of[moved]], pa.int64())], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for row in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                    if held and row[:3] != held[0][:3]:
                        yield group(held)
                        held = []
                    held.append(row)
        if held:
            yield group(held)

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                sets = [shingles(x, size) for x in utf8(b.column(0).slice(at, 64))]
                yield pa.record_batch([pa.array([set_key(h) for h in sets], pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary())], ["node", "members"])

    return run


def exact_components(groups: DataFrame, texts: DataFrame, radius: int, threshold: float = THRESHOLD, size: int = SHINGLE, chunk: int = CHUNK) -> DataFrame:
    """``groups(node, component, fp)`` and ``texts(text)`` -> ``(node, component)`` by exact similarity, roots left out.

    A node is the ``set_key`` of a text's shingles; any text that has it will do, and others are passed over. Links are searched within the given components only. Components of more than one chunk are compared in three steps:
    chunk by chunk; the first member of each part that was found, among one another; and what is still apart. In the last
    step a component's largest part is not compared with itself, so each of its members is sent once for each chunk of
    members outside it: groups of copies cost in proportion to their size. No pair that might join two parts is left out.
    """
    sets = texts.mapInArrow(_sets(size), "node long, members binary").groupBy("node").agg(F.first("members").alias("members"))
    whole = checkpoint(sets.join(sent_if_small(groups), "node").withColumn("bytes", F.octet_length("members").cast("long")))
    chunks = lambda n, size: F.greatest(F.ceil(n / chunk), F.ceil(size / CHUNK_BYTES)).cast("int")
    count = lambda rows: rows.groupBy("component").agg(chunks(F.count("*"), F.sum("bytes")).alias("g"))
    large = checkpoint(count(whole).where("g > 1"))

    def compared(rows: DataFrame) -> DataFrame:
        rows = rows.select(*[c.split()[0] for c in _GROUP.split(", ")])
        return checkpoint(rows.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi").mapInArrow(_verify(radius, threshold), "u long, v long"))

    def dealt(rows: DataFrame, by: DataFrame, seed: int) -> DataFrame:
        c = F.pmod(F.xxhash64("node", F.lit(seed)), F.coalesce("g", F.lit(1))).cast("int")
        return compared(rows.join(sent_if_small(by), "component", "left").select("component", c.alias("lo"), c.alias("hi"), c.alias("side"), "node", F.col("node").alias("label"), "fp", "members"))

    links = dealt(whole, large, 1)
    if large.isEmpty():
        return connected_components(links)
    wide = whole.join(sent_if_small(large.select("component")), "component", "left_semi")
    heads = wide.join(sent_if_small(links.select(F.col("u").alias("node"))), "node", "left_anti")
    upper = dealt(heads, checkpoint(count(heads.drop("members"))), 2)
    # both steps name a member's first one, so two lookups give its part
    parts = wide.select("node", "component", "bytes").join(links.select(F.col("u").alias("node"), F.col("v").alias("head")), "node", "left").withColumn("head", F.coalesce("head", "node"))
    parts = parts.join(upper.select(F.col("u").alias("head"), F.col("v").alias("label")), "head", "left")
    parts = checkpoint(parts.select("node", "component", "bytes", F.coalesce("label", "head").alias("label")))
    links = links.unionAll(upper)
    sizes = parts.groupBy("component", "label").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    main = sizes.groupBy("component").agg(F.max_by(F.struct("label", "n", "bytes"), F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).where("n > main.n")
    main = main.select("component", "main.label", chunks(F.col("n") - F.col("main.n"), F.col("bytes") - F.col("main.bytes")).alias("few"), chunks(F.col("main.n"), F.col("main.bytes")).alias("many")).withColumnRenamed("label", "main")
    x = wide.join(sent_if_small(parts.select("node", "label")), "node").join(sent_if_small(checkpoint(main)), "component")
    h = F.xxhash64("node", F.lit(3))
    x = x.withColumn("side", F.when(F.col("label") != F.col("main"), F.pmod(h, "few")).otherwise(F.col("few") + F.pmod(h, "many")).cast("int"))
    x = x.withColumn("o", F.explode(F.sequence(F.lit(0), F.when(F.col("label") != F.col("main"), F.col("few") + F.col("many") - 1).otherwise(F.col("few") - 1))))
    return connected_components(links.unionAll(compared(x.withColumn("lo", F.least("side", "o")).withColumn("hi", F.greatest("side", "o")))))
