"""SimHash near-duplicates: fingerprints, bit-sliced comparison within pigeonhole blocks, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations, repeat
from math import acos, ceil, comb, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, sent_if_small, shuffles_dropped, table, union_roots, utf8, whole_groups
from .components import connected_components
from .jaccard import exact_components, set_key, shingles

SEED, SHINGLE, RADIUS, BITS = 42, 4, 4, 64
#: Members of a block that one task compares at once; larger blocks are split into pairs of chunks.
CHUNK = 1024
#: Distinct fingerprints that blocks of one table may hold on average, by which keys are made longer.
SPREAD = 1024
#: Bits of the fingerprints that name pairs for an exact check of similarity. Texts that have nothing in common come within
#: the radius by chance: of 128 bits 4 pairs in 10^7, so that a few million texts hang together; of 192 bits 4 in 10^12.
WIDE = 192
#: Masks whose keys lie on disk at once, in the first round of a search and in every other.
FIRST_ROUND, ROUND = 4, 16
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """SimHash of the text's word shingles, repeats included; 0 without words. bytes.lower() and split() know ASCII only."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    cut = [joined[a : b - 1] for a, b in zip(starts, ends[size - 1 :])]  # noqa: B905
    h = np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(SEED)), "<u8", len(cut))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.fromiter((fingerprint(x) for x in utf8(b.column(1))), np.uint64, b.num_rows).view(np.int64)
        yield pa.record_batch([b.column(0), pa.array(fp)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)`` with the fingerprint's 64 bits in a long."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def _sum3(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: bitwise sum and carry of three words."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def bit_sliced_links(fp: np.ndarray, group: np.ndarray, radius: int = RADIUS, most: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j of one group (groups are contiguous) whose fingerprints differ in at most ``radius`` bits.

    ``fp`` has a row of 64-bit words for each member. A group's fingerprints lie vertically: word w of plane b holds bit
    b of 64 members. A query is compared with a word's 64 members at once: its bit, spread over a word, is xored with the
    plane. Eight planes at a time go through carry-save adders into bitwise counters, and words of which all 64 counters
    have passed the radius are abandoned.
    """
    n = len(fp)
    fp = fp.view(np.uint64).reshape(n, -1) if n else np.zeros((0, 1), np.uint64)
    bits = 64 * fp.shape[1]
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, int)
    size = np.diff(np.r_[first, n])
    words = -(-size // 64)
    word0 = np.r_[0, np.cumsum(words)]
    which = np.repeat(np.arange(len(first)), size)
    rank = np.arange(n) - first[which]
    lane = np.zeros((word0[-1], 64, fp.shape[1]), np.uint64)
    lane[word0[which] + rank // 64, rank % 64] = fp
    planes = np.empty((bits, word0[-1]), np.uint64)
    for b in range(bits):
        planes[b] = np.packbits(((lane[:, :, b // 64] >> np.uint64(b % 64)) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little").view("<u8").ravel()
    del lane
    high = max(1, radius.bit_length() - 3) + 1  # counters above the three low ones
    pairs = words[which] - rank // 64  # words from the query's own one on
    found: list[tuple[np.ndarray, np.ndarray]] = []
    at = 0
    total = np.cumsum(pairs)
    while at < n:
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        k = pairs[at:to]
        q = np.repeat(np.arange(at, to), k)
        step = np.arange(len(q)) - np.repeat(np.cumsum(k) - k, k)
        w = word0[which[q]] + rank[q] // 64 + step
        left = size[which[q]] - 64 * (w - word0[which[q]])  # members in the word, 64 at most
        alive = np.where(left >= 64, _ONES, (np.uint64(1) << np.minimum(left, 63).astype(np.uint64)) - np.uint64(1))
        own = (rank[q] % 64).astype(np.uint64)
        alive &= np.where(step == 0, ~((np.uint64(2) << own) - np.uint64(1)), _ONES)
        count = [np.zeros(len(q), np.uint64) for _ in range(3 + high)]
        over = np.zeros(len(q), np.uint64)
        for b in range(0, bits, 8):
            mine = fp[q, b // 64] >> np.uint64(b % 64)
            d = [planes[b + i][w] ^ (np.uint64(0) - ((mine >> np.uint64(i)) & np.uint64(1))) for i in range(8)]
            ones, twos, fours = count[:3]
            ones, t1 = _sum3(ones, d[0], d[1])
            ones, t2 = _sum3(ones, d[2], d[3])
            twos, f1 = _sum3(twos, t1, t2)
            ones, t1 = _sum3(ones, d[4], d[5])
            ones, t2 = _sum3(ones, d[6], d[7])
            twos, f2 = _sum3(twos, t1, t2)
            fours, carry = _sum3(fours, f1, f2)
            count[:3] = ones, twos, fours
            for i in range(3, 3 + high):
                count[i], carry = count[i] ^ carry, count[i] & carry
            over |= carry
            if b + 8 > radius:
                above, same = np.zeros(len(q), np.uint64), np.full(len(q), _ONES)
                for i in reversed(range(3 + high)):
                    if radius >> i & 1:
                        same &= count[i]
                    else:
                        above |= same & count[i]
                        same &= ~count[i]
                alive &= ~(over | above)
                keep = np.flatnonzero(alive)
                if len(keep) < 0.75 * len(q):
                    q, w, alive, over, count = q[keep], w[keep], alive[keep], over[keep], [c[keep] for c in count]
                if not len(q):
                    break
        if len(q):
            hit = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            i, lane_no = np.nonzero(hit)
            found.append((q[i], first[which[q[i]]] + 64 * (w[i] - word0[which[q[i]]]) + lane_no))
        at = to
    if not found:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _compare(radius: int):
    """Blocks of a partition, sorted by (key, lo, hi): edges from members to the smallest member they reach in their block."""

    def links(t: pa.Table) -> pa.RecordBatch:
        key, lo, hi, rep = (t.column(i).to_numpy() for i in (0, 1, 2, 4))
        fp = np.frombuffer(b"".join(t.column(3).to_pylist()), "<u8").reshape(len(rep), -1)
        order = np.lexsort((rep, hi, lo, key))
        key, lo, hi, rep, fp = key[order], lo[order], hi[order], rep[order], fp[order]
        group = np.cumsum(np.r_[0, (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
        root = union_roots(len(rep), *bit_sliced_links(fp, group, radius))
        moved = np.flatnonzero(root != np.arange(len(rep)))
        return pa.record_batch([pa.array(rep[moved]), pa.array(rep[root[moved]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 3, 8192):
            yield links(t)

    return run


def block_widths(blocks: int) -> list[tuple[int, int]]:
    """(shift, width) of each of so many nearly equal blocks of the 64 bits."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]  # noqa: B905


def pigeonhole_masks(radius: int, n: int, bits: int = BITS) -> list[list[int]]:
    """Bit sets, of which fingerprints that differ in at most ``radius`` of 64 bits agree on at least one.

    Of radius + k blocks at least k agree, so each choice of k blocks is a key. k grows with the number of fingerprints,
    so that blocks of one key hold some SPREAD of them.
    """
    k = 1
    while k < 4 and bits * k // (radius + k) < log2(max(2, n / SPREAD)):
        k += 1
    blocks = block_widths(radius + k)
    return [[p for i in chosen for p in range(blocks[i][0], sum(blocks[i]))] for chosen in combinations(range(radius + k), k)]


def disagreement(threshold: float) -> float:
    """Chance that a bit differs between sets of that Jaccard similarity (of one size: the angle between them over pi)."""
    return acos(2 * threshold / (1 + threshold)) / pi


def wide_radius(threshold: float, bits: int = WIDE) -> int:
    """So many bits that four deviations above the mean distance at the threshold are within."""
    p = disagreement(threshold)
    return ceil(bits * p + 4 * sqrt(bits * p * (1 - p)))


def sampled_masks(threshold: float, n: int, bits: int = WIDE, miss: float = 0.01) -> list[list[int]]:
    """Random bit sets as keys: a pair two deviations farther apart than the mean at the threshold misses all by ``miss``."""
    width = min(28, max(7, ceil(log2(max(2, n / (SPREAD / 2))))))
    p = disagreement(threshold)
    far = ceil(bits * p + 2 * sqrt(bits * p * (1 - p)))
    agree = comb(bits - far, width) / comb(bits, width)
    rng = np.random.default_rng(SEED)
    return [sorted(rng.choice(bits, width, replace=False).tolist()) for _ in range(ceil(log(miss) / log(1 - agree)))]


def _keyed(masks: list[list[int]]):
    """``(node, fp)`` -> a row for each mask: a key of the fingerprint's bits in it, which no other mask's keys equal but by chance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if pa.types.is_integer(b.column(1).type):
                fp = b.column(1).to_numpy().view("<u8").reshape(-1, 1)
                raw = pa.array([x.tobytes() for x in fp], pa.binary())
            else:
                raw = b.column(1)
                fp = np.frombuffer(b"".join(raw.to_pylist()), "<u8").reshape(b.num_rows, -1)
            for i, mask in enumerate(masks):
                key = np.zeros(b.num_rows, np.uint64)
                for j, p in enumerate(mask):
                    key |= ((fp[:, p // 64] >> np.uint64(p % 64)) & np.uint64(1)) << np.uint64(j)
                yield pa.record_batch([pa.array((key ^ np.uint64(i << 48)).view(np.int64)), raw, b.column(0)], ["key", "fp", "node"])

    return run


def simhash_edges(distinct: DataFrame, masks: list[list[int]], radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """``distinct(node long, fp)`` (fp a long or binary) -> star edges ``(u, v)`` that join all pairs within ``radius`` that agree on a mask.

    Blocks over ``chunk`` members are split by a hash, and every pair of chunks meets in a task of its own.
    """
    rows = distinct.select("node", "fp").mapInArrow(_keyed(masks), "key long, fp binary, node long")
    hot = rows.groupBy("key").count().where(F.col("count") > chunk).select(F.col("key").alias("block"), F.ceil(F.col("count") / chunk).cast("int").alias("g"))
    hot = checkpoint(hot.unionAll(hot.sparkSession.range(1).select(F.lit(-1).cast("long"), F.lit(1))))  # no mask's keys are below 0
    rows = rows.join(sent_if_small(hot), F.col("key") == F.col("block"), "left").withColumn("c", F.when(F.col("g").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp"), "g")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("g") - 1, F.lit(0)))))
    rows = rows.select("key", F.least("c", "o").alias("lo"), F.greatest("c", "o").alias("hi"), "fp", "node")
    return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(_compare(radius), "u long, v long")


def candidate_components(known: DataFrame, masks: list[list[int]], radius: int, first: int = FIRST_ROUND, most: int = ROUND) -> DataFrame:
    """``known(node, fp)`` and more -> the same rows with ``component``, the smallest node that links join them to.

    The masks are taken a few a round, so disk holds the keys of one round whatever their number. Rows carry the component
    that earlier rounds have found: a large group of near copies is linked in the first round and by its name from then on.
    """
    now = known.withColumn("component", F.col("node"))
    at = 0
    while at < len(masks):
        to = at + (most if at else first)
        found = connected_components(simhash_edges(now.select(F.col("component").alias("node"), "fp"), masks[at:to], radius))
        found = sent_if_small(found.select(F.col("node").alias("component"), F.col("component").alias("joined")))
        now = checkpoint(now.join(found, "component", "left").withColumn("component", F.coalesce("joined", "component")).select(*known.columns, "component"))
        at = to
    return now


def simhash_components(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row of ``docs(doc_id, text)``.

    Links join fingerprints of at most RADIUS differing bits; component_id is the smallest doc_id reachable. A null or
    empty text has fingerprint 0 and is linked like any other; repeated rows stay; a row whose doc_id is null gets
    the component of its fingerprint, null if no row with a doc_id has that fingerprint. Copies are collapsed before
    they are compared, so a large group of them is one row of the search. No link is lost (pigeonhole).
    """
    prints = checkpoint(fingerprints(docs))
    distinct = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    known = distinct.where("rep is not null").select(F.col("fp").alias("node"), "fp", "rep")
    found = connected_components(simhash_edges(known, pigeonhole_masks(RADIUS, known.count())))
    return prints.join(_least(known, found).withColumnRenamed("node", "fp"), "fp", "left").select("doc_id", "fp", "component_id")


def _least(known: DataFrame, found: DataFrame) -> DataFrame:
    """``known(node, rep)`` and ``found(node, component)`` -> ``(node, component_id)``: the least rep of each node's component."""
    of = known.join(found, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))
    least = of.join(found.select("component").distinct(), "component").groupBy("component").agg(F.min("rep").alias("least"))
    return of.join(least, "component", "left").select("node", F.coalesce("least", "rep").alias("component_id"))


def wide_fingerprint(h: np.ndarray, bits: int = WIDE) -> bytes:
    """SimHash of a set of 64-bit hashes in ``bits`` bits: every further word of bits takes the hashes mixed once more."""
    out = np.zeros(bits // 8, np.uint8)
    for word in range(bits // 64):
        if word:
            h = h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(word)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), 1 << 15):
            ones += np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[8 * word : 8 * word + 8] = np.packbits(2 * ones > len(h), bitorder="little")
    return out.tobytes()


def _wide_prints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, prints = [], []
            for x in utf8(b.column(1)):
                h = shingles(x, size)
                keys.append(set_key(h))
                prints.append(wide_fingerprint(h))
            yield pa.record_batch([b.column(0), pa.array(keys, pa.int64()), pa.array(prints, pa.binary())], ["doc_id", "key", "fp"])

    return run


def near_copies(docs: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """``(doc_id, component_id)`` of every row of ``docs(doc_id, text)``: groups of texts that are alike by word shingles.

    Links join texts whose sets of ``size``-word shingles have a Jaccard similarity of at least ``threshold``. SimHash
    fingerprints of WIDE bits name the candidates: those that agree on a sampled key and differ in at most
    ``wide_radius`` bits; their sets are compared exactly. component_id is the smallest doc_id reachable. Words are cut
    at ASCII white space, without case; a text of up to ``size`` words is one shingle, and texts without words are equal.
    Equal sets are collapsed before anything is compared. A row whose doc_id is null gets the component of its set, null
    if no row with a doc_id has that set; repeated rows stay; an empty table gives none.
    """
    with shuffles_dropped(docs.sparkSession):
        prints = checkpoint(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_wide_prints(size), "doc_id long, key long, fp binary"))
        distinct = checkpoint(prints.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("fp").alias("fp")))
        known = distinct.where("rep is not null").select(F.col("key").alias("node"), "fp", "rep")
        radius = wide_radius(threshold)
        near = candidate_components(known, sampled_masks(threshold, known.count()), radius)
        joined = checkpoint(near.where("node <> component").select("component").distinct())
        groups = checkpoint(near.join(sent_if_small(joined), "component", "left_semi"))
        reps = checkpoint(groups.select("rep").distinct())
        texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(sent_if_small(reps), "rep", "left_semi")
        found = exact_components(groups.select("node", "component", "fp"), texts.select("text"), radius, threshold, size)
    return prints.join(_least(known, found).withColumnRenamed("node", "key"), "key", "left").select("doc_id", "component_id")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
