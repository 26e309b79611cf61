"""Modified Kneser-Ney model over words: counts by shards, values of n-grams, a join of each document's n-grams with them.

Interpolated bigrams back off to continuation counts, and these to the spelling of a word under the classes of characters
of ``spelling``, so unseen words have a chance too. Everything the model says about a text is a sum of one value for each
of its words and pairs, 0 for what is not in the table: a pair's value is what it adds to its back-off. So documents send
the keys of their n-grams to the shards of the table, and get sums back; only n-grams that are frequent in trusted text are
known where texts are read. Values are whole numbers in steps of 1 / SCALE of a power of ten: sums do not depend on order.

Keys of pairs are 64-bit hashes, of which a shard compares 48 bits beside its own number.
"""

from __future__ import annotations

import hashlib
import struct
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import removed, shuffle_partitions, shuffles_dropped, slices, stored, utf8
from .spelling import REPEATED, SCALE, codes, discounts, table_of

#: Neither is a word of a text: the end is spelled as nothing, the begin is never asked for its chance.
BEGIN, END = b" ", b""
REPEAT = REPEATED.encode()
#: N-grams that every task knows, rows of the table to a shard, bytes of trusted text to a shard of counts, bytes of text counted and asked about at once.
KNOWN, SHARD_ROWS, SHARD_BYTES, COUNTED, SLICE = 500_000, 1_000_000, 8 << 20, 4 << 20, 2 << 20
#: Parts of the texts, one after the other: only one part's questions are on disk.
PARTS = 3
#: Parts of the pairs, one after the other: only one part's shuffle to its second words is on disk.
VALUE_PARTS = 2
_P = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def tokens(texts: list[bytes], mark: bool = False) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, first BEGIN, END and REPEAT; the number of each token, BEGIN and END around every text; its document.

    With ``mark``, a word equal to the one before becomes REPEAT, which training never sees.
    """
    of = defaultdict(count(3).__next__, {BEGIN: 0, END: 1, REPEAT: 2})
    out = []
    for t in texts:
        w = t.lower().split()
        x = np.zeros(len(w) + 2, np.int32)
        x[1:-1] = np.fromiter(map(of.__getitem__, w), np.int32, len(w))
        x[-1] = 1
        if mark:
            x[1:][x[1:] == x[:-1].copy()] = 2
        out.append(x)
    return list(of), np.concatenate(out), np.repeat(np.arange(len(out)), [len(x) for x in out])


def word_keys(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, 7) for w in words), np.uint64, len(words))


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """What Spark's ``xxhash64`` gives for two longs: XXH64 of each, the first one's seeded with 42, its hash the next one's seed."""
    turned = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    h = np.full(len(before), 42, np.uint64)
    for x in (before, word):
        h = (h + _P[4] + np.uint64(8)) ^ turned(x * _P[1], 31) * _P[0]
        h = turned(h, 27) * _P[0] + _P[3]
        h = (h ^ (h >> np.uint64(33))) * _P[1]
        h = (h ^ (h >> np.uint64(29))) * _P[2]
        h ^= h >> np.uint64(32)
    return h


def spelled(table: np.ndarray, words: list[bytes]) -> np.ndarray:
    """-log10 of each word's spelling with the space after it, in steps of 1 / SCALE."""
    words = [b"" if w == BEGIN else w for w in words[:1]] + words[1:]
    joined = b"   ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    try:
        text = joined.decode("utf-8")
    except UnicodeDecodeError:
        return spelled(table, [w.decode("utf-8", "replace").encode() for w in words])
    if len(text) < len(joined):  # characters: bytes that do not continue one
        begun = np.r_[0, np.cumsum((np.frombuffer(joined, np.uint8) & 0xC0) != 0x80)]
        at = np.cumsum(size + 3) - size - 3
        size = begun[at + size] - begun[at]
    total = np.concatenate([[0], np.cumsum(table[codes(text, False)], dtype=np.int64)])
    at = np.cumsum(size + 3) - size - 3
    return np.minimum(total[at + size + 1] - total[at], 2**31 - 1)


def _runs(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new run of equal keys begins."""
    new = np.zeros(len(sorted_keys[0]), bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _planes(x: np.ndarray, width: int = 8) -> bytes:
    """The low ``width`` bytes of numbers, byte by byte, so that the high ones compress."""
    x = np.ascontiguousarray(x, x.dtype.newbyteorder("<"))
    return x.view(np.uint8).reshape(len(x), x.dtype.itemsize)[:, :width].T.tobytes()


def _from_planes(data: bytes, kind: str, width: int = 8) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], np.dtype(kind).itemsize), np.uint8)
    out[:, :width] = raw.T
    return out.reshape(-1).view(kind)


def _packed(*parts: bytes) -> bytes:
    return b"".join(struct.pack("<Q", len(p)) + p for p in parts)


def _unpacked(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        (n,) = struct.unpack_from("<Q", data, at)
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard.astype(np.int16) if shard.max(initial=0) < 32768 else shard, kind="stable")
    for part in np.split(order, _runs(shard[order])[1:]) if len(order) else ():
        yield int(shard[part[0]]), part


# -- counts ----------------------------------------------------------------------------------------------------------------


def _word_rows(held: Broadcast):
    """A slice's words: key, spelling, tokens, and documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _joined(batches, 0, COUNTED):
            words, x, doc = tokens(utf8(batch.column(0)))
            n = np.bincount(x, minlength=len(words))
            held_by = np.sort(doc * len(words) + x)
            docs = np.bincount(held_by[_runs(held_by)] % len(words), minlength=len(words))
            yield pa.record_batch([pa.array(word_keys(words).view(np.int64)), pa.array(spelled(table_of(held), words)), pa.array(n), pa.array(docs)], ["w", "base", "n", "docs"]).filter(pa.array(n > 0))

    return run


def _joined(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.Table]:
    """Batches put together to slices of about ``most`` bytes of text."""
    held, size = [], 0
    for batch in batches:
        for b in slices(batch, column, most):
            held.append(b)
            size += b.nbytes
            if size >= most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks()


def _pair_blobs(shards: int):
    """A slice's pairs, to shards by the first word: both words, how often, and whether more than one document holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _joined(batches, 0, COUNTED):
            words, x, doc = tokens(utf8(batch.column(0)))
            at = np.flatnonzero(x[1:] != 0)
            pair, docs = x[at].astype(np.int64) * len(words) + x[at + 1], doc[-1] + 1
            found = np.sort(pair * docs + doc[at])  # below 2^63: a slice's words and documents are few, as it has some megabytes
            pair, doc = np.divmod(found, docs)
            head = _runs(pair)
            n = np.diff(np.r_[head, len(pair)])
            many = doc[head] != doc[head + n - 1]
            key, pair = word_keys(words), pair[head]
            u, w = key[pair // len(words)], key[pair % len(words)]
            order = np.lexsort((w, u))
            u, w, n, many = u[order], w[order], n[order], many[order]
            found = [(s, _packed(u[k].tobytes(), w[k].tobytes(), _planes(n[k]), many[k].tobytes())) for s, k in _by_shard((u % np.uint64(shards)).astype(np.int64))]
            yield pa.record_batch([pa.array([s for s, _ in found], pa.int32()), pa.array([d for _, d in found], pa.binary())], ["shard", "data"])

    return run


PAIRS = "kind int, u long, w long, n long, one boolean, n1 long, n2 long, n3 long"


def _merge_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a shard's pairs (kind 2) and of first words (kind 1: w, n its tokens), with the numbers of a first word's
    pairs that are found once, twice and more often. Rows arrive sorted by shard; what is held are distinct pairs."""
    names = [c.split()[0] for c in PAIRS.split(", ")]

    def merged(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        u, w, n, many = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((w, u))
        u, w, n, many = u[order], w[order], n[order], many[order]
        head = _runs(u, w)
        return u[head], w[head], np.add.reduceat(n, head), np.logical_or.reduceat(many, head) | (np.diff(np.r_[head, len(u)]) > 1)

    def rows(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        u, w, n, many = merged(held)
        head = _runs(u)
        c = [np.add.reduceat(x.astype(np.int64), head) for x in (n == 1, n == 2, n > 2)]
        size = np.diff(np.r_[head, len(u)])
        as_long = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64))
        every = [np.repeat(x, size) for x in c]
        for at in range(0, len(u), 200_000):
            k = slice(at, at + 200_000)
            yield pa.record_batch([pa.array(np.full(len(u[k]), 2, np.int32)), as_long(u[k]), as_long(w[k]), pa.array(n[k]), pa.array(~many[k]), *(pa.array(x[k]) for x in every)], names)
        yield pa.record_batch([pa.array(np.ones(len(head), np.int32)), as_long(u[head]), as_long(u[head]), pa.array(np.add.reduceat(n, head)), pa.nulls(len(head), pa.bool_()), *map(pa.array, c)], names)

    last, held, size, least = None, [], 0, 1_000_000
    for b in batches:
        for shard, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if shard != last and held:
                yield from rows(held)
                held, size, least = [], 0, 1_000_000
            last = shard
            u, w, n, many = _unpacked(data)
            held.append((np.frombuffer(u, "<u8"), np.frombuffer(w, "<u8"), _from_planes(n, "<i8"), np.frombuffer(many, bool)))
            size += len(held[-1][0])
            if size > least:
                held = [merged(held)]
                size = len(held[0][0])
                least = max(least, 2 * size)
    if held:
        yield from rows(held)


def _left(n: Column, d: list[float]) -> Column:
    """A count less its discount."""
    return n - F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])


def train(trusted: DataFrame, held: Broadcast) -> tuple[DataFrame, int]:
    """``(key, n, v, one)`` for words and pairs of ``trusted(text)``, and the value of a back-off to the spelling.

    ``one``: a single document holds it. Every trusted text counts in full. ``trusted`` is a stored table, removed once counted.
    """
    spark = trusted.sparkSession
    most = shuffle_partitions(spark)
    shards = max(most, (trusted.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES)
    steps = lambda c: F.round(c * SCALE).cast("long")
    count = lambda n, k: F.count_if(n == k).alias(f"c{k}")
    with shuffles_dropped(spark):
        pairs = stored(trusted.mapInArrow(_pair_blobs(shards), "shard int, data binary").repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_merge_pairs, PAIRS), "pairs")
        own = stored(trusted.mapInArrow(_word_rows(held), "w long, base long, n long, docs long").groupBy("w").agg(F.first("base").alias("base"), F.sum("n").alias("n"), (F.sum("docs") < 2).alias("one")), "own")
        removed(trusted)
        two, first = pairs.where("kind = 2"), pairs.where("kind = 1")
        row = two.agg(F.count("*").alias("c"), *[count(F.col("n"), k) for k in (1, 2, 3, 4)]).first()
        d2, total = discounts([row[f"c{k}"] for k in (1, 2, 3, 4)]), row["c"]
        freed = F.col("n1") * d2[0] + F.col("n2") * d2[1] + F.col("n3") * d2[2]
        seen = two.groupBy("w").agg(F.count("*").alias("c"))
        words = stored(own.join(seen, "w", "left").join(first.select("w", F.log10(freed / F.col("n")).alias("back")), "w", "left"), "words")
        removed(own)
        row = words.agg(*[count(F.col("c"), k) for k in (1, 2, 3, 4)], F.count_if(F.col("c") > 2).alias("more")).first()
        d1 = discounts([row[f"c{k}"] for k in (1, 2, 3, 4)])
        share = (row["c1"] * d1[0] + row["c2"] * d1[1] + row["more"] * d1[2]) / total
        chance = _left(F.col("c"), d1) / total + F.pow(F.lit(10.0), -F.col("base") / SCALE) * share
        added = F.when(F.col("c") > 0, F.log10(chance) - float(np.log10(share)) + F.col("base") / SCALE).otherwise(0.0)
        singles = words.select(F.col("w").alias("key"), "n", steps(added + F.coalesce("back", F.lit(0.0))).alias("v"), "one")
        ratio = (_left(F.col("n"), d2) / freed).cast("float")
        v = steps(F.log10(1 + F.abs("r").cast("double") / F.col("p")))
        table = stored(singles, "values")
        for part in range(VALUE_PARTS):
            mine = F.pmod("w", F.lit(VALUE_PARTS)) == part
            # A pair's row in the shuffle: both words, its count, and the ratio, below 0 where a single document holds it.
            more = two.where(mine).select("u", "w", "n", F.when(F.col("one"), -ratio).otherwise(ratio).alias("r")).join(words.where(mine & (F.col("c") > 0)).select("w", chance.cast("float").alias("p")), "w")
            table = table.unionAll(stored(more.select(F.xxhash64("u", "w").alias("key"), "n", v.alias("v"), (F.col("r") < 0).alias("one")), "values"))
    removed(pairs, words)
    return table, round(float(np.log10(share)) * SCALE)


# -- scores ----------------------------------------------------------------------------------------------------------------

_SENT = "shard int, kind int, slice long, data binary"
TABLE, ASKED, OWN = 0, 1, 2


def _sent(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.record_batch([pa.array(x, k) for x, k in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["shard", "kind", "slice", "data"])


def _table_blobs(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            key, v, one = (np.concatenate(x) for x in zip(*held, strict=True))
            return _sent([(s, TABLE, 0, _packed(_planes(key[k] >> np.uint64(16), 6), _planes(v[k]), one[k].tobytes())) for s, k in _by_shard((key % np.uint64(shards)).astype(np.int64))])

        held, size = [], 0
        for b in batches:
            held.append((b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False).astype(bool)))
            size += b.num_rows
            if size >= 200_000:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return run


def _found(known: tuple[np.ndarray, ...], key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether the sorted table holds each key, its value, and the value if a single document holds it; 0 otherwise."""
    keys, v, one = known
    if not len(keys):
        return np.zeros(len(key), bool), np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    hit = keys[at] == key
    v = np.where(hit, v[at], 0)
    return hit, v, np.where(one[at], v, 0)


def _sums(doc: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, v, n).astype(np.int64)  # whole numbers below 2^53


def _asked(known: Broadcast, letters: Broadcast, unseen: int, shards: int):
    """What a slice's own task knows of its texts (their keys, tokens and sums), and the n-grams that it asks shards for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _joined(batches, 1, SLICE):
            ids, texts = batch.column(0).to_numpy(), utf8(batch.column(1))
            words, x, doc = tokens(texts, True)
            key, n = word_keys(words), len(texts)
            spelling = spelled(table_of(letters), words)
            spelling[0] = unseen
            own = _sums(doc, (unseen - spelling)[x], n)
            hit, v, alone = _found(known.value, key)
            at = np.flatnonzero(x[1:] != 0)
            pair = pair_keys(key[x[at]], key[x[at + 1]])
            both = np.flatnonzero(hit[x[at]] & hit[x[at + 1]])  # a pair is as frequent as its words at most
            hit2, v2, alone2 = (np.zeros(len(pair), k) for k in (bool, np.int64, np.int64))
            hit2[both], v2[both], alone2[both] = _found(known.value, pair[both])
            own = own + _sums(doc, v[x], n) + _sums(doc[at], v2, n)
            alone = _sums(doc, alone[x], n) + _sums(doc[at], alone2, n)
            asked, hit = np.concatenate([key[x], pair]), np.concatenate([hit[x], hit2])
            doc = np.concatenate([doc, doc[at]])
            size = np.bincount(doc[: len(x)], minlength=n) - 1
            data = _packed(*map(_planes, (ids, size, own, alone)))
            name = int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)
            out = [(name % shards, OWN, name, data)]
            asked, doc = asked[~hit], doc[~hit]
            order = np.argsort(doc, kind="stable")
            asked, doc = asked[order], doc[order]
            for s, k in _by_shard((asked % np.uint64(shards)).astype(np.int64)):
                out.append((s, ASKED, name, _packed(_planes(asked[k] >> np.uint64(16), 6), _planes(np.bincount(doc[k], minlength=n)))))
            yield _sent(out)

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's table comes first; then each slice's questions become sums by document, and own figures pass."""
    last, parts, known = None, [], None
    for b in batches:
        out = []
        for shard, kind, name, data in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if shard != last:
                last, parts, known = shard, [], None
            if kind == TABLE:
                key, v, one = _unpacked(data)
                parts.append((_from_planes(key, "<u8", 6), _from_planes(v, "<i8").astype(np.int32), np.frombuffer(one, bool)))
                continue
            if kind == OWN:
                out.append((0, OWN, name, data))
                continue
            if known is None:
                key, v, one = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, bool))
                order = np.argsort(key)
                known, parts = (key[order], v[order], one[order]), []
            key, size = _unpacked(data)
            size = _from_planes(size, "<i8")
            doc = np.repeat(np.arange(len(size)), size)
            _, v, alone = _found(known, _from_planes(key, "<u8", 6))
            out.append((0, ASKED, name, _packed(_planes(_sums(doc, v, len(size))), _planes(_sums(doc, alone, len(size))))))
        if out:
            yield _sent(out)


SCORES = "key long, n long, v long, alone long"


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A slice's own figures and all answers to it. Slices with equal texts share a name, and their answers."""

    def done(own: list[bytes], sums: list[np.ndarray]) -> pa.RecordBatch:
        ids, size, v, alone = (_from_planes(x, "<i8") for x in _unpacked(own[0]))
        if len(sums):
            v, alone = v + sums[0] // len(own), alone + sums[1] // len(own)
        return pa.record_batch([pa.array(x) for x in (ids, size, v, alone)], ["key", "n", "v", "alone"])

    last, own, sums = None, [], []
    for b in batches:
        for name, kind, data in zip(*(b.column(i).to_pylist() for i in (2, 1, 3)), strict=True):
            if name != last and own:
                yield done(own, sums)
                own, sums = [], []
            last = name
            if kind == OWN:
                own.append(data)
            else:
                x = [_from_planes(p, "<i8") for p in _unpacked(data)]
                sums = [a + b for a, b in zip(sums, x, strict=True)] if sums else x
    if own:
        yield done(own, sums)


def score(texts: DataFrame, table: DataFrame, unseen: int, letters: Broadcast) -> DataFrame:
    """``(key, n, v, alone)`` for each key of ``texts(key, text)``: tokens with the end, log10 of the chance in steps of
    1 / SCALE, and the part of it that is due to n-grams which a single trusted document holds.

    ``table`` is removed once its rows lie packed by shards, as each part of the texts meets them."""
    spark = texts.sparkSession
    by_count = [tuple(r) for r in table.groupBy(F.least("n", F.lit(1 << 20)).alias("n")).count().orderBy(F.desc("n")).collect()]
    rows, least = 0, None
    for n, c in by_count:
        if rows + c > KNOWN:
            break
        rows, least = rows + c, n
    top = table.where(F.col("n") >= least if least else F.lit(False)).select("key", "v", "one").toArrow()  # at most KNOWN rows; no objects of their values
    key = top.column("key").to_numpy().view(np.uint64)
    order = np.argsort(key)
    known = spark.sparkContext.broadcast((key[order], top.column("v").to_numpy()[order], top.column("one").to_numpy()[order]))
    del top, key, order
    shards = max(8, sum(c for _, c in by_count) // SHARD_ROWS)
    rest = table.where(F.col("n") < least if least else F.lit(True)).select("key", "v", "one")
    rest = stored(rest.mapInArrow(_table_blobs(shards), _SENT), "packed")
    removed(table)
    scores = None
    for part in range(PARTS):
        asked = texts.where(F.pmod("key", F.lit(PARTS)) == part).select("key", "text").mapInArrow(_asked(known, letters, unseen, shards), _SENT)
        answers = asked.unionAll(rest).repartition(shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(_answers, _SENT)
        found = answers.repartition(shards, "slice").sortWithinPartitions("slice").mapInArrow(_sum_up, SCORES).groupBy("key").agg(*[F.first(c).alias(c) for c in ("n", "v", "alone")])
        with shuffles_dropped(spark):
            found = stored(found, "scores")
        scores = found if scores is None else scores.unionAll(found)
    removed(rest)
    known.destroy()  # all scores are stored
    return scores
