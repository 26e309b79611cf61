"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation, with exact corpus counts for rare words.

Every training document is learned from: texts are dealt to shards by a hash of their row, each shard is learned in the order
of these hashes, and the shards' parameters are averaged in their order, so the model does not depend on the file layout. A word outside the
model's vocabulary is the class UNK times its smoothed share of the rare words' counts, so each document's tokens have
normalised chances.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, shuffle_partitions, slices, table, utf8

#: Vocabulary, dimensions, words of context, shared noise words a batch, positions a batch, learning rate, rounds.
VOCABULARY, DIM, CONTEXT, NOISE, BATCH, RATE, ROUNDS = 1024, 24, 2, 64, 512, 0.05, 1
END, UNK = 0, 1
#: Most frequent words whose counts every task knows; only rarer ones are asked for.
COUNTED = 16384
#: Tokens that a shard of the training texts holds, the most shards there are, and the parts that their means are taken in.
SHARD, SHARDS, GROUPS = 1_000_000, 4096, 64


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def _pack_words(words: list[bytes], *arrays: np.ndarray) -> bytes:
    data = b" ".join(words)
    return b"".join(struct.pack("<Q", len(x)) + x for x in (data, *(a.tobytes() for a in arrays)))


def _unpack(data: bytes, *kinds: str) -> tuple:
    out, at = [], 0
    for kind in kinds:
        (n,) = struct.unpack_from("<Q", data, at)
        raw = data[at + 8 : at + 8 + n]
        out.append(raw.split(b" ") if kind == "words" else np.frombuffer(raw, kind))
        at += 8 + n
    return tuple(out)


def _by_bucket(words: list[bytes], buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    key = np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words)) % buckets
    order = np.argsort(key, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        if len(part):
            yield int(key[part[0]]), part


def _count(buckets: int):
    """A task's word counts; given up and begun anew at a bounded number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def dump():
            words = list(seen)
            n = np.array(list(seen.values()), "<i8")
            found = [(b, 0, _pack_words([words[i] for i in part], n[part])) for b, part in _by_bucket(words, buckets)]
            return _blobs(found)

        docs = 0
        for b in batches:
            for text in utf8(b.column(0)):
                seen.update(tokens(text))
                docs += 1
                if len(seen) > 400_000:
                    yield dump()
                    seen.clear()
        if seen:
            yield dump()
        if docs:
            yield _blobs([(-1, 0, struct.pack("<q", docs))])

    return run


_KIND = "bucket int, kind int, data binary"


def _blobs(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, k, d = zip(*found, strict=True) if found else ((), (), ())
    return pa.record_batch([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(d, pa.binary())], ["bucket", "kind", "data"])


def _merge_counts(top: int):
    """Sums of a bucket's counts: (its words, its tokens, its most frequent words, and the table itself)."""

    def one(bucket: int, parts: list[tuple[int, bytes]]) -> tuple:
        if bucket < 0:
            return 0, sum(struct.unpack("<q", d)[0] for _, d in parts), [], b""
        seen: Counter = Counter()
        for _, data in parts:
            words, n = _unpack(data, "words", "<i8")
            for w, k in zip(words, n.tolist(), strict=True):
                seen[w] += k
        words = sorted(seen)
        n = np.array([seen[w] for w in words], "<i8")
        best = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:top]
        return len(words), int(n.sum()), best, _pack_words(words, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, parts in _gathered(batches):
            v, n, best, data = one(bucket, parts)
            yield pa.record_batch(
                [pa.array([bucket], pa.int32()), pa.array([v], pa.int64()), pa.array([n], pa.int64()), pa.array([[w for w, _ in best]], pa.list_(pa.binary())), pa.array([[k for _, k in best]], pa.list_(pa.int64())), pa.array([data], pa.binary())],
                ["bucket", "v", "n", "words", "counts", "data"],
            )

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    last, held = None, []
    for b in batches:
        for bucket, kind, data in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if bucket != last and held:
                yield last, held
                held = []
            last = bucket
            held.append((kind, data))
    if held:
        yield last, held


# -- the model -------------------------------------------------------------------------------------------------------------


class Vocabulary(dict):
    """Word -> number; any other word is UNK."""

    def __init__(self, words: list[bytes]):
        super().__init__((w, i + 2) for i, w in enumerate(words))

    def __missing__(self, word: bytes) -> int:
        return UNK

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Context before the text (END, as after a text), the words, END."""
        out = np.empty(len(words) + CONTEXT + 1, np.int32)
        out[:CONTEXT] = END
        out[CONTEXT:-1] = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        out[-1] = END
        return out


def _by_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows there are, ascending, and the sums of their values."""
    order = np.argsort(rows.astype(np.uint16) if rows.max() < 65536 else rows, kind="stable")
    rows = rows[order]
    head = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    return rows[head], np.add.reduceat(values[order], head)


class LogBilinear:
    """score(w | h) = sum_i C_i * R[h_i] . Q[w] + b[w]; chances are softmax over the vocabulary, UNK and END."""

    def __init__(self, r: np.ndarray, q: np.ndarray, b: np.ndarray, c: np.ndarray):
        self.r, self.q, self.b, self.c = r, q, b, c
        self._norm: np.ndarray | None = None

    @classmethod
    def start(cls, unigram: np.ndarray, dim: int = DIM, seed: int = 3) -> LogBilinear:
        rng = np.random.default_rng(seed)
        n = len(unigram)
        return cls(*(rng.normal(0, 0.1, (n, dim)).astype(np.float32) for _ in range(2)), np.log(unigram).astype(np.float32), np.ones((CONTEXT, dim), np.float32))

    def dump(self) -> bytes:
        return np.concatenate([x.ravel() for x in (self.r, self.q, self.b, self.c)]).astype("<f4").tobytes()

    @classmethod
    def load(cls, data: np.ndarray, n: int, dim: int = DIM) -> LogBilinear:
        cut = np.cumsum([n * dim, n * dim, n])
        r, q, b, c = np.split(data.astype(np.float32), cut)
        return cls(r.reshape(n, dim), q.reshape(n, dim), b, c.reshape(CONTEXT, dim))

    def hidden(self, context: np.ndarray) -> np.ndarray:
        return sum(self.r[context[:, i]] * self.c[i] for i in range(CONTEXT))

    def learn(self, context: np.ndarray, word: np.ndarray, weight: np.ndarray, noise_log: np.ndarray, noise_cdf: np.ndarray, rng, state: list[np.ndarray]) -> None:
        """One step of noise-contrastive estimation: true words against NOISE words that the whole batch shares; ``weight``: how many rows a position stands for."""
        noise = np.searchsorted(noise_cdf, rng.random(NOISE)).astype(np.int32)
        h, qw, qn = self.hidden(context), self.q[word], self.q[noise]
        log_k = np.float32(np.log(NOISE))
        true = np.einsum("ij,ij->i", h, qw) + (self.b[word] - noise_log[word] - log_k)
        false = h @ qn.T
        false += self.b[noise] - noise_log[noise] - log_k
        gt = weight / (1 + np.exp(np.clip(true, -30, 30)))
        np.clip(false, -30, 30, out=false)
        np.exp(np.negative(false, out=false), out=false)
        false += 1
        gf = np.divide(-weight[:, None], false, out=false)
        gh = gt[:, None] * qw + gf @ qn
        k, dim = len(word), h.shape[1]
        out = np.empty((k + NOISE, dim + 1), np.float32)  # gradients of q and, in the last column, of b
        np.multiply(gt[:, None], h, out=out[:k, :dim])
        out[k:, :dim], out[:k, dim], out[k:, dim] = gf.T @ h, gt, gf.sum(axis=0)
        gc = np.stack([np.einsum("ij,ij->j", gh, self.r[context[:, i]]) for i in range(CONTEXT)])
        scale = np.float32(1 / np.sqrt(k))
        rows, g = _by_row(np.concatenate([word, noise]), out)
        at, gr = _by_row(context.T.ravel(), np.concatenate([gh * self.c[i] for i in range(CONTEXT)]))
        for x, s, i, g in zip((self.r, self.q, self.b, self.c), state, (at, rows, rows, slice(None)), (gr, g[:, :dim], g[:, dim], gc), strict=True):
            g = g * scale
            t = s[i] + g * g
            s[i] = t
            x[i] += RATE * g / np.sqrt(t + 1e-6)  # rows without a gradient stay as they are

    def log10(self, numbers: np.ndarray) -> np.ndarray:
        """Normalised log10 chances of numbers[CONTEXT:]. Normalisers of contexts are found by batched products, once each."""
        n = len(self.b)
        if self._norm is None:
            self._norm = np.full(n * n, np.nan, np.float32)
        context = np.stack([numbers[i : len(numbers) - CONTEXT + i] for i in range(CONTEXT)], axis=1)
        word = numbers[CONTEXT:]
        code = context[:, 0].astype(np.int64) * n + context[:, 1]
        new = np.unique(code[np.isnan(self._norm[code])])
        for at in range(0, len(new), 2048):
            k = new[at : at + 2048]
            s = self.hidden(np.stack([k // n, k % n], axis=1)) @ self.q.T + self.b
            top = s.max(axis=1)
            self._norm[k] = top + np.log(np.exp(s - top[:, None]).sum(axis=1))
        s = (self.hidden(context) * self.q[word]).sum(axis=1) + self.b[word]
        return (s - self._norm[code]).astype(np.float64) / np.log(10)


def _numbered(words: list[bytes], shards: int):
    """Training texts as numbers, dealt to shards by doc_key. Equal rows of a batch travel once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, kind = Vocabulary(words), _width(len(words) + 2)
        for batch in batches:
            for b in slices(batch, 1, 4 << 20):
                held: Counter = Counter()
                for key, text in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                    held[key, vocabulary.numbers(tokens(text)).astype(kind).tobytes()] += 1
                keys, data = zip(*held, strict=True) if held else ((), ())
                yield pa.record_batch(
                    [pa.array([k % shards for k in keys], pa.int32()), pa.array(keys, pa.int64()), pa.array(data, pa.binary()), pa.array(held.values(), pa.int64())],
                    ["shard", "doc_key", "data", "times"],
                )

    return run


def _width(n: int) -> str:
    return "<u2" if n <= 65536 else "<u4"


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes, int]]:
    """Sorted rows (shard, doc_key, numbers, times); equal neighbours are one."""
    held = None
    for b in batches:
        for *row, times in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if held and held[0] == row:
                held[1] += times
                continue
            if held:
                yield *held[0], held[1]
            held = [row, times]
    if held:
        yield *held[0], held[1]


def _trainer(unigram: np.ndarray, start: bytes):
    """Parameters after one pass over each shard, always from the same start and in the same order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, kind = len(unigram), _width(len(unigram))
        log, cdf = np.log(unigram).astype(np.float32), np.cumsum(unigram)
        cdf[-1] = 1.0
        for shard, rows in groupby(_documents(batches), key=lambda r: r[0]):
            model = LogBilinear.load(np.frombuffer(start, "<f4"), n)
            state = [np.zeros_like(x) for x in (model.r, model.q, model.b, model.c)]
            rng = np.random.default_rng((11, shard))
            seen, held, size = 0, [], 0
            for _, _, data, times in rows:
                x = np.frombuffer(data, kind).astype(np.int32)
                held.append((x, times))
                size += len(x) - CONTEXT
                if size >= 16 * BATCH:
                    seen += _learn(model, held, log, cdf, rng, state)
                    held, size = [], 0
            if held:
                seen += _learn(model, held, log, cdf, rng, state)
            yield pa.record_batch([pa.array([shard % GROUPS], pa.int32()), pa.array([shard], pa.int32()), pa.array([seen], pa.int64()), pa.array([model.dump()], pa.binary())], ["part", "shard", "n", "data"])

    return run


def _learn(model: LogBilinear, held: list[tuple[np.ndarray, int]], log, cdf, rng, state) -> int:
    context = np.concatenate([np.stack([x[i : len(x) - CONTEXT + i] for i in range(CONTEXT)], axis=1) for x, _ in held])
    word = np.concatenate([x[CONTEXT:] for x, _ in held])
    weight = np.repeat(np.array([t for _, t in held], np.float32), [len(x) - CONTEXT for x, _ in held])
    order = rng.permutation(len(word))
    for at in range(0, len(word), BATCH):
        k = order[at : at + BATCH]
        model.learn(context[k], word[k], weight[k], log, cdf, rng, state)
    return int(weight.sum(dtype=np.float64))


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Means of parameters by part, weighted by tokens, in the order of shards."""

    def rows():
        for b in batches:
            yield from zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)

    for part, found in groupby(rows(), key=lambda r: r[0]):
        total, mean = 0, None
        for _, _, n, data in found:
            x = np.frombuffer(data, "<f4").astype(np.float64)
            mean = x if mean is None else mean + (x - mean) * (n / (total + n))
            total += n
        yield pa.record_batch([pa.array([0], pa.int32()), pa.array([part], pa.int32()), pa.array([total], pa.int64()), pa.array([mean.astype("<f4").tobytes()], pa.binary())], ["part", "shard", "n", "data"])


# -- scoring ---------------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _model(params: bytes, n: int) -> LogBilinear:
    """One model for all tasks of a worker: they share the normalisers that are found."""
    return LogBilinear.load(np.frombuffer(params, "<f4"), n)


def _score(words: list[bytes], counts: list[int], end: int, params: bytes, n: int, buckets: int):
    """``words`` and their counts: the model's vocabulary (numbers below n) and more. What a row's own task finds (kind 0: doc_key and figures) and what it asks the count tables (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(words)
        model = _model(params, n)
        known = np.array([end, 0, *counts], np.float64)
        for batch in batches:
            for b in slices(batch, 1, 4 << 20):
                keys = b.column(0).to_numpy()
                out: list[tuple] = []
                asked: list[bytes] = []
                owner, times = [], []
                held, every = [], []
                for i, text in enumerate(utf8(b.column(1))):
                    t = tokens(text)
                    x = vocabulary.numbers(t)
                    held.append(np.where(x < n, x, UNK))
                    every.append(x[CONTEXT:])
                    rare = Counter([t[k] for k in np.flatnonzero(x[CONTEXT:-1] == UNK).tolist()])
                    asked += rare
                    times += rare.values()
                    owner += [i] * len(rare)
                logs = model.log10(np.concatenate(held)) if len(held) == 1 else np.concatenate([model.log10(x) for x in held])
                size = np.array([len(x) - CONTEXT for x in held])
                word = np.concatenate(every)
                at = np.cumsum(size) - size
                lm = np.add.reduceat(logs, at)
                own = np.where(word == UNK, 0.0, np.log10(known[word] + 1))
                base = np.add.reduceat(own, at)
                n_known = np.add.reduceat((known[word] > 0).astype(np.int64), at)
                outside = (word == UNK) | (word >= n)
                n_rare = np.add.reduceat(outside.astype(np.int64), at)
                local = np.add.reduceat(np.where(outside, own, 0.0), at)
                for row in zip(keys.tolist(), size.tolist(), n_known.tolist(), n_rare.tolist(), base.tolist(), lm.tolist(), local.tolist(), strict=True):
                    out.append((-1, 0, struct.pack("<qqqqddd", *row)))
                owner, times = np.array(owner, np.int64), np.array(times, np.int64)
                for bucket, part in _by_bucket(asked, buckets):
                    docs, back = np.unique(owner[part], return_inverse=True)
                    out.append((bucket, 1, _pack_words([asked[i] for i in part], times[part].astype("<u4"), keys[docs].astype("<i8"), back.astype("<u2" if len(docs) < 65536 else "<u4"))))
                yield _blobs(out)

    return run


def _answer(groups: int):
    """A bucket's count table (kind 0) answers its questions (kind 1): packed sums of log10(c + 1) and known tokens by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _gathered(batches):
            counts: dict[bytes, int] = {}
            for kind, data in parts:
                if kind == 0 and data:
                    words, n = _unpack(data, "words", "<i8")
                    counts.update(zip(words, n.tolist(), strict=True))
            keys, base, known = [], [], []
            for kind, data in parts:
                if kind == 1:
                    words, times, own, back = _unpack(data, "words", "<u4", "<i8", "u1")
                    back = back.view("<u2" if len(back) == 2 * len(times) else "<u4")
                    c = np.fromiter((counts.get(w, 0) for w in words), np.float64, len(words))
                    keys.append(own)
                    base.append(np.bincount(back, times * np.log10(c + 1), len(own)))
                    known.append(np.bincount(back, times * (c > 0), len(own)))
            if keys:
                key, sums, n = _summed(*(np.concatenate(x) for x in (keys, base, known)))
                group = key % groups
                order = np.argsort(group, kind="stable")
                cut = np.split(order, np.flatnonzero(np.diff(group[order])) + 1)
                yield _blobs([(int(group[k[0]]), 2, b"".join(x[k].tobytes() for x in (key, sums, n))) for k in cut])

    return run


def _summed(key: np.ndarray, base: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, at = np.unique(key, return_inverse=True)
    return key, np.bincount(at, base, len(key)), np.bincount(at, known, len(key))


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a group's documents over all buckets."""
    for _, parts in _gathered(batches):
        columns = [np.frombuffer(d, np.uint8).reshape(3, -1) for _, d in parts]
        keys, base, known = (np.concatenate([c[i].view(t) for c in columns]) for i, t in enumerate(("<i8", "<f8", "<f8")))
        key, sums, n = _summed(keys, base, known)
        yield pa.record_batch([pa.array(key), pa.array(sums), pa.array(n.astype(np.int64))], ["doc_key", "rare_base", "rare_known"])


OWN = "doc_key long, n_tokens long, n_known long, n_rare long, base double, lm double, local double"


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
    for b in batches:
        rows = [struct.unpack("<qqqqddd", d) for d in b.column(2).to_pylist()]
        yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], [c.split()[0] for c in OWN.split(", ")])


def score_documents(docs: DataFrame, vocabulary: int = VOCABULARY, rounds: int = ROUNDS) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for each row of ``docs(doc_id, text)``.

    held_out: crc32(doc_id as text) mod 7 is 2 (a null doc_id counts as the empty text, so it trains). Counts are exact
    over all training documents: tasks send their sums in packed tables, and documents send the words outside the
    model's vocabulary to the tables' buckets and get sums back, so no word's rows meet as rows. A null or empty text is
    its end token. Equal rows ask twice, share the answer, and weigh as often as they come in training. Without training documents every count is 0.
    """
    spark = docs.sparkSession
    buckets = shuffle_partitions(spark)
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out.alias("held_out"))
    training = rows.where("not held_out").select("text")
    meet = lambda df: df.repartition("bucket").sortWithinPartitions("bucket", "kind")
    merged = meet(training.mapInArrow(_count(buckets), _KIND)).mapInArrow(_merge_counts(max(vocabulary, COUNTED)), "bucket int, v long, n long, words array<binary>, counts array<long>, data binary")
    merged = checkpoint(merged)
    stats = merged.agg(F.sum("v").alias("v"), F.sum("n").alias("n"), F.sum(F.when(F.col("bucket") == -1, F.col("n"))).alias("docs")).first()
    n_docs, total, distinct = stats["docs"] or 0, stats["n"] or 0, (stats["v"] or 0) + (1 if stats["docs"] else 0)
    best = merged.select(F.inline(F.arrays_zip("words", "counts"))).coalesce(max(1, isqrt(buckets))).orderBy(F.desc("counts"), "words").limit(max(vocabulary, COUNTED))
    best = checkpoint(best).collect()  # COUNTED rows; cut down on executors, not on the driver
    counted, times = [bytes(r[0]) for r in best], [r[1] for r in best]
    words, counts = counted[:vocabulary], times[:vocabulary]
    rare_n, rare_v = total - n_docs - sum(counts), distinct - len(words) - 1
    mass = np.array([n_docs, rare_n, *counts], np.float64) + 1
    unigram = mass / mass.sum()
    params = LogBilinear.start(unigram).dump()
    keyed = rows.withColumn("doc_key", F.xxhash64("doc_id", "text"))
    shards = min(SHARDS, max(1, total // SHARD))
    model = "part int, shard int, n long, data binary"
    dealt = keyed.where("not held_out").select("doc_key", "text").mapInArrow(_numbered(words, shards), "shard int, doc_key long, data binary, times long")
    dealt = dealt.repartition(min(shards, buckets), "shard").sortWithinPartitions("shard", "doc_key", "data")
    for _ in range(rounds):
        means = dealt.mapInArrow(_trainer(unigram, params), model).repartition(min(shards, GROUPS), "part").sortWithinPartitions("part", "shard").mapInArrow(_average, model)
        got = means.repartition(1).sortWithinPartitions("shard").mapInArrow(_average, model).first()
        params = bytes(got["data"]) if got else params
    both = checkpoint(keyed.select("doc_key", "text").mapInArrow(_score(counted, times, n_docs, params, len(unigram), buckets), _KIND))
    tables = merged.where("bucket >= 0").select("bucket", F.lit(0).alias("kind"), "data")
    answers = meet(both.where("bucket >= 0").unionAll(tables)).mapInArrow(_answer(buckets), _KIND)
    answers = meet(answers).mapInArrow(_sum_up, "doc_key long, rare_base double, rare_known long")
    own = both.where("bucket = -1").mapInArrow(_own, OWN).groupBy("doc_key").agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n_tokens", "n_known", "n_rare", "base", "lm", "local")])
    x = keyed.select("doc_id", "held_out", "doc_key").join(own.join(answers, "doc_key", "left"), "doc_key")
    rare = F.coalesce(F.col("rare_base") / F.col("copies"), F.lit(0.0))
    log = lambda v: F.lit(float(np.log10(v)))
    return x.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce(F.col("rare_known") / F.col("copies"), F.lit(0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + rare - F.col("n_tokens") * log(total + distinct + 1)).alias("base_score"), (F.col("lm") + F.col("local") + rare - F.col("n_rare") * log(max(1, rare_n + rare_v + 1))).alias("score"),
    )


def op3_scores(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
