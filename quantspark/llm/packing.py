"""Best-fit packing of token pieces into sequences, improved by swaps that empty bins."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, table
from .tokens import CACHE_BYTES, encoded, token_ids, tokenizer_path

CAPACITY = 2048
#: Pieces that one task packs; each group leaves at most a few bins underfull.
GROUP = 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: largest first, each into the fullest bin that still takes it. Gaps are found in a bit mask."""
    bins: list[list[int]] = []
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in np.lexsort((np.arange(len(sizes)), -sizes)).tolist():
        s = int(sizes[i])
        if above := mask >> s:
            gap = s + (above & -above).bit_length() - 1
            b = open_[gap].pop()
            if not open_[gap]:
                mask &= ~(1 << gap)
            bins[b].append(i)
        else:
            b, gap = len(bins), capacity
            bins.append([i])
        if gap > s:
            open_[gap - s].append(b)
            mask |= 1 << (gap - s)
    return bins


class SwapSearch:
    """Local search over underfull bins: moves, one-for-one and two-for-one exchanges that raise the sum of squared fills.

    The emptiest bin gives. An exchange lets a fuller bin trade an item for a larger one (or for two) of the giver; each
    raises the squared fill, so the search ends. A few wide gaps are tried first, then all items of all underfull bins
    at once. A giver without items is gone. The search stops at the lower bound of bins, or when a sweep over all
    givers, each until nothing more can leave it, has emptied none.
    """

    def __init__(self, sizes: np.ndarray, bins: list[list[int]], capacity: int, tries: int = 48):
        self.capacity, self.tries = capacity, tries
        self.sizes = np.asarray(sizes, np.int64)
        self.of = np.zeros(len(self.sizes), np.int64)
        for b, items in enumerate(bins):
            self.of[items] = b
        self.bins = {b: sorted((int(sizes[i]), i) for i in items) for b, items in enumerate(bins)}
        self.fill = np.array([sum(s for s, _ in self.bins[b]) for b in range(len(bins))], np.int64)
        self.least = -(-int(self.fill.sum()) // capacity)
        self.gaps = sorted((capacity - f, b) for b, f in enumerate(self.fill.tolist()) if f < capacity)
        self._seen: tuple | None = None

    def _set(self, b: int, fill: int) -> None:
        if (gap := self.capacity - int(self.fill[b])) > 0:
            self.gaps.pop(bisect_left(self.gaps, (gap, b)))
        self.fill[b] = fill
        if 0 < fill < self.capacity:
            insort(self.gaps, (self.capacity - fill, b))

    def _trade(self, a: int, give: list, b: int, take: list) -> None:
        for source, items, goal in ((a, give, b), (b, take, a)):
            for x in items:
                self.bins[source].remove(x)
                insort(self.bins[goal], x)
                self.of[x[1]] = goal
        d = sum(s for s, _ in give) - sum(s for s, _ in take)
        self._set(a, int(self.fill[a]) - d)
        self._set(b, int(self.fill[b]) + d)
        self._seen = None

    def _everywhere(self, a: int) -> bool:
        """The exchange that moves most out of ``a``, of all with any item of a fuller bin; both bins keep their order of fill."""
        if self._seen is None:
            fill = self.fill[self.of]
            u = np.flatnonzero(fill < self.capacity)
            self._seen = u, self.sizes[u], self.sizes[u] + self.capacity - fill[u], fill[u], self.of[u]
        u, size, reach, fill, of = self._seen
        items, offers = self.bins[a], {}
        for i, x in enumerate(items):
            offers.setdefault(x[0], [x])
            for y in items[:i]:
                offers.setdefault(x[0] + y[0], [x, y])
        gain, best = 0, None
        open_ = (fill >= self.fill[a]) & (of != a)
        for s in sorted(offers):
            fits = np.flatnonzero(open_ & (size < s - gain) & (reach >= s))
            if len(fits):
                k = fits[np.argmin(size[fits])]
                gain, best = s - int(size[k]), (s, k)
        if best is None:
            return False
        s, k = best
        self._trade(a, offers[s], int(of[k]), [(int(size[k]), int(u[k]))])
        return True

    def _step(self, a: int) -> bool:
        items = self.bins[a]
        for x in reversed(items):  # a move into the fullest bin that takes it
            at = bisect_left(self.gaps, (x[0], -1))
            while at < len(self.gaps) and self.gaps[at][1] == a:
                at += 1
            if at < len(self.gaps) and self.fill[self.gaps[at][1]] + x[0] > self.fill[a]:
                self._trade(a, [x], self.gaps[at][1], [])
                return True
        offers = [[x] for x in reversed(items)] + [[items[i], items[j]] for i in range(min(len(items), 8)) for j in range(i)]
        for gap, b in reversed(self.gaps[-self.tries :]):  # exchanges with the widest gaps among fuller bins
            if b == a or self.fill[b] < self.fill[a]:
                continue
            for give in offers:
                s = sum(k for k, _ in give)
                at = bisect_left(self.bins[b], (s - gap, -1))
                if at < len(self.bins[b]) and self.bins[b][at][0] < s:
                    self._trade(a, give, b, [self.bins[b][at]])
                    return True
        return self._everywhere(a)

    def run(self) -> list[list[int]]:
        failed: set[int] = set()
        alive, emptied = int((self.fill > 0).sum()), False
        while alive > self.least:
            a = next((b for _, b in reversed(self.gaps) if b not in failed), None)
            if a is None:
                if not emptied:
                    break
                failed, emptied = set(), False
                continue
            while self.fill[a] and self._step(a):
                pass
            if self.fill[a]:
                failed.add(a)
            else:
                alive, emptied = alive - 1, True
        return [[i for _, i in items] for items in self.bins.values() if items]


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item. Items as large as the capacity take a bin each; sizes are 1 to the capacity."""
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    full = np.flatnonzero(sizes >= capacity)
    part = np.flatnonzero(sizes < capacity)
    bins = SwapSearch(sizes[part], best_fit(sizes[part], capacity), capacity).run()
    where[full] = np.arange(len(full))
    for b, items in enumerate(bins):
        at = 0
        for i in items:
            where[part[i]], offset[part[i]] = len(full) + b, at
            at += int(sizes[part[i]])
    return where, offset


def _pieces(path_of, name: str, end_id: int, capacity: int, cache: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = token_ids(path_of(name), False, cache), np.array([end_id], "<u4").tobytes()
        for b in batches:
            out: list[tuple] = []
            for doc, ids in encoded(b, encoder):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    out.append((doc, k, at // 4, len(own) // 4, zlib.crc32(own)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 0, capacity: int = CAPACITY, path_of=tokenizer_path, cache: int = CACHE_BYTES) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: each text's ids and its end id, cut only where longer than the capacity.

    ``cache`` bounds the bytes of pieces that a worker remembers.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(path_of, tokenizer, end_id, capacity, cache), PIECES)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` (gapless from 0 within a sequence) to pieces.

    Pieces are written to the shared folder first, dealt evenly by row into groups of about ``group``, and each group is
    packed by one task: the number of groups grows with the input, and no key decides a group's size. Null doc_ids and
    repeated rows are packed like any others; an empty table stays empty.
    """
    held = checkpoint(pieces)
    groups = max(1, -(-held.count() // group))
    dealt = held.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        where, offset = pack(pdf["length"].to_numpy(np.int64), capacity)
        pdf["sequence_id"], pdf["offset"] = where * groups + pdf["g"], offset
        return pdf.drop(columns="g")

    return dealt.groupBy("g").applyInPandas(run, PIECES + ", sequence_id long, offset long")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack_pieces(token_pieces(table(spark, sf_dir, "documents").select("doc_id", "text")))
