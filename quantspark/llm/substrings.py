"""Exact removal of long substrings that earlier documents hold, by run-length compressed Burrows-Wheeler indexes.

Strings of LENGTH bytes meet by content: each is dealt by the least hash of its SEED_BYTES-grams (a minimizer), so equal
strings reach the same index. A first pass finds the minimizers that several documents hold; only text around those
goes on, and equal pieces of a group of documents go on once, with the least doc_id that has them. Each index is a
run-compressed transform of the distinct pieces of its share with text positions sampled at run ends. From the samples
alone follow, in text order, each position's predecessor among the sorted suffixes and the length of their match; long
matches form chains, and a chain's least doc_id decides.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, slices, table, utf8

LENGTH, SEED_BYTES = 50, 20
#: Windows in one piece at most, so that pieces stay short where one minimizer holds on.
PIECE_WINDOWS = 64
SEGMENT = 2 << 20
#: Text of one group of documents, and what one bucket of minimizers stands for, on average.
GROUP_BYTES = 24 << 20
#: Documents of one slice that hold a minimizer, from which on its bucket is not asked about each of them.
COMMON = 8
#: Shares of a bucket, which are indexed some at a time, up to about so many bytes.
SHARES, INDEX_BYTES = 256, 1 << 20
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def minimizers(text: np.ndarray, length: int = LENGTH, seed: int = SEED_BYTES) -> np.ndarray:
    """For each window of ``length`` bytes: the least hash of its ``seed``-grams."""
    n = len(text)
    if n < length:
        return np.zeros(0, np.uint64)
    raw = np.concatenate([text, np.zeros(8, np.uint8)])
    eight = np.ndarray((n,), "<u8", raw, strides=(1,)).copy()
    k = n - seed + 1
    h = eight[:k] * _A
    h ^= eight[8 : 8 + k] * _B
    h += eight[seed - 8 : seed - 8 + k] * _C
    h ^= h >> np.uint64(32)
    h *= _D
    h ^= h >> np.uint64(29)
    span, width = length - seed + 1, 1
    while 2 * width <= span:
        h = np.minimum(h[: len(h) - width], h[width:])
        width *= 2
    left = span - width
    return np.minimum(h[: len(h) - left], h[left:]) if left else h


def runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, minimizer) of each run of windows with one minimizer, within each text."""
    out = []
    batch: list[tuple[int, int, bytes]] = []
    held = 0

    def flush():
        if not batch:
            return
        text = np.frombuffer(b"".join(x for _, _, x in batch), np.uint8)
        m = minimizers(text)
        sizes = np.array([len(x) for _, _, x in batch])
        starts = np.cumsum(sizes) - sizes
        own = np.repeat(np.arange(len(batch)), sizes)[: len(m)]
        good = np.arange(len(m)) + LENGTH <= (starts + sizes)[own]
        new = np.r_[True, (m[1:] != m[:-1]) | (own[1:] != own[:-1]) | (good[1:] != good[:-1])]
        first = np.flatnonzero(new)
        count = np.diff(np.r_[first, len(m)])
        keep = good[first]
        first, count = first[keep], count[keep]
        doc, shift = np.array([d for d, _, _ in batch]), np.array([s for _, s, _ in batch])
        out.append((doc[own[first]], first - starts[own[first]] + shift[own[first]], count, m[first]))

    for d, t in enumerate(texts):
        if len(t) < LENGTH:
            continue
        for at in range(0, max(1, len(t) - LENGTH + 1), SEGMENT):
            part = t[at : at + SEGMENT + LENGTH - 1]
            batch.append((d, at, part))
            held += len(part)
            if held >= SEGMENT:
                flush()
                batch, held = [], 0
    flush()
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of strings, each closed by a terminator of its own (in order, below all bytes).

    Kept of the suffix array are its values at the run ends only: ``heads`` and ``tails``, the text positions of each
    run's first and last row.
    """

    def __init__(self, strings: list[bytes]):
        self.n = len(strings)
        self.sizes = np.array([len(s) for s in strings], np.int64)
        raw = b"\0".join(strings) + b"\0"
        self.ends = np.cumsum(self.sizes + 1) - 1
        text = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)
        text[self.ends] = 0
        total = len(text)
        ends_at = np.repeat(self.ends, self.sizes + 1)
        left = ends_at - np.arange(total)
        key = np.zeros(total, np.uint64)
        for j in range(7):  # seven characters of nine bits
            key[: total - j] |= text[j:] << np.uint64(9 * (6 - j))
        for j in range(7):  # nothing beyond the terminator counts
            short = np.flatnonzero(left == j)
            key[short] &= ~np.uint64((1 << (9 * (7 - j))) - 1)
        sa = np.argsort(key)
        sorted_key = key[sa]
        head = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
        del key, sorted_key
        start = np.flatnonzero(head)[np.cumsum(head) - 1]
        start[: self.n] = np.arange(self.n)
        sa[: self.n] = self.ends  # terminators are the least, in order
        head[: self.n + 1] = True
        rank = np.empty(total, np.int64)
        rank[sa] = start
        depth, todo = 7, np.flatnonzero(~(head & np.r_[head[1:], True]))
        while len(todo):
            s = sa[todo]
            both = rank[s] << 32 | rank[np.minimum(s + depth, ends_at[s])]
            order = np.argsort(both)
            s, both = s[order], both[order]
            sa[todo] = s
            fresh = np.r_[True, both[1:] != both[:-1]]
            rank[s] = todo[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
            todo = todo[~(fresh & np.r_[fresh[1:], True])]
            depth *= 2
        bwt = text[sa - 1]
        bwt[sa == 0] = 0
        new = np.flatnonzero(np.r_[True, (bwt[1:] != bwt[:-1]) | (bwt[1:] == 0)])  # terminators differ from one another
        self.chars, self.heads, self.tails = (bwt[new].astype(np.int16) - 1), sa[new], sa[np.r_[new[1:], total] - 1]
        self.raw, self.total = raw, total

    def matches(self) -> tuple[np.ndarray, np.ndarray]:
        """For every text position: the position of the suffix sorted before its own, and the length of their match.

        Only the first row of a run is compared with its predecessor, the last row of the run before. Any other
        position's predecessor is one after that of the position before it, and their match is one shorter.
        """
        order = np.argsort(self.heads)
        at = self.heads[order]
        before = np.where(order > 0, self.tails[order - 1], at)
        left = np.repeat(self.ends, self.sizes + 1)
        most = np.minimum(left[at] - at, left[before] - before)
        most[before == at] = 0
        raw = np.frombuffer(self.raw + b"\0" * 8, np.uint8)
        eight = np.ndarray((self.total + 1,), "<u8", raw, strides=(1,))
        length = np.zeros(len(at), np.int64)
        todo = np.flatnonzero(most > 0)
        while len(todo):
            i, j = at[todo] + length[todo], before[todo] + length[todo]
            x = eight[i] ^ eight[j]
            same = np.where(x == 0, 8, (np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3).astype(np.int64))
            length[todo] += same
            todo = todo[(same == 8) & (length[todo] < most[todo])]
        length = np.minimum(length, most)
        mark = np.zeros(self.total, np.int64)
        mark[at] = 1
        run = np.cumsum(mark) - 1
        step = np.arange(self.total) - at[run]
        return before[run] + step, np.maximum(length[run] - step, 0)

    def least_labels(self, labels: np.ndarray, length: int = LENGTH) -> np.ndarray:
        """For every text position: the least label of any string that holds the ``length`` bytes from there on.

        Positions of equal bytes are neighbours among the sorted suffixes, so long matches chain them together. A
        position from which fewer bytes are left has its own string's label.
        """
        before, match = self.matches()
        least = np.repeat(labels, self.sizes + 1)
        own = least.copy()
        again = np.flatnonzero(match >= length)
        first = np.arange(self.total)
        first[again] = before[again]
        while len(again):  # to the first of each chain, by doubling
            jumped = first[first[again]]
            if np.array_equal(jumped, first[again]):
                break
            first[again] = jumped
        np.minimum.at(least, first[again], own[again])
        return least[first]


# -- what tasks send to one another: arrays packed into one binary value, so that rows stay few ----------------------------


def _dump(*arrays: np.ndarray) -> bytes:
    return b"".join(struct.pack("<Q", a.nbytes) + a.tobytes() for a in arrays)


def _load(data: bytes, *kinds: str) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        (n,) = struct.unpack_from("<Q", data, at)
        out.append(np.frombuffer(data, kind, n // np.dtype(kind).itemsize, at + 8))
        at += 8 + n
    return out


def _split(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(key, kind="stable")
    cut = np.flatnonzero(np.diff(key[order])) + 1
    for part in np.split(order, cut):
        if len(part):
            yield int(key[part[0]]), part


def _docs32(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(base, offsets) with 32-bit offsets where they fit."""
    base = doc.min() if len(doc) else np.int64(0)
    off = doc - base
    return np.array([base], "<i8"), off.astype("<u4") if not len(off) or off.max() < 1 << 32 else off.astype("<u8")


def _u40(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])


def _from_u40(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = raw.reshape(-1, 5)
    return out.view("<u8").ravel()


_ROW = ["bucket", "data"]


def _rows(found: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([b for b, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], _ROW)


def _packed_docs(doc: np.ndarray) -> tuple[np.ndarray, ...]:
    base, off = _docs32(doc)
    return base, np.array([off.itemsize], "<u1"), off


def _seeds(buckets: int, groups: int):
    """Pass 1: the minimizers of each document, 40 bits each, dealt to buckets.

    What COMMON documents of a slice hold is known to be shared at once: those documents' groups are told (buckets from
    ``buckets`` on), and the minimizer's bucket gets one entry for all of them. So a common minimizer's bucket grows with
    the slices, not with the documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, 1, 4 << 20):
                ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                doc, _, _, h = runs(utf8(b.column(1)))
                d = ids[doc]
                order = np.lexsort((d, h))
                d, h = d[order], h[order]
                keep = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])][: len(h)]
                d, h = d[keep], h[keep]
                if not len(h):
                    continue
                first = np.r_[True, h[1:] != h[:-1]]
                held = np.diff(np.r_[np.flatnonzero(first), len(h)])
                many = np.repeat(held >= COMMON, held)
                out = []
                for bucket, part in _split((h % np.uint64(buckets)).astype(np.int64)):
                    one, all_ = part[~many[part]], part[many[part] & first[part]]
                    out.append((bucket, _dump(_u40(h[one] >> np.uint64(24)), _u40(h[all_] >> np.uint64(24)), *_packed_docs(d[one]))))
                told = np.flatnonzero(many)
                for g, part in _split(d[told] % groups):
                    part = told[part]
                    out.append((buckets + g, _dump(np.array([0], "u1"), _key(h[part], buckets), *_packed_docs(d[part]))))
                yield _rows(out)

    return run


def _key(h: np.ndarray, buckets: int) -> np.ndarray:
    """What a minimizer is known by: 40 bits of it and its bucket."""
    return ((h >> np.uint64(24)) << np.uint64(24)) | h % np.uint64(buckets)


def _shared(buckets: int, groups: int):
    """Pass 2: minimizers that several documents hold, sent back to those documents' groups."""

    def one(bucket: int, parts: list[bytes]) -> Iterator[tuple[int, bytes]]:
        if bucket >= buckets:
            yield from ((bucket - buckets, p) for p in parts)
            return
        key, doc, many = [], [], []
        for p in parts:
            raw, common, base, width, off = _load(p, "u1", "u1", "<i8", "<u1", "u1")
            key.append(_from_u40(raw))
            many.append(_from_u40(common))
            doc.append(off.view(f"<u{width[0]}").astype(np.int64) + base[0])
        key, doc, many = np.concatenate(key), np.concatenate(doc), np.unique(np.concatenate(many))
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        keep = np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])][: len(key)]
        key, doc = key[keep], doc[keep]
        again = key[1:] == key[:-1]
        shared = (np.r_[False, again] | np.r_[again, False])[: len(key)] | np.isin(key, many)
        key, doc = key[shared], doc[shared]
        for g, part in _split(doc % groups):
            yield g, _dump(np.array([1], "u1"), _u40(key[part]), np.array([bucket], "<u8"), *_packed_docs(doc[part]))

    return _by_bucket(one)


def _by_bucket(one):
    """Rows arrive sorted by bucket; a bucket's values are gathered, and handed over when the next one begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for b in batches:
            for bucket, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if bucket != last and held:
                    yield _rows(list(one(last, held)))
                    held = []
                last = bucket
                held.append(data)
        if held:
            yield _rows(list(one(last, held)))

    return run


def _ordinals(ids: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Numbers of the distinct texts under one doc_id, in their order; 0 for all unless a doc_id is repeated."""
    out = np.zeros(len(ids), np.int64)
    if len(np.unique(ids)) < len(ids):
        groups: dict[int, set] = {}
        for d, t in zip(ids.tolist(), texts, strict=True):
            groups.setdefault(d, set()).add(t)
        number = {d: {t: i for i, t in enumerate(sorted(s))} for d, s in groups.items() if len(s) > 1}
        out = np.array([number.get(d, {}).get(t, 0) for d, t in zip(ids.tolist(), texts, strict=True)], np.int64)
    return out


def _mix(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    return (doc.astype(np.uint64) * _A ^ key) * _B


def _pieces(buckets: int):
    """Pass 3: of a group of documents, the pieces of text whose minimizer is shared.

    Each distinct piece goes to its index once, with the least and greatest doc_id that have it here; where it occurs
    goes to the group itself (buckets from ``buckets`` on).
    """

    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        if not docs.num_rows or not shared.num_rows:
            return pa.Table.from_batches([_rows([])])
        wanted = []
        for p in shared.column("data").to_pylist():
            if p[8]:  # the first array is the kind: 40 bits of each key and one bucket, or whole keys
                _, raw, bucket, base, width, off = _load(p, "u1", "u1", "<u8", "<i8", "<u1", "u1")
                key = _from_u40(raw) << np.uint64(24) | bucket
            else:
                _, key, base, width, off = _load(p, "u1", "<u8", "<i8", "<u1", "u1")
            wanted.append(_mix(off.view(f"<u{width[0]}").astype(np.int64) + base[0], key))
        wanted = np.unique(np.concatenate(wanted))
        texts, ids = utf8(docs.column("text")), docs.column("doc_id").to_numpy()
        doc, first, count, h = runs(texts)
        keep = np.isin(_mix(ids[doc], _key(h, buckets)), wanted)
        doc, first, count, h = doc[keep], first[keep], count[keep], h[keep]
        if not len(doc):
            return pa.Table.from_batches([_rows([])])
        cut = -(-count // PIECE_WINDOWS)
        rep = np.repeat(np.arange(len(doc)), cut)
        k = np.arange(len(rep)) - np.repeat(np.cumsum(cut) - cut, cut)
        doc, h = doc[rep], h[rep]
        count, first = np.minimum(count[rep] - k * PIECE_WINDOWS, PIECE_WINDOWS), first[rep] + k * PIECE_WINDOWS
        size = count + LENGTH - 1
        number: dict[bytes, int] = {}
        piece = np.array([number.setdefault(texts[d][a : a + n], len(number)) for d, a, n in zip(doc.tolist(), first.tolist(), size.tolist(), strict=True)], np.int64)
        strings = list(number)
        del number
        one = np.zeros(len(strings), np.int64)
        one[piece] = np.arange(len(piece))
        least, most = np.full(len(strings), np.iinfo(np.int64).max), np.full(len(strings), np.iinfo(np.int64).min)
        np.minimum.at(least, piece, ids[doc])
        np.maximum.at(most, piece, ids[doc])
        group, own = int(docs.column("g")[0].as_py()), h[one]
        share = (own >> np.uint64(40)) % np.uint64(SHARES)
        out = [(buckets + group, _dump(np.array([0], "u1"), *_packed_docs(ids[doc]), _ordinals(ids, texts)[doc].astype("<u4"), first.astype("<u4"), np.diff(piece, prepend=0).astype("<i4")))]
        for bucket, part in _split((own % np.uint64(buckets)).astype(np.int64)):
            part = part[np.argsort(share[part], kind="stable")]
            data = np.frombuffer(pa.compress(b"".join([strings[i] for i in part.tolist()]), codec="zstd", asbytes=True), np.uint8)
            out.append((bucket, _dump(np.array([group], "<i8"), part.astype("<u4"), *_packed_docs(least[part]), *_packed_docs(most[part]), size[one[part]].astype("<u2"), share[part].astype("u1"), data)))
        return pa.Table.from_batches([_rows(out)])

    return run


def _marks(buckets: int):
    """Pass 4: indexes over a bucket's shares; for each group's pieces, windows that a smaller doc_id than its greatest holds."""

    def one(bucket: int, parts: list[bytes]) -> Iterator[tuple[int, bytes]]:
        if bucket >= buckets:
            yield from ((bucket - buckets, p) for p in parts)
            return
        text, group, piece, least, most, size, share, at = [], [], [], [], [], [], [], []
        done = 0
        for p in parts:
            g, i, *ends, n, k, data = _load(p, "<i8", "<u4", "<i8", "<u1", "u1", "<i8", "<u1", "u1", "<u2", "u1", "u1")
            a, z = (off.view(f"<u{width[0]}").astype(np.int64) + base[0] for base, width, off in (ends[:3], ends[3:]))
            n = n.astype(np.int64)
            at.append(np.cumsum(n) - n + done)
            text.append(pa.decompress(data.tobytes(), decompressed_size=int(n.sum()), codec="zstd", asbytes=True))
            done += len(text[-1])
            group.append(np.full(len(i), g[0])), piece.append(i), least.append(a), most.append(z), size.append(n), share.append(k)
        data = b"".join(text)
        del text
        order = np.argsort(np.concatenate(share), kind="stable")
        group, piece, least, most, size, share, at = (np.concatenate(x)[order] for x in (group, piece, least, most, size, share, at))
        ends = np.r_[np.flatnonzero(np.diff(share)) + 1, len(share)]
        bytes_to = np.cumsum(size)
        found: list[tuple] = []
        a = 0
        while a < len(share):
            full = int(np.searchsorted(bytes_to, (bytes_to[a - 1] if a else 0) + INDEX_BYTES, side="right"))
            b = int(ends[max(int(np.searchsorted(ends, a, side="right")), int(np.searchsorted(ends, full, side="right")) - 1)])
            found.append(_repeated(data, *(x[a:b] for x in (group, piece, least, most, size, at))))
            a = b
        group, piece, start, n, least = (np.concatenate(x) for x in zip(*found, strict=True))
        for g, part in _split(group):
            yield g, _dump(np.array([1], "u1"), *_packed_docs(least[part]), piece[part].astype("<u4"), start[part].astype("<u2"), n[part].astype("<u2"))

    return _by_bucket(one)


def _repeated(data: bytes, group, piece, least, most, size, at) -> tuple[np.ndarray, ...]:
    """One index over the distinct pieces; (group, piece, first window, windows, least doc_id) where that is below ``most``."""
    number: dict[bytes, int] = {}
    string = np.array([number.setdefault(data[a : a + n], len(number)) for a, n in zip(at.tolist(), size.tolist(), strict=True)], np.int64)
    label = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(label, string, least)
    index = RunLengthIndex(list(number))
    found = index.least_labels(label)
    n = size - LENGTH + 1
    which = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    value = found[(index.ends - index.sizes)[string][which] + step]
    good = value < most[which]
    turn = np.r_[True, (which[1:] != which[:-1]) | (value[1:] != value[:-1]) | (good[1:] != good[:-1])]
    opens = np.flatnonzero(turn)
    length = np.diff(np.r_[opens, len(which)])
    opens, length = opens[good[opens]], length[good[opens]]
    w = which[opens]
    return group[w], piece[w], step[opens], length, value[opens]


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _result(ids, texts: list[bytes], cover: dict) -> pa.Table:
    rows = []
    for i, (d, t) in enumerate(zip(ids, texts, strict=True)):
        if i in cover:
            a, b = cover[i]
            order = np.argsort(a, kind="stable")
            a, b = a[order], np.maximum.accumulate(b[order])
            new = np.r_[True, a[1:] > b[:-1]]
            a, b = a[new], b[np.r_[np.flatnonzero(new)[1:] - 1, len(b) - 1]]
            kept = hashlib.sha256()
            for x, y in zip([0, *b.tolist()], [*a.tolist(), len(t)], strict=True):
                kept.update(t[x:y])
            rows.append((d, len(t), int((b - a).sum()), len(a), kept.hexdigest()))
        else:
            rows.append((d, len(t), 0, 0, hashlib.sha256(t).hexdigest()))
    kinds = (pa.int64(),) * 4 + (pa.string(),)
    return pa.table([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _apply(docs: pa.Table, marks: pa.Table) -> pa.Table:
    """Pass 5: where a group's pieces occur meets what the indexes say of them; removed intervals, merged."""
    texts, ids = utf8(docs.column("text")) if docs.num_rows else [], docs.column("doc_id").to_numpy()
    cover: dict[int, tuple] = {}
    where, said = [], []
    for p in marks.column("data").to_pylist() if marks.num_rows else []:
        if p[8]:  # the first array is the kind
            _, base, width, off, *rest = _load(p, "u1", "<i8", "<u1", "u1", "<u4", "<u2", "<u2")
            into = said
        else:
            _, base, width, off, *rest = _load(p, "u1", "<i8", "<u1", "u1", "<u4", "<u4", "<i4")
            rest[2] = np.cumsum(rest[2], dtype=np.int64)
            into = where
        into.append((off.view(f"<u{width[0]}").astype(np.int64) + base[0], *(x.astype(np.int64) for x in rest)))
    if len(texts) and where and said:
        doc, ordinal, first, piece = (np.concatenate(x) for x in zip(*where, strict=True))
        least, of, start, windows = (np.concatenate(x) for x in zip(*said, strict=True))
        order = np.argsort(of, kind="stable")
        least, of, start, windows = least[order], of[order], start[order], windows[order]
        low = np.searchsorted(of, piece)
        times = np.searchsorted(of, piece, side="right") - low
        i = np.repeat(np.arange(len(piece)), times)
        j = low[i] + np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
        good = least[j] < doc[i]
        i, j = i[good], j[good]
        doc, ordinal, a, n = doc[i], ordinal[i], first[i] + start[j], windows[j] + LENGTH - 1
        order = np.lexsort((a, ordinal, doc))
        doc, ordinal, a, n = doc[order], ordinal[order], a[order], n[order]
        cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (ordinal[1:] != ordinal[:-1])][: len(doc)])
        at = {(int(doc[i]), int(ordinal[i])): (i, j) for i, j in zip(cut, np.r_[cut[1:], len(doc)], strict=False)}
        for i, key in enumerate(zip(ids.tolist(), _ordinals(ids, texts).tolist(), strict=True)):
            if key in at:
                x, y = at[key]
                cover[i] = (a[x:y], a[x:y] + n[x:y])
    return _result(ids.tolist(), texts, cover)


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from _result([None] * b.num_rows, utf8(b.column(1)), {}).to_batches()


def _prime(n: int) -> int:
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def remove_repeated(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` for each row of ``docs(doc_id, text)``.

    A byte goes if a LENGTH-byte string over it also starts in a document with a smaller doc_id. Rows of one doc_id do
    not remove each other's bytes; a row without doc_id neither loses bytes nor takes any; a null text is empty; texts
    shorter than LENGTH stay. Rows sent between tasks are packed arrays. Buckets and groups of documents follow the bytes
    of all texts, GROUP_BYTES each, and are never fewer than the shuffle partitions; an index takes about INDEX_BYTES of a
    bucket at a time. A passage that many documents share is sent once a group and is one string of its index.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = rows.where("doc_id is not null")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(shuffle_partitions(spark), -(-size // GROUP_BYTES))
    groups = _prime(max(3, buckets))
    schema = "bucket int, data binary"
    meet = lambda df: (df.repartition("bucket") if buckets == shuffle_partitions(spark) else df.repartition(2 * buckets, "bucket")).sortWithinPartitions("bucket")
    shared = meet(known.mapInArrow(_seeds(buckets, groups), schema)).mapInArrow(_shared(buckets, groups), schema)
    held = known.select("doc_id", "text", F.pmod("doc_id", F.lit(groups)).cast("int").alias("g")).groupBy("g")
    pieces = held.cogroup(shared.groupBy("bucket")).applyInArrow(_pieces(buckets), schema)
    marks = meet(pieces).mapInArrow(_marks(buckets), schema)
    done = held.cogroup(marks.groupBy("bucket")).applyInArrow(_apply, OUT)
    return done.unionAll(rows.where("doc_id is null").mapInArrow(_alone, OUT))


def op10_substrings(spark, sf_dir: str) -> DataFrame:
    return remove_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))
