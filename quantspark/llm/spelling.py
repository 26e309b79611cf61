"""Spellings: an interpolated modified Kneser-Ney model of four-grams over 64 classes of characters.

The classes bound its tables (64^4) whatever the corpus, so they may go to all tasks. It gives words that the word model has
not seen a chance, and is the last back-off of those that it has.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER, CLASSES = 4, 64
#: Characters of one class each from 27 on, after the classes 1 to 26 of a to z.
_SINGLE = "äöüßéèêçàñóíáúâîôûëï .,!|\n"
_SYMBOLS, _JOINS = "#*$%&<>^~\\", "@=/-_+:;"
REPEATED = "\ue000"  # stands for a word equal to the one before


def _class_table() -> np.ndarray:
    t = np.full(0x300, 63, np.uint8)
    for i in range(26):
        t[ord("a") + i], t[ord("A") + i] = 1 + i, 55
    for i, c in enumerate(_SINGLE):
        t[ord(c)] = 27 + i
    for c in "AEIOU":
        t[ord(c)] = 54
    for c in range(0xC0, 0x300):
        if t[c] == 63 and chr(c).isalpha():
            t[c] = 56 if chr(c).isupper() else 57
    for group, number in ((_SYMBOLS, 58), (_JOINS, 59), ("0123456789", 60), ("\t\r\x0b\x0c", 27 + _SINGLE.index(" "))):
        for c in group:
            t[ord(c)] = number
    return t


_TABLE = _class_table()
REPEAT_CLASS = 61
#: Steps of the table's logarithms to one power of ten.
SCALE = 3000


def symbols(text: str, mark: bool = True) -> np.ndarray:
    """Classes of the text's characters, a space before it, one after it. Characters from U+0300 on share the classes of
    letters by a hash, so that a language in another script has n-grams of its own.

    With ``mark``, a word equal to the one before becomes one class of its own, which training never sees.
    """
    words = text.split(" ") if mark else []
    if any(map(eq, words, islice(words, 1, None))):
        text = " ".join(REPEATED if i and w and w == words[i - 1] else w for i, w in enumerate(words))
    points = np.frombuffer(f"   {text} ".encode("utf-32-le", "surrogatepass"), "<u4")
    out = _TABLE[np.minimum(points, 0x2FF)]
    high = points >= 0x300
    if high.any():
        out = out.copy()
        out[high] = np.where(points[high] == 0xE000, REPEAT_CLASS, 1 + (points[high] * np.uint32(2654435761) >> np.uint32(8)) % 53)
    return out


def codes(text: str, mark: bool = True) -> np.ndarray:
    """Four-grams as numbers in base 64."""
    s = symbols(text, mark).astype(np.int32)
    return ((s[:-3] * CLASSES + s[1:-2]) * CLASSES + s[2:-1]) * CLASSES + s[3:]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts of four-grams; distinct ones are merged before many are held."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        code, back = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
        return code, np.bincount(back, np.concatenate([n for _, n in held]), len(code)).astype(np.int64)

    for b in batches:
        for text in b.column(0).to_pylist():
            held.append(np.unique(codes(text or "", False), return_counts=True))
            size += len(held[-1][0])
            if size > 1 << 20:
                held = [merged()]
                size = len(held[0][0]) // 2
    if held:
        code, n = merged()
        yield pa.record_batch([pa.array(code, pa.int64()), pa.array(n)], ["code", "n"])


def discounts(c: Sequence[int]) -> list[float]:
    """D1, D2, D3+ from how many n-grams occur once, twice, three and four times; where those are too few, 0.5, 1 and 1.5 stand in."""
    y = c[0] / max(1, c[0] + 2 * c[1])
    return [max(0.05, min(k - 0.05, k - (k + 1) * y * c[k] / c[k - 1])) if c[k - 1] and c[k] else 0.5 * k for k in (1, 2, 3)]


def _discounted(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Codes of one order in ascending order with their counts -> (code, part, back): the discounted share and the context's back-off weight."""
    d = discounts([int((n == k).sum()) for k in (1, 2, 3, 4)])
    own = np.minimum(np.array([0.0, *d])[np.minimum(n, 3)], n)
    _, head, of = np.unique(code // CLASSES, return_index=True, return_inverse=True)
    total, freed = np.add.reduceat(n, head), np.add.reduceat(own, head)
    return code.astype(np.int32), (n - own) / total[of], (freed / total)[of]


def train(trusted: DataFrame) -> list[tuple[np.ndarray, ...]] | None:
    """For each order, (code, part, back) arrays of what trusted text holds; None without trusted text.

    ``trusted(text)``: every trusted text counts in full. Below the highest order a code's count is the number of
    classes seen before it, gathered from the next higher order's codes. All texts are counted by Spark, in one query; the
    counts, at most 64^4 by the alphabet, come as Arrow, and the lower orders and the discounts follow from them. As joins
    of the counts they were a dozen queries over a few rows, whose plans took more of the driver's memory than the counts.
    """
    t = trusted.select("text").mapInArrow(_counts, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    code, n = (t.column(c).to_numpy() for c in ("code", "n"))
    if not len(code):
        return None
    order = np.argsort(code)
    code, n = code[order], n[order]
    tables = []
    for size in range(ORDER, 0, -1):
        tables.append(_discounted(code, n))
        code, n = np.unique(code % CLASSES ** (size - 1), return_counts=True)
    return tables[::-1]


def log_table(model: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    """-log10 of the interpolated chance of every four-gram's last class, given the three before, in steps of 1 / SCALE.

    16-bit whole numbers, 33 MB: sums do not depend on their order. Built in parts, beside the tables of lower orders.
    """
    lower = np.full(1, 1.0 / CLASSES)
    for order, (code, part, back) in enumerate(model, 1):
        size = CLASSES**order
        low = max(1, size // CLASSES) if order > 1 else 1
        weight = np.ones(size // CLASSES)
        weight[code // CLASSES] = back
        out = np.empty(size, np.uint16 if order == ORDER else np.float64)
        for at in range(0, size, 1 << 18):
            k = np.arange(at, min(size, at + (1 << 18)))
            p = weight[k // CLASSES] * lower[k % low]
            i, j = np.searchsorted(code, [at, at + len(k)])
            p[code[i:j] - at] += part[i:j]
            out[at : at + len(k)] = np.minimum(np.round(-np.log10(p) * SCALE), 65535) if order == ORDER else p
        lower = out
    return lower


@lru_cache(maxsize=1)
def table_of(held: Broadcast) -> np.ndarray:
    return log_table(held.value)


