"""Ranked lexical search: an inverted treap for each term, traversed together, with subtrees pruned that cannot enter the top k.

A document's score is the sum over the query's terms of whole-number impacts, so ranks do not depend on summation order.
Texts are read once and never shuffled: each task turns its documents into counts of the queries' terms, which are stored.
Collection statistics are grouped sums of those. Tasks then build treaps over bounded shards of documents and keep each query's
k best; only those are shuffled. Queries are taken in blocks of bounded size.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table, utf8

#: A term is a run of ASCII letters, digits and characters beyond ASCII; in UTF-8 these are the bytes below.
_TERM, _BREAK = re.compile(rb"[0-9A-Za-z\x80-\xff]+"), re.compile(rb"[^0-9A-Za-z\x80-\xff]")
#: Queries of a block and characters of their texts, on average; postings of a shard; intervals that are split together.
BLOCK_ITEMS, BLOCK_CHARS, SHARD, BEAM = 4096, 8 << 20, 2_000_000, 256
#: Bytes of a text that are cut into terms at once.
PART = 4 << 20
TOP = 20
LAST = np.iinfo(np.int64).max


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in lists, with A-Z in lower case; long texts are cut where a term ends."""
    at = 0
    while at < len(text):
        end = _BREAK.search(text, at + PART)
        to = end.start() if end else len(text)
        yield _TERM.findall(text[at:to].lower())
        at = to


def counted(text: bytes) -> tuple[int, Counter]:
    n, tf = 0, Counter()
    for part in terms(text):
        n += len(part)
        tf.update(part)
    return n, tf


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else [], kind))


def _counts(vocabulary):
    """``(doc_id, text)`` -> ``(doc_id, n, terms, tf)``: the document's length and its counts of the terms that queries hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for b in batches:
            n, ids, tfs = [], [], []
            for text in utf8(b.column(1)):
                size, tf = counted(text)
                found = list(tf.keys() & number.keys())
                n.append(size)
                ids.append(np.array([number[t] for t in found], np.int32))
                tfs.append(np.array([tf[t] for t in found], np.int64))
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), _lists(ids, pa.int32()), _lists(tfs, pa.int64())], ["doc_id", "n", "terms", "tf"])

    return run


def treap_links(impact: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Treaps over runs of nodes in search order: ``(left, right, roots)``; run i is ``first[i]:first[i + 1]``.

    A node's parent is the lesser of the nearest greater nodes on either side, equal impacts counting as greater on the
    left; those are found for all nodes at once by jumping over what is already known to be less. ``len(impact)`` is no node.
    """
    m = len(impact)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    sides = []
    for step, beats in ((-1, np.greater_equal), (1, np.greater)):
        to = np.arange(m) + step
        to[(first[:-1] if step < 0 else first[1:] - 1)[np.diff(first) > 0]] = m  # the run ends
        open_ = np.flatnonzero(to < m)
        while len(open_):
            open_ = open_[~beats(impact[to[open_]], impact[open_])]
            to[open_] = to[to[open_]]
            open_ = open_[to[open_] < m]
        sides.append(to)
    l, r = sides
    high = np.append(impact, LAST)
    from_right = (r < m) & ((l == m) | (high[r] <= high[l]))
    left, right, roots = np.full(m + 1, m, np.int32), np.full(m + 1, m, np.int32), np.full(len(first) - 1, m, np.int32)
    nodes = np.arange(m, dtype=np.int32)
    left[r[from_right]] = nodes[from_right]
    from_left = ~from_right & (l < m)
    right[l[from_left]] = nodes[from_left]
    alone = (l == m) & (r == m)
    roots[owner[alone]] = nodes[alone]
    return left, right, roots


class Shard:
    """Inverted treaps of some documents, and their postings by document for exact scores."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, vocabulary: int):
        """``ids`` ascend; postings (``doc`` is an index into ids) come in ascending order of doc."""
        self.ids, self.term, self.worth = ids, term, impact
        self.start = np.searchsorted(doc, np.arange(len(ids) + 1))
        order = np.argsort(term, kind="stable")
        first = np.searchsorted(term[order], np.arange(vocabulary + 1))
        self.pos, self.impact = np.append(doc[order], -1).astype(np.int32), np.append(impact[order], 0)
        self.left, self.right, self.roots = treap_links(impact[order], first)
        self.visited = 0

    def score(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        size = self.start[docs + 1] - self.start[docs]
        at = np.cumsum(size) - size
        flat = np.arange(size.sum()) + np.repeat(self.start[docs] - at, size)
        return np.add.reduceat(weight[self.term[flat]] * self.worth[flat], at)

    def search(self, own: np.ndarray, times: np.ndarray, weight: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """``best`` (scores falling, ids) of a query with terms ``own``, each ``times``, after this shard's documents.

        An interval of documents carries the root of each term's subtree within it: the sum of their impacts bounds every
        score there. The intervals of the highest bounds are split at the document of their strongest root.
        """
        node, low, high = self.roots[own][None, :], np.array([-1], np.int32), np.array([len(self.ids)], np.int32)
        while len(low):
            bound = (self.impact[node] * times).sum(axis=1)
            if len(best[0]) < k:
                alive = bound > 0
            else:
                alive = (bound > best[0][-1]) | (bound == best[0][-1]) & (self.ids[np.minimum(low + 1, len(self.ids) - 1)] < best[1][-1])
            node, low, high, bound = node[alive], low[alive], high[alive], bound[alive]
            if not len(low):
                break
            if len(low) > BEAM:
                order = np.argpartition(-bound, BEAM)
                now, rest = order[:BEAM], order[BEAM:]
            else:
                now, rest = np.arange(len(low)), np.arange(0)
            some, a, b = node[now], low[now], high[now]
            at = self.pos[np.take_along_axis(some, (self.impact[some] * times).argmax(axis=1)[:, None], axis=1)[:, 0]]
            best = kept(best, self.score(at, weight), self.ids[at], k)
            self.visited += len(at)
            some, a, b = np.concatenate([some, some]), np.concatenate([a, at]), np.concatenate([at, b])
            inside = b - a > 1
            some, a, b = some[inside], a[inside], b[inside]
            rows, cols = np.nonzero(some < len(self.left))
            while len(rows):  # each subtree's root moves down until it lies within the interval
                x = some[rows, cols]
                p = self.pos[x]
                to = np.where(p >= b[rows], self.left[x], np.where(p <= a[rows], self.right[x], x))
                moved = to != x
                rows, cols = rows[moved], cols[moved]
                some[rows, cols] = to[moved]
            node, low, high = np.concatenate([node[rest], some]), np.concatenate([low[rest], a]), np.concatenate([high[rest], b])
        return best


def kept(best: tuple[np.ndarray, np.ndarray], score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores above 0, equal ones by ascending id."""
    good = score > 0
    score, ids = np.concatenate([best[0], score[good]]), np.concatenate([best[1], ids[good]])
    order = np.lexsort((ids, -score))[:k]
    return score[order], ids[order]


def _search(block, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, n_docs, n_terms, queries = block.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries]
        weight = np.zeros(len(idf), np.int64)
        held, size = [], 0

        def flush():
            t = pa.Table.from_batches(held).combine_chunks()
            ids = t.column(0).fill_null(LAST).to_numpy()
            order = np.argsort(ids, kind="stable")
            t, ids = t.take(pa.array(order)), ids[order]
            length, lists, tf = t.column(1).to_numpy(), t.column(2).combine_chunks(), t.column(3).combine_chunks().flatten().to_numpy()
            term, doc = lists.flatten().to_numpy(), np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
            m = 75 + (25 * length * n_docs) // n_terms
            shard = Shard(ids, doc, term, idf[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])), len(idf))
            for i, (own, times) in enumerate(queries):
                if (shard.roots[own] < len(term)).any():
                    weight[own] = times
                    best[i] = shard.search(own, times, weight, best[i], k)
                    weight[own] = 0

        for b in batches:
            b = b.filter(pa.compute.greater(pa.compute.list_value_length(b.column(2)), 0))
            if b.num_rows:
                held.append(b)
                size += len(b.column(2).flatten())
            if size >= SHARD:
                flush()
                held, size = [], 0
        if held:
            flush()
        for i, (score, ids) in enumerate(best):
            if len(ids):
                yield pa.record_batch([pa.array(np.full(len(ids), i)), pa.array(ids, mask=ids == LAST), pa.array(score)], ["query", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the k best rows of ``docs(doc_id, text)`` for each row of ``items(item_id, text)``.

    Every row is a document or a query of its own, whether its id repeats or is null; null texts have no terms. Equal scores
    are ranked by ascending doc_id, rows without one last. A query without terms, or whose terms no document holds, has no rows.
    """
    spark = docs.sparkSession
    docs, items = docs.select(F.col("doc_id").cast("long"), "text"), items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-chars // BLOCK_CHARS))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    found = [_block(docs, rows, k) for b in range(blocks) if (rows := items.where(F.col("block") == b).select("item_id", "text").collect())]
    if not found:
        return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def _block(docs: DataFrame, items: list, k: int) -> DataFrame:
    """The answers to a block of queries, which the driver holds."""
    spark = docs.sparkSession
    bags = [counted(i.text.encode())[1] for i in items]
    number = {t: i for i, t in enumerate(sorted(set().union(*bags)))}
    counts = stored(docs.mapInArrow(_counts(spark.sparkContext.broadcast(number)), "doc_id long, n long, terms array<int>, tf array<bigint>"), "counts")
    n_docs, n_terms = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    idf = np.zeros(len(number), np.int64)
    for term, df in counts.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        idf[term] = int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))))
    queries = [(np.array([number[t] for t in bag], np.int64), np.array(list(bag.values()), np.int64)) for bag in bags]
    found = counts.where("n > 0").mapInArrow(_search(spark.sparkContext.broadcast((idf, n_docs, n_terms, queries)), k), "query long, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, x.item_id) for i, x in enumerate(items)], "query long, item_id long")
    return found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")


def op11_search(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long"), "text"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS ts FROM benchmark),
qt AS (SELECT q, term, count(*) AS times FROM (SELECT q, unnest(ts) AS term FROM i) GROUP BY q, term),
n AS (SELECT CAST(count(*) FILTER (WHERE len(ts) > 0) AS BIGINT) AS n, CAST(sum(len(ts)) AS BIGINT) AS l FROM d),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf CROSS JOIN n WHERE term IN (SELECT term FROM qt) GROUP BY term, n),
p AS (SELECT tf.r, tf.term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(d.ts) * n.n) // n.l))) AS impact FROM tf JOIN w ON w.term = tf.term JOIN d ON d.r = tf.r CROSS JOIN n),
s AS (SELECT q, r, CAST(sum(times * impact) AS BIGINT) AS score FROM qt JOIN p ON p.term = qt.term GROUP BY q, r),
k AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s JOIN d ON d.r = s.r WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k JOIN i ON i.q = k.q WHERE rank <= {TOP}"""
