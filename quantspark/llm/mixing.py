"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, sent_if_small, table, text_col

WEIGHTS, SHARE, MOST_EPOCHS = (3, 1, 2), 1.5, 2
#: Rows in a slice of a source's key range on average, and slices at least.
SLICE_ROWS, SLICES = 100_000, 256
#: Characters that lower a document's quality weight.
NOISE = "#*$%&|<>!"


def quality_weight(text: Column) -> Column:
    """From 1 down to 1/11 by the share of noise characters."""
    noise = F.length(text) - F.length(F.translate(text, NOISE, ""))
    return F.lit(1.0) / (F.lit(1.0) + F.lit(10.0) * noise / F.greatest(F.length(text), F.lit(1)))


def uniform(doc_id: Column, text: Column) -> Column:
    """A number in (0, 1) that depends on the doc_id only, or on the text where there is no doc_id."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.md5(text))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """``sizes(s, source_size)`` -> adds ``target``. A row per source; weights go round by code point, null last.

    Targets are min(weight * level, most * source_size) with the level at which they add up to ``share`` of all sizes:
    what resharing the excess by weight ends in. With sources in order of cap / weight, the level is the largest of
    (budget - caps before) / (weights from here on).
    """
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = F.row_number().over(Window.orderBy(F.col("s").isNull(), "s"))
    w = F.element_at(F.array(*map(F.lit, weights)), F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("double")
    x = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * float(most)).withColumn("budget", F.sum("source_size").over(every) * share)
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("s"))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    x = x.withColumn("level", (F.col("budget") - before) / rest)
    return x.select("s", "source_size", F.least(F.col("w") * F.max("level").over(every), F.col("cap")).alias("target"))


def _bands(rows: DataFrame) -> DataFrame:
    """``(s, bands)``: a source's rows by quality weight, as shares of at most eleven bands and their mean weights."""
    one = rows.groupBy("s", F.round(1 / F.col("w")).alias("band")).agg(F.count("*").alias("n"), F.avg("w").alias("w"))
    return one.groupBy("s").agg(F.collect_list(F.struct("n", "w")).alias("bands"))


def _below(k: Column, bands: Column) -> Column:
    """The share of a source's keys that are expected below k: keys of weight w are exponential with rate w."""
    zero = F.struct(F.lit(0.0).alias("below"), F.lit(0.0).alias("n"))
    add = lambda a, b: F.struct((a["below"] + b["n"] * (1 - F.exp(-k * b["w"]))).alias("below"), (a["n"] + b["n"]).alias("n"))
    return F.aggregate(bands, zero, add, lambda a: a["below"] / a["n"])


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for each row of ``docs(doc_id, text, source)``; columns of ``keep`` come first.

    Each document draws an exponential key -ln(u) / quality weight, u from its doc_id, so reruns agree. A source's target
    holds floor(target / source_size) complete epochs; the rest goes to documents by ascending key while their sizes'
    prefix sum stays within it, and the document on the border gives the words still missing. Keys are cut into slices
    by a monotone map that makes them even, whatever the weights: sums of slices give each slice's offset, and sorting happens within a slice, so a source with
    most of the rows is sorted in parts. Their number follows the number of rows. A null text has size 0; a null source is a source of its own; equal rows draw
    equal keys and follow one another; an empty table gives no rows.
    """
    text = text_col()
    weight = quality_weight(text)
    key = -F.log(uniform(F.col("doc_id"), text)) / weight
    rows = checkpoint(docs.select(*keep, "doc_id", F.col("source").alias("s"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), key.alias("k"), weight.alias("w")))
    slices = max(SLICES, rows.count() // SLICE_ROWS)
    own = F.least(F.floor(_below(F.col("k"), F.col("bands")) * slices), F.lit(slices - 1)).cast("int")
    bands = sent_if_small(checkpoint(_bands(rows).withColumnRenamed("s", "bs")))
    rows = rows.join(bands, F.col("s").eqNullSafe(F.col("bs"))).withColumn("slice", own).drop("bs", "bands", "w")
    parts = rows.groupBy("s", "slice").agg(F.sum("size").alias("n"))
    targets = source_targets(parts.groupBy("s").agg(F.sum("n").alias("source_size")), weights, share, most)
    before = F.sum("n").over(Window.partitionBy("s").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("s", "slice", F.coalesce(before, F.lit(0)).alias("before"))
    plan = parts.join(targets.withColumnRenamed("s", "s2"), F.col("s").eqNullSafe(F.col("s2"))).drop("s2")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("epochs", full).withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    plan = plan.withColumnRenamed("s", "ps").withColumnRenamed("slice", "pslice")
    x = rows.join(plan, F.col("s").eqNullSafe(F.col("ps")) & (F.col("slice") == F.col("pslice")))
    own = F.sum("size").over(Window.partitionBy("s", "slice").orderBy("k", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("at", F.col("before") + F.coalesce(own, F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("at")))
    return x.select(*keep, "doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source AS s, coalesce(text, '') AS t,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST(CAST(concat('0x', substr(md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 12)) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0 AS u
  FROM documents),
q AS (
  SELECT doc_id, s, size, -ln(u) / (CAST(1 AS DOUBLE) / (CAST(1 AS DOUBLE) + CAST(10 AS DOUBLE)
         * (length(t) - length(translate(t, '#*$%&|<>!', ''))) / greatest(length(t), 1))) AS k FROM d),
src AS (
  SELECT s, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY s NULLS LAST) - 1) % 3 WHEN 0 THEN CAST(3 AS DOUBLE) WHEN 1 THEN CAST(1 AS DOUBLE) ELSE CAST(2 AS DOUBLE) END AS w
  FROM q GROUP BY s),
lev AS (
  SELECT s, source_size, w, 2 * CAST(source_size AS DOUBLE) AS cap,
         (1.5 * CAST(sum(source_size) OVER () AS DOUBLE)
          - coalesce(CAST(sum(2 * source_size) OVER (ORDER BY source_size / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0))
         / sum(w) OVER (ORDER BY source_size / w, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM src),
tgt AS (SELECT s, source_size, least(w * max(level) OVER (), cap) AS target FROM lev),
x AS (
  SELECT q.doc_id, q.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS epochs,
         coalesce(CAST(sum(q.size) OVER (PARTITION BY q.s ORDER BY q.k, q.doc_id, q.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS pre
  FROM q JOIN tgt t ON q.s IS NOT DISTINCT FROM t.s)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, CAST(round(target - epochs * source_size) AS BIGINT) - pre)) AS BIGINT) AS taken
FROM x
"""
