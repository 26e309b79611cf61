"""Quantiles and tail risk of streams in bounded memory: mergeable sketches as partial aggregates and as stream state.

A sketch of size k holds some 3 k values whatever the number of rows; its rank error is about 1.7 / k at 95 %, measured in the tests.
Batches, partitions and days merge, so a sum over days is a merge of stored sketches, not a pass over their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values by which a sketch is sized, and points at which a tail is averaged.
SIZE, TAIL_POINTS = 400, 64


def sketches(rows: DataFrame, value: str, *by: str, size: int = SIZE) -> DataFrame:
    """``(by..., n, total, squares, least, most, sketch)``, in batch or as a stream with state; nulls and NaN are left out."""
    x = F.when(~F.isnan(value), F.col(value))
    return rows.groupBy(*by).agg(
        F.count(x).alias("n"), F.sum(x).alias("total"), F.sum(x * x).alias("squares"), F.min(x).alias("least"), F.max(x).alias("most"), F.kll_sketch_agg_double(x, F.lit(size)).alias("sketch")
    )


def merge(parts: DataFrame, *by: str) -> DataFrame:
    """Sketches of parts as those of the whole."""
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.min("least").alias("least"), F.max("most").alias("most"), F.kll_merge_agg_double("sketch").alias("sketch"))


def quantile(sketch: Column, p: float) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(float(p)))


def composite_risk(found: DataFrame, *by: str, level: float = 0.95) -> DataFrame:
    """``(by..., n, mean, sd, least, most, median, var, es)``: losses are negative values; the shortfall is the mean of quantiles in the tail.

    A group without values has n 0 and nulls.
    """
    tail = [(i + 0.5) / TAIL_POINTS * (1 - level) for i in range(TAIL_POINTS)]
    some = F.col("n") > 0
    es = sum((F.kll_sketch_get_quantile_double("sketch", F.lit(p)) for p in tail), F.lit(0.0)) / TAIL_POINTS
    mean = F.col("total") / F.col("n")
    sd = F.when(F.col("n") > 1, F.sqrt(F.greatest(F.lit(0.0), (F.col("squares") - F.col("total") * mean) / (F.col("n") - 1))))
    return found.select(*by, "n", F.when(some, mean).alias("mean"), sd.alias("sd"), "least", "most", *[F.when(some, c).alias(k) for k, c in (("median", quantile(F.col("sketch"), 0.5)), ("var", -quantile(F.col("sketch"), 1 - level)), ("es", -es))])
