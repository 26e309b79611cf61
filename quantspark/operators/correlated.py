"""Correlated assets from their own returns: shrunk covariances, a repaired triangular factor, and paths of assets and their basket."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dialect import SPARK

FLOOR = 1e-10
#: Assets at most: their matrix is factored on the driver.
MOST_ASSETS = 2000


def factor(cov: np.ndarray, floor: float = FLOOR) -> np.ndarray:
    """The lower triangular factor; a matrix that is not positive definite first has its eigenvalues raised to ``floor``."""
    cov = (cov + cov.T) / 2
    try:
        return np.linalg.cholesky(cov)
    except np.linalg.LinAlgError:
        values, vectors = np.linalg.eigh(cov)
        fixed = (vectors * np.maximum(values, floor)) @ vectors.T
        return np.linalg.cholesky((fixed + fixed.T) / 2 + np.eye(len(cov)) * floor)


def aligned(returns: DataFrame) -> DataFrame:
    """``(ticker, k, r, n)``: the last n returns of each ticker, k = 1 the latest, n the shortest history's length."""
    known = returns.where("r is not null").withColumn("k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("t"))))
    least = known.groupBy("ticker").agg(F.max("k").alias("n")).agg(F.min("n").alias("n"))
    return known.join(F.broadcast(least), F.col("k") <= F.col("n")).select("ticker", "k", "r", "n")


def shrunk_covariance(returns: DataFrame, shrinkage: float | None = None) -> DataFrame:
    """``(a, b, cov, n)`` of every ordered pair, per step; off the diagonal times 1 - max(0.1, min(1, assets / n))."""
    x = aligned(returns)
    assets = x.select("ticker").distinct().count()
    if assets > MOST_ASSETS:
        raise ValueError(f"{assets} assets; {MOST_ASSETS} at most")
    a, b = x.select(F.col("ticker").alias("a"), "k", F.col("r").alias("ra"), "n"), x.select(F.col("ticker").alias("b"), "k", F.col("r").alias("rb"))
    share = F.lit(float(shrinkage)) if shrinkage is not None else F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.lit(float(assets)) / F.max("n")))
    c = F.covar_samp("ra", "rb")
    return a.join(b, "k").groupBy("a", "b").agg(F.when(F.col("a") == F.col("b"), c).otherwise(c * (1 - share)).alias("cov"), F.max("n").alias("n"))


def portfolio(spark: SparkSession, returns: DataFrame, paths: int, horizon: int, weights: dict[str, float] | None = None, s0: float = 100.0, seed: int = 0, cov: DataFrame | None = None) -> DataFrame:
    """``(path, ticker, s, basket)``: each asset's value after ``horizon`` steps, and the weighted mean of the path's assets.

    Drifts are the assets' mean returns; shocks are sums over the factor's row, one draw a path and factor. Weights are equal unless
    given, and add up to 1.
    """
    rows = (shrunk_covariance(returns) if cov is None else cov).collect()
    names = sorted({r.a for r in rows})
    place = {t: i for i, t in enumerate(names)}
    c = np.zeros((len(names), len(names)))
    for r in rows:
        c[place[r.a], place[r.b]] = r.cov
    low = factor(c)
    weights = weights or {t: 1 / len(names) for t in names}
    if set(weights) - set(names) or abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError("weights name known assets and add up to 1")
    table = spark.createDataFrame([(t, j, float(low[i, j]), float(c[i, i]), float(weights.get(t, 0.0))) for t, i in place.items() for j in range(i + 1)], "ticker string, j int, w double, var double, share double")
    drift = aligned(returns).groupBy("ticker").agg(F.avg("r").alias("m"))
    shocks = spark.range(paths).withColumnRenamed("id", "path").crossJoin(F.broadcast(table))  # a factor is a few rows
    e = F.expr(SPARK.normal(seed, "'asset'", "path", "j"))
    x = shocks.groupBy("path", "ticker", "share").agg(F.sum(F.col("w") * e).alias("e")).join(F.broadcast(drift), "ticker")
    x = x.withColumn("s", s0 * F.exp(F.col("m") * horizon + F.sqrt(F.lit(float(horizon))) * F.col("e")))
    basket = x.groupBy("path").agg(F.sum(F.col("share") * F.col("s")).alias("basket"))
    return x.join(basket, "path").select("path", "ticker", "s", "basket")
