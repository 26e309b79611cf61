"""Early exercise by least-squares regression on two independent sets of paths."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import stored

DEGREE = 3


def _paths(spark: SparkSession, seed: int, n: int, dates: int, s0: float, rate: float, sigma: float, dt: float) -> DataFrame:
    """``(path, s)``: the prices at the exercise dates, in the path's row."""
    u = lambda k: (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("path"), k)), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    z = F.transform(F.sequence(F.lit(1), F.lit(dates)), lambda i: F.sqrt(-2 * F.log(u(F.concat(F.lit("a"), i)))) * F.cos(2 * F.pi() * u(F.concat(F.lit("b"), i))))
    x = F.aggregate("z", F.array(F.lit(float(np.log(s0)))), lambda acc, e: F.concat(acc, F.array(F.element_at(acc, -1) + (rate - sigma * sigma / 2) * dt + sigma * float(np.sqrt(dt)) * e)))
    return spark.range(n).select(F.col("id").alias("path")).withColumn("z", z).select("path", F.transform(F.slice(x, 2, dates), lambda v: F.exp(v)).alias("s"))


#: Dates after which cash and the paths are written out: expressions of this many dates are nested, never more.
CUT = 8


def least_squares_put(spark: SparkSession, s0: float, strike: float, rate: float, sigma: float, years: float, dates: int, paths: int, seed: int = 17) -> DataFrame:
    """One row ``(price, std_error, european, paths)``. The policy is fitted on one set of paths and valued on another.

    Backward over the dates, continuation is regressed on powers of moneyness among paths in the money, if they are
    more than DEGREE + 1; a date is one aggregate of normal equations. Cash is a column that is written out every CUT dates.
    """
    dt = years / dates
    held = float(np.exp(-rate * dt))
    cash = F.greatest(F.lit(strike) - F.element_at("s", dates), F.lit(0.0))
    state = stored(_paths(spark, seed, paths, dates, s0, rate, sigma, dt).withColumn("cash", cash), "paths")
    policy: list[tuple[int, list[float]]] = []
    for k in range(dates - 1, 0, -1):
        m = F.element_at("s", k) / strike
        state = state.withColumn("cash", F.col("cash") * held)
        itm = F.element_at("s", k) < strike
        aggs = [F.sum(F.when(itm, m**p)).alias(f"x{p}") for p in range(2 * DEGREE + 1)] + [F.sum(F.when(itm, m**p * F.col("cash"))).alias(f"y{p}") for p in range(DEGREE + 1)]
        row = state.agg(*aggs).first()
        if row["x0"] and row["x0"] > DEGREE + 1:
            a = np.array([[row[f"x{i + j}"] for j in range(DEGREE + 1)] for i in range(DEGREE + 1)])
            beta = np.linalg.lstsq(a, np.array([row[f"y{i}"] for i in range(DEGREE + 1)]), rcond=None)[0].tolist()
            policy.append((k, beta))
            cont = sum((b * m**p for p, b in enumerate(beta)), F.lit(0.0))
            state = state.withColumn("cash", F.when(itm & (strike - F.element_at("s", k) >= cont), strike - F.element_at("s", k)).otherwise(F.col("cash")))
        if (dates - k) % CUT == 0:
            state = stored(state, "paths")
    terms = F.array(*[F.struct(F.lit(k).alias("k"), F.array(*map(F.lit, beta)).alias("b")) for k, beta in policy]) if policy else F.array().cast("array<struct<k:int,b:array<double>>>")
    fresh = _paths(spark, seed + 977231, paths, dates, s0, rate, sigma, dt)
    european = F.greatest(F.lit(strike) - F.element_at("s", dates), F.lit(0.0)) * float(np.exp(-rate * dt * dates))

    def earlier(value, t):  # from the last date to the first: earlier exercise wins
        price = F.element_at("s", t["k"])
        cont = sum((F.element_at(t["b"], p + 1) * F.pow(price / strike, F.lit(float(p))) for p in range(DEGREE + 1)), F.lit(0.0))
        now = strike - price
        return F.when((now > 0) & (now >= cont), now * F.exp(-rate * dt * t["k"])).otherwise(value)

    value = F.aggregate(terms, european, earlier)
    return fresh.select(value.alias("v"), european.alias("e")).agg(F.round(F.avg("v"), 6).alias("price"), F.round(F.stddev_samp("v") / F.sqrt(F.count("*")), 6).alias("std_error"), F.round(F.avg("e"), 6).alias("european"), F.count("*").alias("paths"))
