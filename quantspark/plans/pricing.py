"""Payoffs of simulated paths, Greeks, closed forms, early exercise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import SPARK, Dialect
from ..operators.early_exercise import least_squares_put
from ..registry import plan, query
from ..sources.tables import BARS, views
from .configured import market

_R, _N = 0.05, 25


@plan
def opt_payoffs(d: Dialect) -> str:
    """All payoffs on each ticker's volatility, as columns of one row a path: barriers and extremes include the start, averages do not."""
    z = d.normal(31, "'o'", "path", "step")
    pay = {
        "european": "greatest(s - 100, 0)", "put": "greatest(100 - s, 0)", "asian": "greatest(a - 100, 0)", "geometric": "greatest(g - 100, 0)", "digital": "CASE WHEN s > 100 THEN 1E0 ELSE 0E0 END",
        "down_out": "CASE WHEN lo <= 85 THEN 0E0 ELSE greatest(s - 100, 0) END", "down_in": "CASE WHEN lo <= 85 THEN greatest(s - 100, 0) ELSE 0E0 END", "up_out": "CASE WHEN hi >= 130 THEN 0E0 ELSE greatest(s - 100, 0) END",
        "up_in": "CASE WHEN hi >= 130 THEN greatest(s - 100, 0) ELSE 0E0 END", "lookback_fixed": "greatest(hi - 100, 0)", "lookback_floating": "s - lo",
    }
    cols = "ticker, " + ", ".join(f"round(exp(-{_R}E0) * avg({p}), 6) AS {k}, round(exp(-{_R}E0) * stddev_samp({p}) / sqrt(CAST(count(*) AS DOUBLE)), 6) AS {k}_se" for k, p in pay.items())
    return f"""WITH {BARS}, {market(d)}, x AS (SELECT ticker, path, step, sum((0.05E0 - sigma * sigma / 2) / {_N} + sigma * sqrt(1E0 / {_N}) * {z}) OVER (PARTITION BY ticker, path ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lx
  FROM {d.rows(800, "path")} p CROSS JOIN {d.steps(_N, "step")} q CROSS JOIN mkt),
o AS (SELECT ticker, path, 100 * exp(max(CASE WHEN step = {_N} THEN lx END)) AS s, avg(100 * exp(lx)) AS a, 100 * exp(avg(lx)) AS g, least(100E0, min(100 * exp(lx))) AS lo, greatest(100E0, max(100 * exp(lx))) AS hi FROM x GROUP BY ticker, path)
SELECT {cols} FROM o GROUP BY ticker"""


@plan
def opt_closed_forms(d: Dialect) -> str:
    """Black-Scholes price and Greeks, digital, down-and-in and -out calls, geometric Asian, shifted barrier."""
    d1, d2 = "((ln(s / 100) + (0.05E0 + v * v / 2) * 1) / v)", "((ln(s / 100) + (0.05E0 - v * v / 2) * 1) / v)"
    lam = "((0.05E0 + v * v / 2) / (v * v))"
    y = f"(ln(b * b / (s * 100)) / v + {lam} * v)"
    di = f"(s * pow(b / s, 2 * {lam}) * {d.cdf(y)} - 100 * exp(-0.05E0) * pow(b / s, 2 * {lam} - 2) * {d.cdf(f'({y} - v)')})"
    call = f"(s * {d.cdf(d1)} - 100 * exp(-0.05E0) * {d.cdf(d2)})"
    n = 252
    sg, mg = f"(v * sqrt({(n + 1) * (2 * n + 1) / (6 * n * n)!r}E0))", f"((0.05E0 - v * v / 2) * {(n + 1) / (2 * n)!r}E0)"
    g1 = f"((ln(s / 100) + {mg} + {sg} * {sg}) / {sg})"
    spots = " UNION ALL ".join(f"SELECT {s}E0 AS s" for s in (90, 100, 110))
    return f"""WITH {BARS}, {market(d)}, x AS (SELECT ticker, s, sigma AS v, 85 * exp(-0.5826E0 * sigma * sqrt(1E0 / 252)) AS b FROM mkt CROSS JOIN ({spots}) q)
SELECT ticker, s, round({call}, 5) AS bs_call, round({call} - s + 100 * exp(-0.05E0), 5) AS bs_put, round({d.cdf(d1)}, 6) AS delta, round({d.pdf(d1)} / (s * v), 6) AS gamma,
       round(s * {d.pdf(d1)}, 6) AS vega, round(exp(-0.05E0) * {d.cdf(d2)}, 6) AS digital, round(exp(-0.05E0) * {d.pdf(d2)} / (s * v), 6) AS digital_delta,
       round({di}, 5) AS down_in, round({call} - {di}, 5) AS down_out,
       round(exp(-0.05E0) * (s * exp({mg} + {sg} * {sg} / 2) * {d.cdf(g1)} - 100 * {d.cdf(f'({g1} - {sg})')}), 5) AS geometric_asian
FROM x"""


@plan
def greeks(d: Dialect) -> str:
    """Pathwise, likelihood-ratio and common-draw finite-difference estimators on each ticker's volatility, from one set of draws."""
    f = lambda s0, v: f"(exp(-0.05E0) * greatest({s0} * exp(0.05E0 - ({v}) * ({v}) / 2 + ({v}) * z) - 100, 0))"
    e = lambda x, k: f"round(avg({x}), 6) AS {k}, round(stddev_samp({x}) / sqrt(CAST(count(*) AS DOUBLE)), 6) AS {k}_se"
    s = "(100 * exp(0.05E0 - v * v / 2 + v * z))"
    itm = f"(CASE WHEN {s} > 100 THEN exp(-0.05E0) ELSE 0E0 END)"
    pay = f("100", "v")
    return f"""WITH {BARS}, {market(d)}, z AS (SELECT ticker, sigma AS v, path, {d.normal(32, repr('g'), 'path')} AS z FROM {d.rows(4000, "path")} p CROSS JOIN mkt)
SELECT ticker, {e(f"{itm} * {s} / 100", "pw_delta")}, {e(f"{itm} * {s} * (z - v)", "pw_vega")}, {e(f"{pay} * z / (100 * v)", "lr_delta")},
       {e(f"{pay} * ((z * z - 1) / v - z)", "lr_vega")}, {e(f"{pay} * ((z * z - 1) / (10000 * v * v) - z / (10000 * v))", "lr_gamma")}, {e(f"{itm} * z / (100 * v)", "digital_delta")},
       {e(f"({f('101', 'v')} - {f('99', 'v')}) / 2", "fd_delta")}, {e(f"({f('100', '(v + 0.01E0)')} - {f('100', '(v - 0.01E0)')}) / 0.02E0", "fd_vega")} FROM z GROUP BY ticker"""


@query()
def opt_american_lsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """American put on a ticker's volatility by least squares; regression sums are aggregates, only 4 x 4 systems are solved on the driver."""
    views(spark, sf_dir)
    sigma = spark.sql(f"WITH {BARS}, {market(SPARK)} SELECT sigma FROM mkt WHERE ticker = '1-URGENT'").first().sigma
    return least_squares_put(spark, s0=36.0, strike=40.0, rate=0.06, sigma=sigma, years=1.0, dates=10, paths=4000).withColumn("sigma", F.round(F.lit(sigma), 8))
