"""Every path model from one configuration, and quasi-random paths by Sobol points and a Brownian bridge."""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import DataFrame, SparkSession

from ..config import MODELS, Simulation
from ..functions.dialect import SPARK, Dialect
from ..operators.simulate import number, relation, simulate, summarize
from ..registry import plan, query
from ..sources.tables import BARS, views
from .configured import market

# Primitive polynomials (degree, coefficients) and initial direction numbers of dimensions 2 to 8.
_POLYNOMIALS = ((1, 0, (1,)), (2, 1, (1, 3)), (3, 1, (1, 3, 1)), (3, 2, (1, 1, 1)), (4, 1, (1, 1, 3, 3)), (4, 4, (1, 3, 5, 13)), (5, 2, (1, 1, 5, 5, 17)))
_BITS = 32


def direction_numbers(dimension: int, bits: int) -> list[int]:
    """The first ``bits`` direction numbers of a dimension from 0 on, as integers of 32 bits."""
    if dimension == 0:
        return [1 << (_BITS - 1 - i) for i in range(bits)]
    degree, coefficients, m = _POLYNOMIALS[dimension - 1]
    v = [x << (_BITS - 1 - i) for i, x in enumerate(m)]
    for i in range(degree, bits):
        x = v[i - degree] ^ (v[i - degree] >> degree)
        for k in range(1, degree):
            if coefficients >> (degree - 1 - k) & 1:
                x ^= v[i - k]
        v.append(x)
    return v[:bits]


def bridge_weights(steps: int) -> list[list[float]]:
    """Row t: the weights of the normals in the level of Brownian motion at time (t + 1) / steps; the first sets the end."""
    rows: list[list[float]] = [[0.0] * steps for _ in range(steps)]
    rows[-1][0] = 1.0
    spans, k = deque([(-1, steps - 1)]), 1
    while spans:
        a, b = spans.popleft()
        if b - a < 2:
            continue
        m = (a + b) // 2
        right = (m - a) / (b - a)
        left = rows[a] if a >= 0 else [0.0] * steps
        rows[m] = [right * y + (1 - right) * x for x, y in zip(left, rows[b], strict=True)]
        rows[m][k] = math.sqrt((m - a) * (b - m) / (b - a) / steps)
        k += 1
        spans += [(a, m), (m, b)]
    return rows


def sobol(d: Dialect, bits: int, dimensions: int, shifts: int) -> str:
    """``(rep, path, u0, u1, ...)``: 2^bits points, moved by one keyed digital shift a replicate and dimension."""
    cols = []
    for k in range(dimensions):
        x = f"CAST(floor({d.uniform(51, repr('shift'), 'rep', k)} * 4294967296E0) AS BIGINT)"
        for i, v in enumerate(direction_numbers(k, bits)):
            x = d.xor(x, f"(CASE WHEN path & {1 << i} <> 0 THEN CAST({v} AS BIGINT) ELSE CAST(0 AS BIGINT) END)")
        cols.append(f"({x} + 0.5E0) / 4294967296E0 AS u{k}")
    return f"SELECT rep, path, {', '.join(cols)} FROM {d.rows(1 << bits, 'path')} p CROSS JOIN {d.rows(shifts, 'rep')} r"


@plan
def mc_qmc_bridge(d: Dialect) -> str:
    """Root mean square errors over replicates of keyed draws, Sobol points by step, and Sobol points by bridge, against closed forms on two tickers' volatility.

    A path is one row: levels are fixed linear combinations of its normals, so there is no window and no shuffle but the means'.
    """
    n, bits, reps = 8, 9, 8
    step = [[1 / math.sqrt(n) if j <= t else 0.0 for j in range(n)] for t in range(n)]
    level = lambda row: " + ".join(f"{number(w)} * z{j}" for j, w in enumerate(row) if w)
    path = lambda rows: ", ".join(f"100 * exp((0.05E0 - v * v / 2) * {number((t + 1) / n)} + v * ({level(r)})) AS s{t}" for t, r in enumerate(rows))
    zs = ", ".join(f"{d.ppf(f'u{k}')} AS z{k}" for k in range(n))
    keyed = ", ".join(f"{d.normal(52, repr('plain'), 'rep', 'path', k)} AS z{k}" for k in range(n))
    logs = " + ".join(f"ln(s{t})" for t in range(n))
    sg, mg = f"(v * {number(math.sqrt((n + 1) * (2 * n + 1) / (6 * n * n)))})", f"((0.05E0 - v * v / 2) * {number((n + 1) / (2 * n))})"
    geometric = f"exp(-0.05E0) * (100 * exp({mg} + {sg} * {sg} / 2) * {d.cdf(f'(({mg} + {sg} * {sg}) / {sg})')} - 100 * {d.cdf(f'({mg} / {sg})')})"
    european = f"(100 * {d.cdf('((0.05E0 + v * v / 2) / v)')} - 100 * exp(-0.05E0) * {d.cdf('((0.05E0 - v * v / 2) / v)')})"
    return f"""WITH {BARS}, {market(d)}, vt AS (SELECT ticker, sigma AS v FROM mkt WHERE ticker IN ('1-URGENT', '5-LOW')), q AS ({sobol(d, bits, n, reps)}), zq AS (SELECT rep, path, {zs} FROM q),
zp AS (SELECT rep, path, {keyed} FROM {d.rows(1 << bits, "path")} p CROSS JOIN {d.rows(reps, "rep")} r),
s AS (SELECT 'plain' AS method, ticker, v, rep, {path(step)} FROM zp CROSS JOIN vt UNION ALL SELECT 'sobol', ticker, v, rep, {path(step)} FROM zq CROSS JOIN vt UNION ALL SELECT 'sobol_bridge', ticker, v, rep, {path(bridge_weights(n))} FROM zq CROSS JOIN vt),
m AS (SELECT method, ticker, v, rep, exp(-0.05E0) * avg(greatest(s{n - 1} - 100, 0)) AS e, exp(-0.05E0) * avg(greatest(exp(({logs}) / {n}) - 100, 0)) AS g FROM s GROUP BY method, ticker, v, rep)
SELECT method, ticker, CAST(count(*) AS BIGINT) AS replicates, round(avg(e), 6) AS european, round(sqrt(avg(pow(e - {european}, 2))), 6) AS european_rms, round(avg(g), 6) AS geometric, round(sqrt(avg(pow(g - {geometric}, 2))), 6) AS geometric_rms FROM m GROUP BY method, ticker"""


_SMALL = {"paths": 300, "horizon": 12, "seed": 61}


@plan
def mc_all_models(d: Dialect) -> str:
    """The nine models under one stressed configuration, with the figures by which they are compared."""
    runs = [(m, Simulation(model=m, mu=0.1, sigma=0.3, crash=0.05, vol_multiplier=1.2, haircut=0.4, cost=0.0005, jumps=6.0, antithetic=m in ("gbm", "kou"), **_SMALL).check()) for m in MODELS]
    body = ", ".join(relation(d, c, "hist" if m.endswith("bootstrap") else "", m) for m, c in runs)
    arms = " UNION ALL ".join(f"SELECT '{m}' AS model, s, low, high, drawdown FROM {m}" for m in MODELS)
    pick = "transform(sort_array(collect_list(named_struct('t', t, 'r', r))), e -> e.r - m)" if d.name == "spark" else "list(r - m ORDER BY t)"
    return f"""WITH {"RECURSIVE " if d.name == "duckdb" else ""}{BARS}, one AS (SELECT t, r, avg(r) OVER () AS m FROM rets WHERE ticker = '1-URGENT' AND r IS NOT NULL),
hist AS (SELECT {pick} AS h FROM one{" GROUP BY m" if d.name == "spark" else ""}), {body}
SELECT model, CAST(count(*) AS BIGINT) AS n, round(avg(s), 6) AS mean, round(stddev_samp(s), 6) AS sd, round({d.quantile("s", 0.05)}, 6) AS p05, round({d.quantile("s", 0.95)}, 6) AS p95, round(min(low), 6) AS low, round(max(high), 6) AS high,
       round(avg(drawdown), 6) AS mean_drawdown, round(min(drawdown), 6) AS worst_drawdown, round(avg(CASE WHEN s > 100 THEN 1E0 ELSE 0E0 END), 6) AS prob_profit FROM ({arms}) x GROUP BY model"""


@query()
def risk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary that `summarize` gives of one configured run, as the report's metric rows."""
    from ..sources.reports import metric_rows

    views(spark, sf_dir)
    own = spark.sql(f"WITH {BARS}, {market(SPARK)} SELECT mu, sigma FROM mkt WHERE ticker = '1-URGENT'").first()
    c = Simulation(model="heston", paths=2000, horizon=20, mu=own.mu, sigma=own.sigma, seed=62).check()
    return metric_rows(summarize(simulate(spark, c), c))
