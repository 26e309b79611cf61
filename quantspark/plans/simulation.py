"""Path simulation and risk statistics.

Additive models are sums of keyed draws by path: one partial aggregation, no prefix sums unless a path statistic needs
them. Models with state are folds within a path's row, so no step is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import MODELS
from ..functions.dialect import DUCK, SPARK, Dialect
from ..registry import oracle, plan, query
from ..sources.scratch import stored
from ..sources.tables import BARS, views
from .configured import _recursive, by_ticker, compared, market

PATHS, STEPS = 2000, 20
_CONSENSUS = """md AS (SELECT ticker, median(expected_ending_value) AS mm, median(percentile_5) AS mq FROM compared GROUP BY ticker)
SELECT c.ticker, model, round(expected_ending_value, 5) AS mean, round(percentile_5, 5) AS p05, round(mm, 5) AS consensus_mean, round(mq, 5) AS consensus_p05, round(distance, 5) AS distance, disagreement_rank AS disagreement, most_conservative FROM compared c JOIN md ON md.ticker = c.ticker"""
_DT = "(1E0 / 252)"


def _summary(d: Dialect, by: str = "") -> str:
    first, last = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return f"""
SELECT {first}CAST(count(*) AS BIGINT) AS n, round(avg(s), 6) AS mean, round(stddev_samp(s), 6) AS sd, round({d.quantile("s", 0.05)}, 6) AS p05,
       round({d.quantile("s", 0.5)}, 6) AS p50, round({d.quantile("s", 0.95)}, 6) AS p95, round(avg(CASE WHEN s < 100 THEN 1E0 ELSE 0E0 END), 6) AS prob_loss FROM {"runs" if by else "term"}{last}"""


def _model(d: Dialect, model: str, paths: int, seed: int, more: dict[str, str] | None = None) -> str:
    """One model for every ticker, with the drift and volatility of its history."""
    return f"WITH {_recursive(d)}{BARS}, {by_ticker(d, (model,), paths, STEPS, seed, more)} {_summary(d, 'ticker')}"


@plan
def mc_gbm_risk(d: Dialect) -> str:
    """Calibrated geometric Brownian motion, costs, value at risk and expected shortfall (with a fallback to the worst)."""
    z = d.normal(1, "'gbm'", "path", "step")
    return f"""WITH {BARS},
par AS (SELECT 252 * avg(r) + 126 * var_samp(r) AS mu, stddev_samp(r) * sqrt(252E0) AS sigma FROM rets WHERE ticker = '1-URGENT'),
g AS (SELECT path, step FROM {d.rows(PATHS, "path")} p CROSS JOIN {d.steps(STEPS, "step")} q),
term AS (
  SELECT path, 100 * exp(sum((mu - sigma * sigma / 2) * {_DT} + sigma * sqrt({_DT}) * {z})) * (1 - 0.001E0) - 100 * 0.001E0 AS s
  FROM g CROSS JOIN par GROUP BY path),
lev AS (SELECT {d.quantile("s - 100", 0.05)} AS cut, {d.quantile("s - 100", 0.01)} AS cut99, min(s - 100) AS worst FROM term)
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(s), 6) AS mean, round(stddev_samp(s), 6) AS sd, round(-max(cut), 6) AS var95, round(-max(cut99), 6) AS var99,
       round(-coalesce(avg(CASE WHEN s - 100 <= cut THEN s - 100 END), max(worst)), 6) AS es95,
       round(-coalesce(avg(CASE WHEN s - 100 <= cut99 THEN s - 100 END), max(worst)), 6) AS es99,
       round(avg(CASE WHEN s > 100 THEN 1E0 ELSE 0E0 END), 6) AS prob_profit, round(avg(CASE WHEN s < 100 THEN 1E0 ELSE 0E0 END), 6) AS prob_loss,
       round(sqrt(avg(CASE WHEN s < 100 THEN (s / 100 - 1) * (s / 100 - 1) END)), 6) AS downside
FROM term CROSS JOIN lev"""


@plan
def risk_percentiles(d: Dialect) -> str:
    """Percentiles of each ticker's ending values."""
    rows = " UNION ALL ".join(f"SELECT ticker, {p} AS pct, round({d.quantile('s', p / 100)}, 6) AS value FROM runs GROUP BY ticker" for p in (1, 5, 10, 25, 50, 75, 90, 95, 99))
    return f"WITH {_recursive(d)}{BARS}, {by_ticker(d, ('gbm',), 800, STEPS, 1)} {rows}"


@plan
def mc_student_t(d: Dialect) -> str:
    """Five degrees of freedom: a normal over the root of a mean of five squared normals, scaled to unit variance."""
    return _model(d, "student_t", 300, 2)


def _bootstrap(d: Dialect, index: str) -> str:
    return f"""WITH {BARS},
hist AS (SELECT CAST(row_number() OVER (ORDER BY t) - 1 AS BIGINT) AS k, r - avg(r) OVER () AS c, CAST(count(*) OVER () AS BIGINT) AS n FROM rets WHERE ticker = '1-URGENT' AND r IS NOT NULL),
size AS (SELECT max(n) AS n FROM hist),
g AS (SELECT path, step FROM {d.rows(PATHS, "path")} p CROSS JOIN {d.steps(STEPS, "step")} q),
pick AS (SELECT path, step, {index} AS k FROM g CROSS JOIN size),
term AS (SELECT path, 100 * exp(sum(c + 0.0003E0)) AS s FROM pick JOIN hist USING (k) GROUP BY path) {_summary(d)}"""


@plan
def mc_bootstrap(d: Dialect) -> str:
    return _bootstrap(d, f"CAST(floor({d.uniform(3, repr('boot'), 'path', 'step')} * n) AS BIGINT)")


@plan
def mc_block_bootstrap(d: Dialect) -> str:
    """All paths begin blocks in phase, so the index has a closed form and wraps at the end of the history."""
    start = d.uniform(4, "'block'", "path", "CAST(floor((step - 1) / 5E0) AS INT)")
    return _bootstrap(d, f"CAST((CAST(floor({start} * n) AS BIGINT) + (step - 1) % 5) % n AS BIGINT)")


@plan
def mc_merton(d: Dialect) -> str:
    """Compensated drift, a Poisson number of normal jumps a step."""
    return _model(d, "merton", 600, 5)


@plan
def mc_kou(d: Dialect) -> str:
    """Double-exponential jumps; each jump of a step has its own sign and size."""
    return _model(d, "kou", 300, 6)


@plan
def mc_heston(d: Dialect) -> str:
    """Full truncation: the price moves with the variance before its update."""
    return _model(d, "heston", 400, 7)


@plan
def mc_garch(d: Dialect) -> str:
    """The variance of a step follows from the last shock and the last variance."""
    return _model(d, "garch", 400, 8)


@plan
def mc_regime(d: Dialect) -> str:
    """Normal, volatile and crash regimes; the transition is drawn first and the new regime drives the step."""
    return _model(d, "regime", 300, 9)


@plan
def mc_antithetic(d: Dialect) -> str:
    """Plain, antithetic (second half of the paths negates the first) and control-variate means with standard errors, at two sizes."""
    return f"""WITH {BARS}, {market(d)}, sizes AS (SELECT 500 AS size UNION ALL SELECT {PATHS}),
z AS (SELECT path, {d.normal(10, repr('a'), 'path')} AS z FROM {d.rows(PATHS, "path")} p),
s AS (SELECT ticker, size, path, z, 100 * exp(mu - sigma * sigma / 2 + sigma * z) AS a, 100 * exp(mu - sigma * sigma / 2 - sigma * z) AS b FROM z CROSS JOIN mkt CROSS JOIN sizes WHERE path < size),
b AS (SELECT ticker, size, covar_samp(a, z) / var_samp(z) AS beta FROM s GROUP BY ticker, size)
SELECT s.ticker, s.size, round(avg(a), 6) AS plain, round(stddev_samp(a) / sqrt(CAST(count(*) AS DOUBLE)), 6) AS plain_se, round(avg((a + b) / 2), 6) AS anti,
       round(stddev_samp((a + b) / 2) / sqrt(CAST(count(*) AS DOUBLE)), 6) AS anti_se, round(avg(a - beta * z), 6) AS control,
       round(stddev_samp(a - beta * z) / sqrt(CAST(count(*) AS DOUBLE)), 6) AS control_se
FROM s JOIN b ON b.ticker = s.ticker AND b.size = s.size GROUP BY s.ticker, s.size"""


@plan
def mc_drawdown(d: Dialect) -> str:
    """Running maxima include the start; the longest stretch below a former maximum by gaps and islands; a path is a group of its own."""
    z = d.normal(11, "'z'", "path", "step")
    o = "(PARTITION BY ticker, path ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""WITH {BARS}, {market(d)}, g AS (SELECT ticker, mu, sigma, path, step FROM {d.rows(150, "path")} p CROSS JOIN {d.steps(60, "step")} q CROSS JOIN mkt),
px AS (SELECT ticker, path, step, 100 * exp(sum((mu - sigma * sigma / 2) / 252 + sigma * sqrt(1E0 / 252) * {z} + CASE WHEN step = 1 THEN ln(0.99E0) ELSE 0E0 END) OVER {o}) AS s FROM g),
pk AS (SELECT ticker, path, step, s, greatest(100E0, max(s) OVER {o}) AS m FROM px),
isl AS (SELECT ticker, path, s, m, sum(CASE WHEN s >= m THEN 1 ELSE 0 END) OVER {o} AS island FROM pk),
run AS (SELECT ticker, path, island, sum(CASE WHEN s < m THEN 1 ELSE 0 END) AS n, min(s / m - 1) AS dd, min(s) AS low FROM isl GROUP BY ticker, path, island),
one AS (SELECT ticker, path, max(n) AS longest, min(dd) AS dd, min(low) AS low FROM run GROUP BY ticker, path)
SELECT ticker, round(avg(dd), 6) AS mean_dd, round(min(dd), 6) AS worst_dd, round({d.quantile("dd", 0.05)}, 6) AS p05_dd, round(avg(CAST(longest AS DOUBLE)), 6) AS mean_underwater,
       CAST(max(longest) AS BIGINT) AS max_underwater, round(avg(CASE WHEN low <= 85 THEN 1E0 ELSE 0E0 END), 6) AS prob_ruin FROM one GROUP BY ticker"""


@plan
def sample_paths(d: Dialect) -> str:
    """The first five paths of every ticker, step by step from the last close: what a chart of paths shows."""
    z = d.normal(14, "'sample'", "path", "step")
    return f"""WITH {BARS}, {market(d)}, g AS (SELECT ticker, s0, mu, sigma, path, step FROM {d.rows(5, "path")} p CROSS JOIN {d.steps(STEPS, "step")} q CROSS JOIN mkt),
w AS (SELECT ticker, path, step, s0 * exp(sum((mu - sigma * sigma / 2) * {_DT} + sigma * sqrt({_DT}) * {z}) OVER (PARTITION BY ticker, path ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS price FROM g)
SELECT ticker, path, CAST(step AS INT) AS step, round(price, 6) AS price FROM w UNION ALL SELECT ticker, path, 0, round(s0, 6) FROM {d.rows(5, "path")} p CROSS JOIN mkt"""


@plan
def mc_convergence(d: Dialect) -> str:
    """Running means at log-spaced numbers of paths: sums between them, then a prefix over eight rows a ticker."""
    at = (10, 20, 50, 100, 200, 500, 1000, 2000)
    place = "CASE " + " ".join(f"WHEN path < {n} THEN {n}" for n in at) + " END"
    return f"""WITH {BARS}, {market(d)}, s AS (SELECT ticker, {place} AS n, 100 * exp(mu - sigma * sigma / 2 + sigma * {d.normal(1, "'cv'", "path")}) AS s FROM {d.rows(PATHS, "path")} p CROSS JOIN mkt),
g AS (SELECT ticker, n, sum(s) AS s FROM s GROUP BY ticker, n)
SELECT ticker, CAST(n AS BIGINT) AS n, round(sum(s) OVER (PARTITION BY ticker ORDER BY n) / n, 6) AS running_mean FROM g"""


@plan
def evt_tail(d: Dialect) -> str:
    """Peaks of a ticker's yearly losses over their 95th percentile; generalised Pareto by moments; infinite shortfall where xi is 1 or more."""
    z = d.normal(12, "'e'", "path")
    lv = " UNION ALL ".join(f"SELECT {p}E0 AS lev" for p in (0.95, 0.99, 0.995, 0.999))
    return f"""WITH {BARS}, {market(d)}, l AS (SELECT ticker, -(exp(mu - sigma * sigma / 2 + sigma * {z}) - 1) AS loss FROM {d.rows(PATHS, "path")} p CROSS JOIN mkt),
th AS (SELECT ticker, {d.quantile("loss", 0.95)} AS u, CAST(count(*) AS DOUBLE) AS n FROM l GROUP BY ticker),
f AS (SELECT l.ticker, u, n, CAST(count(*) AS DOUBLE) AS k, avg(loss - u) AS m, var_samp(loss - u) AS v FROM l JOIN th ON th.ticker = l.ticker WHERE loss > u GROUP BY l.ticker, u, n),
g AS (SELECT ticker, u, n, k, 0.5E0 * (1 - m * m / v) AS xi, 0.5E0 * m * (m * m / v + 1) AS beta FROM f),
q AS (SELECT ticker, lev, u, xi, beta, k, CASE WHEN abs(xi) < 1E-9 THEN u - beta * ln((1 - lev) * n / k) ELSE u + beta / xi * (pow((1 - lev) * n / k, -xi) - 1) END AS var FROM g CROSS JOIN ({lv}) a)
SELECT ticker, round(lev, 4) AS level, CAST(k AS BIGINT) AS exceedances, round(xi, 6) AS xi, round(beta, 6) AS beta, round(var, 6) AS var, CASE WHEN xi >= 1 THEN CAST('Infinity' AS DOUBLE) ELSE round((var + beta - xi * u) / (1 - xi), 6) END AS es FROM q"""


_SHRUNK = """tail AS (SELECT ticker, r, row_number() OVER (PARTITION BY ticker ORDER BY t DESC) AS k FROM rets WHERE r IS NOT NULL),
m AS (SELECT min(n) AS n, count(*) AS k FROM (SELECT ticker, max(k) AS n FROM tail GROUP BY ticker) x),
al AS (SELECT ticker, tail.k, r FROM tail CROSS JOIN m WHERE tail.k <= m.n),
c AS (SELECT a.ticker AS a, b.ticker AS b, covar_samp(a.r, b.r) AS c, corr(a.r, b.r) AS rho FROM al a JOIN al b ON a.k = b.k GROUP BY a.ticker, b.ticker),
sh AS (SELECT a, b, CASE WHEN a = b THEN c ELSE c * (1 - greatest(0.1E0, least(1E0, CAST(m.k AS DOUBLE) / m.n))) END AS cov, rho FROM c CROSS JOIN m)"""


@plan
def cov_shrink(d: Dialect) -> str:
    """Returns aligned by position from the end; covariances shrunk to their diagonal by max(0.1, min(1, k / n))."""
    return f"WITH {BARS}, {_SHRUNK} SELECT a, b, round(cov * 1000000, 6) AS shrunk, round(rho, 6) AS rho FROM sh"


TICKERS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _factor() -> str:
    """Relations that end in ``fc(i, j, w)``: the triangular factor of the tickers' shrunk covariances, a column of it after the other."""
    n = len(TICKERS)
    pivot = ", ".join(f"max(CASE WHEN a = '{TICKERS[i]}' AND b = '{TICKERS[j]}' THEN cov END) AS c{i}{j}" for i in range(n) for j in range(i + 1))
    out = [f"f0 AS (SELECT {pivot} FROM sh)"]
    for j in range(n):
        done = lambda i, j=j: f"c{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
        out.append(f"g{j} AS (SELECT *, sqrt({done(j)}) AS l{j}{j} FROM f{j})")
        below = "".join(f", ({done(i)}) / l{j}{j} AS l{i}{j}" for i in range(j + 1, n))
        out.append(f"f{j + 1} AS (SELECT *{below} FROM g{j})")
    cells = [(i, j) for i in range(n) for j in range(i + 1)]
    grid = " UNION ALL ".join(f"SELECT {i} AS i, '{TICKERS[i]}' AS ticker, {j} AS j" for i, j in cells)
    pick = "CASE " + " ".join(f"WHEN i = {i} AND j = {j} THEN l{i}{j}" for i, j in cells) + " END"
    return ", ".join(out) + f", fc AS (SELECT i, ticker, j, {pick} AS w FROM f{n} CROSS JOIN ({grid}) g)"


@plan
def portfolio_factor(d: Dialect) -> str:
    """The triangular factor of the tickers' shrunk covariances; its product with its transpose gives them back."""
    return f"WITH {BARS}, {_SHRUNK}, {_factor()}, b AS (SELECT x.ticker AS a, y.ticker AS b, sum(x.w * y.w) AS cov FROM fc x JOIN fc y ON y.j = x.j GROUP BY x.ticker, y.ticker) SELECT f.ticker, CAST(f.j AS INT) AS j, round(f.w * 1000, 6) AS w, abs(b.cov - sh.cov) < 1E-15 AS exact FROM fc f JOIN b ON b.a = f.ticker AND b.b = f.ticker JOIN sh ON sh.a = f.ticker AND sh.b = f.ticker"


@plan
def portfolio_mc(d: Dialect) -> str:
    """Correlated assets from their own returns: shocks times the factor's entries, summed by path and asset; then the basket of equal shares."""
    pick = ", ".join(f"max(CASE WHEN i = {i} THEN s END) AS s{i}" for i in range(len(TICKERS)))
    mean = "(" + " + ".join(f"s{i}" for i in range(len(TICKERS))) + f") / {len(TICKERS)}"
    return f"""WITH {BARS}, {_SHRUNK}, {_factor()}, dr AS (SELECT ticker, avg(r) AS m FROM al GROUP BY ticker),
z AS (SELECT path, i, ticker, sum(w * {d.normal(13, "'c'", 'path', 'j')}) AS e FROM {d.rows(PATHS, "path")} p CROSS JOIN fc GROUP BY path, i, ticker),
s AS (SELECT path, i, 100 * exp(21 * m + sqrt(21E0) * e) AS s FROM z JOIN dr ON dr.ticker = z.ticker),
w AS (SELECT path, {pick} FROM s GROUP BY path), b AS (SELECT *, {mean} AS b FROM w)
SELECT round(avg(b), 6) AS basket, round({d.quantile("b", 0.05)}, 6) AS p05, round({d.quantile("b", 0.95)}, 6) AS p95, round(100 - {d.quantile("b", 0.01)}, 6) AS var99, round(avg(CASE WHEN b < 100 THEN 1E0 ELSE 0E0 END), 6) AS prob_loss,
       {", ".join(f"round(avg(s{i}), 6) AS mean_{i}, round(corr(ln(s0), ln(s{i})), 6) AS rho_0{i}" for i in range(len(TICKERS)))} FROM b"""


@query(oracle(f"WITH {_recursive(DUCK)}{BARS}, {by_ticker(DUCK, MODELS, 120, 10, 20)}, {compared(DUCK)}, {_CONSENSUS}"))
def model_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disagreement of the nine models by ticker: ranks by distance from their medians, median consensus, the most conservative one."""
    views(spark, sf_dir)
    paths = stored(spark.sql(f"WITH {BARS}, {by_ticker(SPARK, MODELS, 120, 10, 20)} SELECT * FROM runs"), "runs")
    return spark.sql(f"WITH runs AS (SELECT * FROM {{runs}}), {compared(SPARK)}, {_CONSENSUS}", runs=paths)


@plan
def stream_stats(d: Dialect) -> str:
    """Mergeable moments of event values, and a bottom-k sample by hash in place of a reservoir."""
    h = "md5(concat_ws(':', 'r', CAST(event_id AS VARCHAR(20))))" if d.name == "duckdb" else "md5(concat_ws(':', 'r', CAST(event_id AS STRING)))"
    return f"""WITH m AS (SELECT event_type, count(*) AS n, avg(value) AS mean, var_samp(value) AS var, min(value) AS lo, max(value) AS hi, {d.quantile("value", 0.5)} AS med FROM events GROUP BY event_type),
k AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY {h}) AS rk FROM events),
s AS (SELECT event_type, avg(value) AS sample_mean FROM k WHERE rk <= 64 GROUP BY event_type)
SELECT event_type, CAST(n AS BIGINT) AS n, round(mean, 6) AS mean, round(var, 4) AS var, round(lo, 6) AS lo, round(hi, 6) AS hi, round(med, 6) AS med, round(sample_mean, 6) AS sample_mean FROM m JOIN s USING (event_type)"""


@query()
def stream_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments, quantiles and tail losses of event values by type from mergeable sketches of each day; no SQL gives a sketch's answers."""
    from ..streaming.quantiles import composite_risk, merge, sketches

    views(spark, sf_dir)
    days = sketches(spark.sql("SELECT event_type, CAST(ts AS DATE) AS day, value - 50 AS pnl FROM events"), "pnl", "event_type", "day")
    return composite_risk(merge(days, "event_type"), "event_type")
