"""Bars, features, buckets, calibration of forward returns, edge scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import Dialect
from ..operators.garch import garch_parameters
from ..registry import plan, query
from ..sources.reports import matrix
from ..sources.tables import BARS, views

# Rows that closes and full bars need, and the drift and volatility of an instrument without enough of them.
LEAST_CLOSES, LEAST_BARS, FALLBACK = 31, 300, (0.08, 0.20)
#: Trend by exponential averages of 9 and 21 bars, tercile of Wilder's oscillator, momentum from 252 to 21 bars back.
FEATURES = f"""{BARS},
feat AS (
  SELECT r.ticker, r.t, r.d, r.close, r.r, e.ema9 AS fast, e.ema21 AS slow, e.rsi14 AS osc,
         lead(ln(r.close), 5) OVER o - ln(r.close) AS fwd, lag(ln(r.close), 21) OVER o - lag(ln(r.close), 252) OVER o AS mom
  FROM rets r JOIN ema_rsi e ON e.ticker = r.ticker AND e.t = r.t WINDOW o AS (PARTITION BY r.ticker ORDER BY r.t)),
buck AS (
  SELECT *, concat(CASE WHEN fast > slow THEN 'bullish' ELSE 'bearish' END, '_', CASE WHEN osc < 40 THEN 'low' WHEN osc > 60 THEN 'high' ELSE 'mid' END) AS bucket,
         CASE WHEN mom > 0 THEN 'mom_up' WHEN mom IS NOT NULL THEN 'mom_down' END AS mbucket
  FROM feat WHERE slow IS NOT NULL AND osc IS NOT NULL)"""


@plan
def px_bars(d: Dialect) -> str:
    """Bars, and whether a ticker has the rows that closes (31) and full bars (300) need."""
    n = "count(*) OVER (PARTITION BY ticker)"
    return f"WITH {BARS} SELECT ticker, t, d, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, {n} >= {LEAST_CLOSES} AS closes_suffice, {n} >= {LEAST_BARS} AS bars_suffice FROM ohlc"


@plan
def px_annualized(d: Dialect) -> str:
    """Annual drift and volatility of every instrument that alerts name; one with too short a history, or none, takes the fallback."""
    named = "(SELECT DISTINCT CASE user_id % 6 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM' WHEN 3 THEN '4-NOT SPECIFIED' WHEN 4 THEN '5-LOW' ELSE 'NONE' END AS ticker FROM events)"
    return f"""WITH {BARS}, e AS (SELECT ticker, count(r) AS n, 252 * avg(r) + 126 * var_samp(r) AS mu, stddev_samp(r) * sqrt(252E0) AS sigma, 100 * exp(sum(r)) AS rebuilt FROM rets GROUP BY ticker),
a AS (SELECT ticker FROM {named} q UNION SELECT ticker FROM e)
SELECT a.ticker, CAST(coalesce(n, 0) AS BIGINT) AS n, round(CASE WHEN n >= {LEAST_CLOSES - 1} THEN mu ELSE {FALLBACK[0]}E0 END, 6) AS mu, round(CASE WHEN n >= {LEAST_CLOSES - 1} THEN sigma ELSE {FALLBACK[1]}E0 END, 6) AS sigma,
       round(rebuilt, 6) AS rebuilt, CASE WHEN n >= {LEAST_CLOSES - 1} THEN 'history' ELSE 'fallback' END AS source FROM a LEFT JOIN e ON e.ticker = a.ticker"""


@plan
def feat_ema_rsi(d: Dialect) -> str:
    """The recurrences, seeded by means of their first values; undefined before."""
    return """WITH x AS (SELECT * FROM ema_rsi) SELECT ticker, t, round(ema9, 6) AS ema9, round(ema21, 6) AS ema21, round(rsi14, 6) AS rsi14, round(sqrt(252 * ewma_var), 6) AS ewma_sigma,
       CASE WHEN ema9 > ema21 THEN 'bullish' WHEN ema21 IS NOT NULL THEN 'bearish' END AS trend FROM x"""


@plan
def feat_matrix(d: Dialect) -> str:
    """Realised volatility by population deviation of half its window at least, true range, momentum, moving-average regime, lagged returns, weekday."""
    dow = "weekday(d)" if d.name == "spark" else "(isodow(d) - 1)"
    return f"""WITH {BARS},
tr AS (SELECT ticker, t, d, close, greatest(high - low, abs(high - lag(close) OVER (PARTITION BY ticker ORDER BY t)), abs(low - lag(close) OVER (PARTITION BY ticker ORDER BY t))) AS tr FROM ohlc),
x AS (SELECT r.ticker, r.t, r.d, r.close, r.r, tr.tr FROM rets r JOIN tr ON r.ticker = tr.ticker AND r.t = tr.t)
SELECT ticker, t, CASE WHEN count(r) OVER (PARTITION BY ticker ORDER BY t ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) >= 30 THEN round(stddev_pop(r) OVER (PARTITION BY ticker ORDER BY t ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), 8) END AS vol60,
       CASE WHEN t > 14 THEN round(avg(tr) OVER (PARTITION BY ticker ORDER BY t ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), 6) END AS atr14,
       round(lag(ln(close), 21) OVER (PARTITION BY ticker ORDER BY t) - lag(ln(close), 252) OVER (PARTITION BY ticker ORDER BY t), 6) AS mom_12_1,
       CASE WHEN t >= 200 THEN avg(close) OVER (PARTITION BY ticker ORDER BY t ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) > avg(close) OVER (PARTITION BY ticker ORDER BY t ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) END AS regime,
       round(lag(r, 1) OVER (PARTITION BY ticker ORDER BY t), 6) AS lag1, round(lag(r, 5) OVER (PARTITION BY ticker ORDER BY t), 6) AS lag5, CAST({dow} AS INT) AS dow
FROM x"""


@plan
def feat_adx(d: Dialect) -> str:
    """Wilder's average directional index of highs and lows, undefined in the first 27 bars."""
    return "WITH x AS (SELECT * FROM dmi) SELECT ticker, t, round(adx14, 6) AS adx14, adx14 >= 20 AS trending FROM x"


FLIPS = """tf AS (SELECT ticker, t, d, fast > slow AS up, lag(fast > slow) OVER (PARTITION BY ticker ORDER BY t) AS was FROM feat WHERE slow IS NOT NULL),
flips AS (SELECT ticker, t, d, up FROM tf WHERE up <> was)"""


@plan
def feat_flips(d: Dialect) -> str:
    """Bars whose trend differs from the bar before."""
    return f"WITH {FEATURES}, {FLIPS} SELECT ticker, t, d, CASE WHEN up THEN 'long' ELSE 'short' END AS side FROM flips"


def _newey_west(source: str, key: str, lags: int = 4) -> str:
    """Bartlett weights over lags of the compacted sample of each key; n_eff within 1..n."""
    cov = " + ".join(f"2 * {1 - l / (lags + 1)!r}E0 * coalesce(sum(e * e{l}), 0) / count(*)" for l in range(1, lags + 1))
    lagged = ", ".join(f"lag(e, {l}) OVER (PARTITION BY {key} ORDER BY t) AS e{l}" for l in range(1, lags + 1))
    return f"""{source}_e AS (SELECT {key}, t, x, x - avg(x) OVER (PARTITION BY {key}) AS e FROM {source}),
{source}_l AS (SELECT *, {lagged} FROM {source}_e),
{source}_n AS (SELECT {key}, count(*) AS n, avg(x) AS m, var_samp(x) AS v, greatest(sum(e * e) / count(*) + {cov}, 1E-18) AS lrv FROM {source}_l GROUP BY {key}),
{source}_nw AS (SELECT {key}, CAST(n AS BIGINT) AS n, m, v, sqrt(lrv / n) AS se, least(CAST(n AS DOUBLE), greatest(1E0, n * v / lrv)) AS n_eff FROM {source}_n WHERE n > 2)"""


_SHRINK = "CASE WHEN abs(m / se) < 1 THEN 0E0 ELSE m * n_eff / (n_eff + 60) END"


@plan
def calib_buckets(d: Dialect) -> str:
    """Forward five-bar returns by bucket: Newey-West errors, shrinkage with a hard zero."""
    return f"""WITH {FEATURES}, smp AS (SELECT ticker, bucket, t, fwd AS x FROM buck WHERE fwd IS NOT NULL), {_newey_west("smp", "ticker, bucket")}
SELECT ticker, bucket, n, round(n_eff, 4) AS n_eff, round(m, 8) AS raw_mu, round(se, 8) AS se, round(m / se, 5) AS t_stat, round({_SHRINK}, 8) AS shrunk_mu, round(252 / 5E0 * {_SHRINK}, 6) AS shrunk_annual FROM smp_nw"""


@plan
def calib_momentum(d: Dialect) -> str:
    return f"""WITH {FEATURES}, smp AS (SELECT ticker, mbucket, t, fwd AS x FROM buck WHERE fwd IS NOT NULL AND mbucket IS NOT NULL), {_newey_west("smp", "ticker, mbucket")}
SELECT ticker, mbucket, n, round(n_eff, 4) AS n_eff, round(m, 8) AS raw_mu, round({_SHRINK}, 8) AS shrunk_mu FROM smp_nw"""


@plan
def calib_walkforward(d: Dialect) -> str:
    """First three quarters, purged by the horizon, against the last: the signs must agree on both sides."""
    return f"""WITH {FEATURES}, m AS (SELECT ticker, max(t) AS last FROM buck GROUP BY ticker),
x AS (SELECT b.ticker, b.bucket, b.fwd, CASE WHEN b.t + 5 < floor(0.75E0 * m.last) THEN 'is' WHEN b.t >= floor(0.75E0 * m.last) THEN 'oos' END AS part FROM buck b JOIN m ON b.ticker = m.ticker WHERE b.fwd IS NOT NULL),
y AS (SELECT ticker, bucket, avg(CASE WHEN part = 'is' THEN fwd END) AS a, avg(CASE WHEN part = 'oos' THEN fwd END) AS b, sum(CASE WHEN part = 'is' THEN 1 ELSE 0 END) AS n_is, sum(CASE WHEN part = 'oos' THEN 1 ELSE 0 END) AS n_oos FROM x GROUP BY ticker, bucket)
SELECT ticker, bucket, round(a, 8) AS is_mu, round(b, 8) AS oos_mu, CAST(n_is AS BIGINT) AS n_is, CAST(n_oos AS BIGINT) AS n_oos, coalesce(n_oos >= 8 AND sign(a) = sign(b) AND a <> 0, false) AS pass FROM y"""


@plan
def edge_scan(d: Dialect) -> str:
    """The latest bar's buckets looked up for both lenses; agreement needs all lenses verified in one direction; ranked."""
    return f"""WITH {FEATURES}, smp AS (SELECT ticker, bucket, t, fwd AS x FROM buck WHERE fwd IS NOT NULL), {_newey_west("smp", "ticker, bucket")},
mom AS (SELECT ticker, mbucket AS bucket, t, fwd AS x FROM buck WHERE fwd IS NOT NULL AND mbucket IS NOT NULL), {_newey_west("mom", "ticker, bucket")},
tab AS (SELECT 'trend' AS lens, ticker, bucket, n, {_SHRINK} AS mu, m / se AS ts FROM smp_nw UNION ALL SELECT 'momentum', ticker, bucket, n, {_SHRINK}, m / se FROM mom_nw),
cur AS (SELECT ticker, bucket, mbucket FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY t DESC) AS k FROM buck) q WHERE k = 1),
now AS (SELECT ticker, 'trend' AS lens, bucket FROM cur UNION ALL SELECT ticker, 'momentum', mbucket FROM cur WHERE mbucket IS NOT NULL),
e AS (SELECT now.ticker, now.lens, now.bucket, coalesce(mu, 0E0) AS mu, coalesce(abs(ts) >= 1, false) AS verified, CASE WHEN mu > 0 THEN 'long' WHEN mu < 0 THEN 'short' ELSE 'none' END AS direction FROM now LEFT JOIN tab ON tab.ticker = now.ticker AND tab.lens = now.lens AND tab.bucket = now.bucket),
a AS (SELECT ticker, count(*) >= 2 AND count(DISTINCT direction) = 1 AND min(CASE WHEN verified AND direction <> 'none' THEN 1 ELSE 0 END) = 1 AS agree FROM e GROUP BY ticker)
SELECT e.ticker, lens, bucket, round(mu, 8) AS mu, verified, direction, agree, CAST(row_number() OVER (ORDER BY agree DESC, verified DESC, abs(mu) DESC, e.ticker, lens) AS INT) AS rank FROM e JOIN a ON e.ticker = a.ticker"""


@plan
def heston_moments(d: Dialect) -> str:
    """Rolling realised variances of the twenty returns before each bar: level, persistence, volatility of variance, leverage."""
    return f"""WITH {BARS}, v AS (SELECT ticker, t, r, 252 * var_pop(r) OVER (PARTITION BY ticker ORDER BY t ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS v FROM rets WHERE r IS NOT NULL),
w AS (SELECT ticker, t, r, v, v - lag(v) OVER (PARTITION BY ticker ORDER BY t) AS dv, lag(v) OVER (PARTITION BY ticker ORDER BY t) AS lv FROM v WHERE t > 22)
SELECT ticker, round(avg(v), 8) AS theta, round(corr(v, lv), 6) AS persistence, round(-covar_samp(dv, lv) / var_samp(lv) * 252, 4) AS kappa, round(stddev_samp(dv) / sqrt(avg(v)), 6) AS xi, round(corr(dv, r), 6) AS rho FROM w GROUP BY ticker"""


@query()
def garch_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir)
    x = garch_parameters(spark.sql(f"WITH {BARS} SELECT ticker, t, r FROM rets WHERE r IS NOT NULL"))
    return x.select("ticker", "n", F.round("omega", 10).alias("omega"), F.round("alpha", 6).alias("alpha"), F.round("beta", 6).alias("beta"), F.round("loglik", 4).alias("loglik"), "method")


@query(f"""WITH {BARS}, k AS (SELECT ticker, r, row_number() OVER (PARTITION BY ticker ORDER BY t DESC) AS k FROM rets WHERE r IS NOT NULL),
c AS (SELECT a.ticker AS a, b.ticker AS b, corr(a.r, b.r) AS rho FROM k a JOIN k b ON a.k = b.k GROUP BY a.ticker, b.ticker)
SELECT a AS ticker, {", ".join(f"round(max(CASE WHEN b = '{t}' THEN rho END), 6) AS \"{t}\"" for t in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))} FROM c GROUP BY a""")
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations of returns, aligned from the end, as the matrix that the report writes."""
    views(spark, sf_dir)
    pairs = spark.sql(f"""WITH {BARS}, k AS (SELECT ticker, r, row_number() OVER (PARTITION BY ticker ORDER BY t DESC) AS k FROM rets WHERE r IS NOT NULL)
SELECT a.ticker AS ticker, b.ticker AS other, round(corr(a.r, b.r), 6) AS rho FROM k a JOIN k b ON a.k = b.k GROUP BY a.ticker, b.ticker""")
    return matrix(pairs, "ticker", "other", "rho")
