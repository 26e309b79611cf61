"""From signals to decisions: payloads, chart levels, sizing, gates, paper pass, stress, and research verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import Dialect
from ..operators.configured import complete, runs
from ..registry import plan, query
from ..sources.tables import BARS, views
from .configured import _recursive, market
from .signals import _SHRINK, FEATURES, _newey_west
from .validation import RESAMPLES, TRADES, autocovariance, running_sums, shrunk_drift

# Limits of stops and targets, and their defaults; the tolerances' caps on large losses; tax rates.
STOP_RANGE, TARGET_RANGE, DEFAULT_STOP, DEFAULT_TARGET, ATR_MULTIPLE = (0.005, 0.08), (0.005, 0.15), 0.02, 0.03, 2.0
#: Below this average directional index no trend is believed.
TREND_LEAST = 20.0
LOSS_CAPS = {"Conservative": 0.08, "Moderate": 0.18, "Aggressive": 0.30}
SHORT_TAX, LONG_TAX = 0.35, 0.15
HORIZONS = (5, 21, 63, 126, 252)


def _values(rows, names: str) -> str:
    cells = lambda r: ", ".join(f"'{v}'" if isinstance(v, str) else f"{v!r}E0" if isinstance(v, float) else str(v) for v in r)
    return f"(SELECT * FROM (VALUES {', '.join(f'({cells(r)})' for r in rows)}) v({names}))"


def _clip(x: str, bounds: tuple[float, float]) -> str:
    return f"least({bounds[1]}E0, greatest({bounds[0]}E0, {x}))"


@plan
def payload_cascade(d: Dialect) -> str:
    """Bodies as JSON objects, as objects within text, or as text; fields by the first alias with a value."""
    kind = lambda x: f"CASE WHEN json_valid({x}) THEN json_type({x}) END = 'OBJECT'" if d.name == "duckdb" else f"schema_of_variant(try_parse_json({x})) LIKE 'OBJECT%'"
    valid = lambda x: f"json_valid({x})" if d.name == "duckdb" else f"try_parse_json({x}) IS NOT NULL"
    inner = "regexp_extract(body, '(?s)[{].*[}]', 0)"
    first = lambda *names: f"coalesce({', '.join(f'nullif({d.json("obj", n)}, {chr(39) * 2})' for n in names)})"
    return f"""WITH b AS (SELECT event_id, trim(CASE event_id % 7
    WHEN 0 THEN '' WHEN 1 THEN concat('alert: ', props, ' end') WHEN 2 THEN concat('cross on ', event_type) WHEN 3 THEN concat('[', props, ']') WHEN 4 THEN concat('broken ', substr(props, 1, length(props) - 1), 'x}}')
    WHEN 5 THEN concat('{{"sym": "', event_type, '", "ticker": "", "last": ', CAST(event_id AS VARCHAR(20)), ', "trend_direction": "UP"}}') ELSE props END) AS body FROM events),
c AS (SELECT event_id, body, CASE WHEN body = '' THEN 'empty' WHEN {kind("body")} THEN 'json' WHEN {valid("body")} THEN 'json_non_object' WHEN {kind(inner)} THEN 'embedded_json' ELSE 'text' END AS status FROM b),
o AS (SELECT event_id, status, CASE status WHEN 'json' THEN body WHEN 'embedded_json' THEN {inner} END AS obj FROM c)
SELECT event_id, status AS parse_status, upper(coalesce({first("ticker", "symbol", "sym")}, 'UNKNOWN')) AS ticker, CAST({first("price", "close", "last")} AS DOUBLE) AS price,
       lower(coalesce({first("trend", "trend_direction", "direction", "signal")}, 'unknown')) AS trend, CAST({first("momentum", "mom", "strength", "rsi", "k")} AS DOUBLE) AS momentum FROM o"""


#: Charts of eight parts: true levels in order of part, read levels in an order of their own, each off by up to 1.5 %.
_CHARTS = """lv AS (
  SELECT CAST(floor(p_partkey / 8E0) AS BIGINT) AS chart, p_partkey AS k, p_retailprice AS px, {u} AS u, {w} AS w FROM part),
rd AS (SELECT chart, w, px * (1 + 0.03E0 * (u - 0.5E0)) AS rp FROM lv WHERE u < 0.9E0)"""


def _charts(d: Dialect) -> str:
    return _CHARTS.format(u=d.uniform(71, "'lv'", "p_partkey"), w=d.uniform(71, "'or'", "p_partkey"))


_TRUE, _READ = "list(px ORDER BY k)", "list(rp ORDER BY w)"


@query()
def vision_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels matched one to one: each true level in turn takes the first free read level within one per cent.

    A fold over a chart's few levels; the answer depends on the order, so a join would not give it.
    """
    from ..functions.dialect import SPARK as d

    views(spark, sf_dir)
    free = "filter(sequence(1, size(p)), j -> NOT array_contains(used, j) AND abs(t - p[j - 1]) / greatest(abs(t), 1E-9) <= 0.01E0)"
    return spark.sql(f"""WITH {_charts(d)},
t AS (SELECT chart, transform(sort_array(collect_list(named_struct('k', k, 'px', px))), e -> e.px) AS q FROM lv GROUP BY chart),
r AS (SELECT chart, transform(sort_array(collect_list(named_struct('w', w, 'rp', rp))), e -> e.rp) AS p FROM rd GROUP BY chart),
m AS (SELECT t.chart, size(q) AS nt, size(p) AS np, size(aggregate(q, CAST(array() AS ARRAY<INT>), (used, t) -> concat(used, slice({free}, 1, 1)))) AS hits FROM t JOIN r ON t.chart = r.chart)
SELECT chart, CAST(hits AS BIGINT) AS hits, round(hits / CAST(np AS DOUBLE), 6) AS precision_, round(hits / CAST(nt AS DOUBLE), 6) AS recall_, round(CASE WHEN hits > 0 THEN 2E0 * hits / (np + nt) ELSE 0E0 END, 6) AS f1 FROM m""")


def _vision_oracle() -> str:
    from ..functions.dialect import DUCK as d

    return f"""WITH RECURSIVE {_charts(d)},
tl AS (SELECT chart, px, row_number() OVER (PARTITION BY chart ORDER BY k) AS i FROM lv),
rl AS (SELECT chart, rp, row_number() OVER (PARTITION BY chart ORDER BY w) AS j FROM rd),
n AS (SELECT chart, count(*) AS nt, (SELECT count(*) FROM rl WHERE rl.chart = tl.chart) AS np FROM tl GROUP BY chart),
w AS (
  SELECT chart, 0 AS i, CAST([] AS BIGINT[]) AS used FROM n WHERE np > 0
  UNION ALL
  SELECT w.chart, w.i + 1, list_concat(w.used, coalesce((SELECT list(q.j) FROM (SELECT min(rl.j) AS j FROM rl WHERE rl.chart = w.chart AND NOT list_contains(w.used, rl.j) AND abs(tl.px - rl.rp) / greatest(abs(tl.px), 1e-9) <= 0.01) q WHERE q.j IS NOT NULL), []))
  FROM w JOIN tl ON tl.chart = w.chart AND tl.i = w.i + 1),
m AS (SELECT n.chart, nt, np, len(used) AS hits FROM w JOIN n ON n.chart = w.chart AND n.nt = w.i)
SELECT chart, CAST(hits AS BIGINT) AS hits, round(hits / CAST(np AS DOUBLE), 6) AS precision_, round(hits / CAST(nt AS DOUBLE), 6) AS recall_, round(CASE WHEN hits > 0 THEN 2E0 * hits / (np + nt) ELSE 0E0 END, 6) AS f1 FROM m"""


@plan
def chart_levels(d: Dialect) -> str:
    """Stop and target from the strongest, then nearest, level on the right side of the price; the stop is widened by doubt.

    Levels are extremes of the last 10, 20 and 60 bars with strengths .4, .7 and .9. A stop from a level is at least one true
    range; without a level it is twice the range, without that the default. Targets default to 1.5 stops. Then the soft
    drift, which an average directional index below 20 forces to zero, the scale of volatility, the size under its caps and the action under the risk limits.
    """
    o = "(PARTITION BY ticker ORDER BY t ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
    spans = ((10, 0.4), (20, 0.7), (60, 0.9))
    extremes = ", ".join(f"min(low) OVER {o.format(n - 1)} AS s{n}, max(high) OVER {o.format(n - 1)} AS r{n}" for n, _ in spans)
    levels = " UNION ALL ".join(f"SELECT ticker, t, '{kind}' AS kind, {c}{n} AS px, {s}E0 AS strength FROM x WHERE t >= {n}" for n, s in spans for kind, c in (("support", "s"), ("resistance", "r")))
    return f"""WITH {FEATURES},
x AS (SELECT h.ticker, h.t, f.close, f.osc, f.fast > f.slow AS up, CASE WHEN h.t > 14 THEN avg(h.high - h.low) OVER (PARTITION BY h.ticker ORDER BY h.t ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) END AS atr,
      least(1E0, 0.3E0 + abs(f.osc - 50) / 50) AS conf, {extremes.replace("ticker", "h.ticker").replace("BY t ", "BY h.t ").replace("(low)", "(h.low)").replace("(high)", "(h.high)")} FROM ohlc h JOIN feat f ON f.ticker = h.ticker AND f.t = h.t),
ax AS (SELECT ticker, t, adx14, coalesce(adx14 < {TREND_LEAST}E0, false) AS gated FROM dmi),
side AS (SELECT *, CASE WHEN osc BETWEEN 48 AND 52 THEN 'flat' WHEN up THEN 'long' ELSE 'short' END AS side FROM x),
lv AS ({levels}),
rk AS (SELECT s.ticker, s.t, lv.px, (lv.kind = 'support') = (s.side = 'long') AS is_stop,
       row_number() OVER (PARTITION BY s.ticker, s.t, lv.kind ORDER BY lv.strength DESC, abs(lv.px - s.close), lv.px) AS k
       FROM side s JOIN lv ON lv.ticker = s.ticker AND lv.t = s.t WHERE s.side <> 'flat' AND (lv.kind = 'support' AND lv.px < s.close OR lv.kind = 'resistance' AND lv.px > s.close)),
pk AS (SELECT ticker, t, max(CASE WHEN is_stop THEN px END) AS sp, max(CASE WHEN NOT is_stop THEN px END) AS tp FROM rk WHERE k = 1 GROUP BY ticker, t),
st AS (SELECT s.ticker, s.t, s.side, s.close, s.osc, s.conf, pk.tp, CASE WHEN sp IS NOT NULL THEN {_clip("greatest(abs(close - sp) / close * (1 + (1 - conf) * 0.5E0), coalesce(atr / close, 0E0))", STOP_RANGE)} WHEN atr > 0 THEN {_clip(f"{ATR_MULTIPLE}E0 * atr / close", STOP_RANGE)} ELSE {DEFAULT_STOP}E0 END AS stop
       FROM side s LEFT JOIN pk ON pk.ticker = s.ticker AND pk.t = s.t),
z AS (SELECT *, {_clip(f"CASE WHEN tp IS NOT NULL THEN abs(tp - close) / close ELSE greatest({DEFAULT_TARGET}E0, 1.5E0 * stop) END", TARGET_RANGE)} AS target,
      least(100000 * 0.01E0 / stop * conf, 20000E0, 100000 * 0.25E0) AS notional FROM st)
SELECT z.ticker, z.t, side, round(adx14, 6) AS adx, gated AND side <> 'flat' AS drift_gated, round(stop, 8) AS stop, round(target, 8) AS target, round(CASE side WHEN 'long' THEN close * (1 - stop) WHEN 'short' THEN close * (1 + stop) END, 6) AS stop_price,
       round(CASE WHEN gated THEN 0E0 ELSE 1E0 END * (CASE side WHEN 'long' THEN 0.05E0 WHEN 'short' THEN -0.05E0 ELSE 0E0 END + CASE WHEN osc >= 70 THEN -0.01E0 WHEN osc <= 30 THEN 0.01E0 ELSE 0E0 END) * conf, 8) AS drift,
       round({_clip("1 + 0.25E0 * abs(osc - 50) / 50", (0.7, 1.4))}, 6) AS vol_scale, round(CASE WHEN conf < 0.4E0 THEN 0E0 ELSE notional / close END, 6) AS shares,
       CASE WHEN conf < 0.4E0 THEN 'confidence_block' WHEN notional >= 20000 THEN 'max_order_notional' ELSE 'none' END AS capped_by, CASE WHEN side = 'flat' OR conf < 0.4E0 THEN 'flat' ELSE side END AS action FROM z LEFT JOIN ax ON ax.ticker = z.ticker AND ax.t = z.t"""


#: Candidates of the reversal rule: a three-bar fall of more than 1.5 population deviations of the twenty returns before.
_OVERSOLD = f"""{BARS},
rw AS (SELECT r.ticker, r.t, r.d, r.close, h.open, r.close / lag(r.close, 3) OVER o - 1 AS rk, stddev_pop(coalesce(r.r, 0E0)) OVER (PARTITION BY r.ticker ORDER BY r.t ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS sd,
       lead(r.close, 5) OVER o / r.close - 1 AS rc, lead(h.open, 6) OVER o / lead(h.open, 1) OVER o - 1 AS re FROM rets r JOIN ohlc h ON h.ticker = r.ticker AND h.t = r.t WINDOW o AS (PARTITION BY r.ticker ORDER BY r.t)),
cand AS (SELECT ticker, t, d, rc, re FROM rw WHERE t > 30 AND re IS NOT NULL AND sd > 0 AND rk / (sd * sqrt(3E0)) < -1.5E0)"""


@query(f"""WITH RECURSIVE {_OVERSOLD},
w AS (SELECT ticker, min(t) AS t FROM cand GROUP BY ticker UNION ALL SELECT n.ticker, n.t FROM (SELECT w.ticker, (SELECT min(c.t) FROM cand c WHERE c.ticker = w.ticker AND c.t >= w.t + 5) AS t FROM w) n WHERE n.t IS NOT NULL)
SELECT c.ticker, c.t, c.d, round(c.rc, 8) AS r_close, round(c.re, 8) AS r_executable FROM cand c JOIN w ON c.ticker = w.ticker AND c.t = w.t""")
def reversal_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long after an oversold close, held five bars; no entry while one is held. A fold over a ticker's candidates."""
    views(spark, sf_dir)
    greedy = "aggregate(c, CAST(array() AS ARRAY<STRUCT<t: INT, d: DATE, rc: DOUBLE, re: DOUBLE>>), (a, x) -> IF(size(a) = 0 OR x.t >= element_at(a, -1).t + 5, concat(a, array(x)), a))"
    return spark.sql(f"""WITH {_OVERSOLD}, g AS (SELECT ticker, sort_array(collect_list(named_struct('t', t, 'd', d, 'rc', rc, 're', re))) AS c FROM cand GROUP BY ticker)
SELECT ticker, e.t, e.d, round(e.rc, 8) AS r_close, round(e.re, 8) AS r_executable FROM (SELECT ticker, explode({greedy}) AS e FROM g) q""")


@plan
def lens_agreement(d: Dialect) -> str:
    """Correlation and equal signs of the trend and momentum lenses (thirty bars at least), and the lift of trades on which both agree."""
    one = "CASE WHEN both_lenses THEN r END"
    return f"""WITH {TRADES},
l AS (SELECT ticker, count(*) AS n, corr(fast / slow - 1, mom) AS rho, avg(CASE WHEN sign(fast - slow) = sign(mom) THEN 1E0 ELSE 0E0 END) AS same FROM buck WHERE mom IS NOT NULL GROUP BY ticker),
x AS (SELECT ticker, r, both_lenses FROM favoured),
a AS (SELECT ticker, count(*) AS trades, count({one}) AS agreed, avg(r) AS m, avg({one}) AS ma, avg(CASE WHEN r > 0 THEN 1E0 ELSE 0E0 END) AS h, avg(CASE WHEN both_lenses THEN CASE WHEN r > 0 THEN 1E0 ELSE 0E0 END END) AS ha FROM x GROUP BY ticker)
SELECT l.ticker, CAST(l.n AS BIGINT) AS n, CASE WHEN l.n >= 30 THEN round(rho, 6) END AS pearson, CASE WHEN l.n >= 30 THEN round(same, 6) END AS sign_agreement, CAST(coalesce(trades, 0) AS BIGINT) AS trades, CAST(coalesce(agreed, 0) AS BIGINT) AS agreed,
       round(ma - m, 8) AS mean_lift, round(ha - h, 6) AS hit_lift FROM l LEFT JOIN a ON a.ticker = l.ticker"""


@plan
def kelly_uncertainty(d: Dialect) -> str:
    """Growth-optimal fractions at the mean weekly edge, its bootstrap bound and half of it, by the sample variance."""
    return f"""WITH {TRADES}, w AS (SELECT CAST(date_trunc('week', d) AS DATE) AS wk, avg(r) AS r FROM trades GROUP BY 1),
k AS (SELECT CAST(row_number() OVER (ORDER BY wk) - 1 AS BIGINT) AS k, r FROM w), n AS (SELECT count(*) AS n, var_samp(r) AS v, avg(r) AS mean FROM k),
p AS (SELECT b, CAST(floor({d.uniform(72, "'ku'", "b", "i.k")} * n) AS BIGINT) AS pick FROM {d.rows(RESAMPLES, "b")} r CROSS JOIN k i CROSS JOIN n),
m AS (SELECT b, avg(r) AS m FROM p JOIN k ON p.pick = k.k GROUP BY b), c AS (SELECT {d.quantile("m", 0.025)} AS lo, {d.quantile("m", 0.975)} AS hi FROM m)
SELECT CAST(n AS BIGINT) AS n, round(v, 10) AS variance, round(mean, 8) AS edge, round(lo, 8) AS edge_lo, round(hi, 8) AS edge_hi, round(mean / v, 6) AS f_point, round(lo / v, 6) AS f_lo, round(mean / 2 / v, 6) AS f_half,
       round(0.25E0 * mean / v, 6) AS quarter, CASE WHEN mean > 0 THEN 2E0 END AS overbet_if_half FROM n CROSS JOIN c WHERE n >= 5"""


def _sweep(horizons, thresholds=(0,)) -> str:
    """Relation ``swept(h, th, ticker, t, d, side, r, taken)``: walk-forward decisions at several horizons in one pass.

    The rule of ``TRADES`` with the shrunk drift above a threshold, next-open fills. An outcome of horizon h is known h + 1
    bars later. Outcomes and decisions are put on one clock, outcomes first, and a decision reads running sums of its
    bucket: one window over rows, with no join of decisions to their past. Up to six bars errors are Newey-West's with
    h - 1 lags; beyond, the long-run variance is that of overlapping sums, (2 h^2 + 1) / (3 h) times the variance.
    """
    lags = min(6, max(horizons)) - 1
    over = "PARTITION BY hz.h, b.ticker ORDER BY b.t"
    later = " ".join(f"WHEN {h} THEN lead(ln(b.close), {h}) OVER ({over})" for h in horizons)
    fill = " ".join(f"WHEN {h} THEN lead(o.open, {h + 1}) OVER ({over})" for h in horizons)
    w = "OVER (PARTITION BY h, ticker, bucket ORDER BY clock, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    bartlett = "g0 + " + " + ".join(f"2 * greatest(0E0, 1 - {l}E0 / h) * {autocovariance(l)}" for l in range(1, lags + 1))
    lagged = ", ".join(f"lag(x, {l}) OVER (PARTITION BY h, ticker, bucket ORDER BY t) AS x{l}" for l in range(1, lags + 1))
    names = ", ".join(f"x{l}" for l in range(1, lags + 1))
    return f"""hz AS {_values([(h,) for h in horizons], "h")}, ths AS {_values([(t,) for t in thresholds], "th")},
fw AS (SELECT hz.h, b.ticker, b.bucket, b.t, b.d, CASE WHEN b.fast > b.slow THEN 1 ELSE -1 END AS side, b.mom, CASE hz.h {later} END - ln(b.close) AS x, CASE hz.h {fill} END / lead(o.open, 1) OVER ({over}) - 1 AS rx
       FROM buck b JOIN ohlc o ON o.ticker = b.ticker AND o.t = b.t CROSS JOIN hz),
lx AS (SELECT *, {lagged} FROM fw WHERE x IS NOT NULL),
clk AS (SELECT h, ticker, bucket, t + h + 1 AS clock, 0 AS kind, x AS y, {names}, t, d, side, mom, rx FROM lx UNION ALL SELECT h, ticker, bucket, t, 1, CAST(NULL AS DOUBLE), {", ".join(["CAST(NULL AS DOUBLE)"] * lags)}, t, d, side, mom, rx FROM lx WHERE rx IS NOT NULL AND t >= 313 AND (t - 313) % h = 0),
past AS (SELECT *, {running_sums(lags, w, "y")} FROM clk),
sd AS {shrunk_drift("past", "h, ticker, t, d, side, mom, rx, kind", f"CASE WHEN h <= 6 THEN {bartlett} ELSE g0 * (2E0 * h * h + 1) / (3E0 * h) END")},
swept AS (SELECT h, th, ticker, t, d, side, side * rx AS r, side * mu > th AND coalesce(sign(mom) = side, false) AS taken FROM sd CROSS JOIN ths WHERE kind = 1)"""


@plan
def turnover_sweep(d: Dialect) -> str:
    """Holding horizons against cost and tax: net of 0.2 % a side, the long rate from 252 bars, Sharpe against buy and hold."""
    tax = f"CASE WHEN h >= 252 THEN {LONG_TAX}E0 ELSE {SHORT_TAX}E0 END"
    net = "r - 0.004E0"
    return f"""WITH {FEATURES}, {_sweep(HORIZONS)},
tr AS (SELECT h, ticker, d, r, {net} AS net, CASE WHEN {net} > 0 THEN ({net}) * (1 - {tax}) ELSE {net} END AS after FROM swept WHERE taken),
a AS (SELECT h, count(*) AS n, avg(r) AS g, avg(net) AS net, avg(after) AS after FROM tr GROUP BY h),
wk AS (SELECT h, CAST(date_trunc('week', d) AS DATE) AS w, avg(after) AS r FROM tr GROUP BY 1, 2),
sh AS (SELECT h, CASE WHEN count(*) > 2 THEN avg(r) / nullif(stddev_samp(r), 0E0) * sqrt(252E0 / h) END AS sharpe FROM wk GROUP BY h),
bm AS (SELECT avg(b) / stddev_samp(b) * sqrt(252E0) AS bench FROM (SELECT d, avg(r) AS b FROM rets WHERE r IS NOT NULL GROUP BY d) q)
SELECT a.h AS horizon, CAST(n AS BIGINT) AS trades, {tax.replace("h >=", "a.h >=")} AS tax_rate, round(252E0 / a.h * g, 6) AS gross_annual, round(252E0 / a.h * net, 6) AS net_annual, round(252E0 / a.h * after, 6) AS after_tax_annual, round(sharpe, 6) AS sharpe,
       coalesce(sharpe > bench, false) AS beats_benchmark, coalesce(after > 0 AND sharpe > bench, false) AS survives FROM a JOIN sh ON a.h = sh.h CROSS JOIN bm"""


@plan
def paper_pass(d: Dialect) -> str:
    """One pass over all tickers: the last bar's signal, its calibrated drift, and a verdict with the first gate that fails.

    A ticker without a signal is skipped. Gates in order: side, samples, evidence, momentum lens, cost, volatility.
    """
    return f"""WITH {FEATURES}, smp AS (SELECT ticker, bucket, t, fwd AS x FROM buck WHERE fwd IS NOT NULL), {_newey_west("smp", "ticker, bucket")},
tab AS (SELECT ticker, bucket, n, m / se AS ts, {_SHRINK} AS mu FROM smp_nw),
st AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY t DESC) AS k, stddev_pop(r) OVER (PARTITION BY ticker ORDER BY t ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS sd FROM buck),
a AS (SELECT DISTINCT ticker FROM bars),
x AS (SELECT a.ticker, st.t, st.bucket, st.close, st.mom, st.sd, CASE WHEN st.fast > st.slow THEN 1 WHEN st.fast < st.slow THEN -1 END AS side, coalesce(tab.n, 0) AS n, coalesce(tab.ts, 0E0) AS ts, coalesce(tab.mu, 0E0) AS mu
      FROM a LEFT JOIN st ON st.ticker = a.ticker AND st.k = 1 LEFT JOIN tab ON tab.ticker = st.ticker AND tab.bucket = st.bucket),
y AS (SELECT *, CASE WHEN t IS NULL THEN 'warm-up: no signal' WHEN side IS NULL THEN 'no side' WHEN n < 30 THEN 'too few samples' WHEN mu = 0 THEN 'shrunk to zero' WHEN side * mu < 0 THEN 'drift against the side'
      WHEN mom IS NULL OR side * mom <= 0 THEN 'momentum lens disagrees' WHEN side * mu <= 0.001E0 THEN 'edge below costs' WHEN sd IS NULL OR sd <= 0 THEN 'no volatility' END AS reason FROM x)
SELECT ticker, bucket, CAST(n AS BIGINT) AS n, round(mu, 8) AS mu, CASE WHEN t IS NULL THEN 'SKIPPED' WHEN reason IS NULL THEN 'TRADE' ELSE 'NO_TRADE' END AS verdict, coalesce(reason, 'all gates pass') AS reason,
       round(CASE WHEN reason IS NULL THEN least(1E0, side * mu / (5 * sd * sd)) * 0.25E0 ELSE 0E0 END, 6) AS fraction FROM y"""


@plan
def stress_suite(d: Dialect) -> str:
    """Seven overlays of each ticker's own figures as rows of one plan, over common draws, and the scenario with the lowest expected value."""
    scenarios = [
        ("Zero drift", "gbm", 0.0, 1.0, 0.0), ("Half historical drift", "gbm", 0.5, 1.0, 0.0), ("Volatility doubled", "gbm", 1.0, 2.0, 0.0), ("One-day crash -10%", "gbm", 1.0, 1.0, 0.1),
        ("One-day crash -20%", "gbm", 1.0, 1.0, 0.2), ("Bear regime", "regime", 0.0, 1.0, 0.0), ("Combined", "gbm", 0.0, 2.0, 0.2),
    ]
    source = f"(SELECT concat(ticker, ':', scenario) AS run, ticker, scenario, x.model, 100 AS paths, 12 AS horizon, mu * drift AS mu, sigma * vol AS sigma, x.crash, 73 AS seed FROM mkt CROSS JOIN {_values(scenarios, 'scenario, model, drift, vol, crash')} x)"
    keep = ("ticker", "scenario")
    p = lambda x: f"round(avg(CASE WHEN {x} THEN 1E0 ELSE 0E0 END), 6)"
    return f"""WITH {_recursive(d)}{BARS}, {market(d)}, cfg AS {complete(source, ("mu", "sigma", "crash", "seed"), keep)}, {runs(d, "cfg", models=("gbm", "regime"), keep=keep, most_paths=100)},
z AS (SELECT ticker, scenario, avg(s) AS m, {d.quantile("s", 0.5)} AS med, {p("s < 100")} AS prob_loss, {p("s <= 80")} AS prob_loss_20, {p("low <= 50")} AS prob_ruin FROM runs GROUP BY ticker, scenario)
SELECT ticker, scenario, round(m, 6) AS expected_value, round(med, 6) AS median_value, prob_loss, prob_loss_20, prob_ruin, m = min(m) OVER (PARTITION BY ticker) AS worst FROM z"""


@plan
def investment_labels(d: Dialect) -> str:
    """Tickers and tolerances: chance of profit and of a loss beyond 10 % over 21 bars, confidence by sample, and the label."""
    caps = _values(list(LOSS_CAPS.items()), "tolerance, cap")
    return f"""WITH {BARS}, f AS (SELECT ticker, lead(ln(close), 21) OVER (PARTITION BY ticker ORDER BY t) - ln(close) AS x FROM bars),
p AS (SELECT ticker, count(*) AS n, avg(CASE WHEN x > 0 THEN 1E0 ELSE 0E0 END) AS profit, avg(CASE WHEN x < ln(0.9E0) THEN 1E0 ELSE 0E0 END) AS big FROM f WHERE x IS NOT NULL GROUP BY ticker),
q AS (SELECT ticker, tolerance, cap, profit, big, CASE WHEN n < 100 THEN 'Low' WHEN n < 1000 THEN 'Medium' ELSE 'High' END AS confidence FROM p CROSS JOIN {caps} c)
SELECT ticker, tolerance, round(profit, 6) AS prob_profit, round(big, 6) AS prob_big_loss, confidence, CASE WHEN confidence = 'Low' THEN 'Too uncertain to judge' WHEN profit >= 0.55E0 AND big <= cap THEN 'Favorable but risky'
       WHEN profit < 0.45E0 OR big > 1.75E0 * cap THEN 'Unfavorable risk-reward' ELSE 'Neutral / uncertain' END AS label FROM q"""


@plan
def research_verdict(d: Dialect) -> str:
    """Survival after costs and tax against buy and hold, evidence in falling markets, and the decay from close to open fills."""
    net = "(r - 0.004E0)"
    return f"""WITH {TRADES},
n AS (SELECT t.ticker, t.t, t.d, t.side, t.r, t.rc, {net} AS net, CASE WHEN {net} > 0 THEN {net} * (1 - {SHORT_TAX}E0) ELSE {net} END AS after FROM trades t),
ol AS (SELECT ticker, t, d, close / max(close) OVER (PARTITION BY ticker ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM ohlc),
e AS (SELECT n.*, ol.dd FROM n JOIN ol ON ol.ticker = n.ticker AND ol.t = n.t),
a AS (SELECT count(*) AS trades, 252E0 / 5 * avg(after) AS edge, avg(CASE WHEN dd < -0.1E0 THEN net END) AS down, 52 * avg(rc - r) AS decay FROM e),
w AS (SELECT CAST(date_trunc('week', d) AS DATE) AS wk, avg(after) AS r FROM n GROUP BY 1), s AS (SELECT avg(r) / stddev_samp(r) * sqrt(52E0) AS sharpe FROM w),
bm AS (SELECT avg(b) / stddev_samp(b) * sqrt(252E0) AS bench FROM (SELECT d, avg(r) AS b FROM rets WHERE r IS NOT NULL GROUP BY d) q)
SELECT CAST(trades AS BIGINT) AS trades, round(edge, 6) AS after_tax_annual_edge, round(sharpe, 6) AS strategy_sharpe, round(bench, 6) AS benchmark_sharpe, coalesce(sharpe > bench, false) AS beats_benchmark, coalesce(edge > 0 AND sharpe > bench, false) AS survives,
       coalesce(down > 0, false) AS bear_evidence, round(decay, 6) AS fill_decay_annual FROM a CROSS JOIN s CROSS JOIN bm"""


@plan
def bet_sizes(d: Dialect) -> str:
    """Shares by both sizers at a probability: all or nothing above 0.6, or 2 cdf(z) - 1; the position cap, then buying power."""
    z = "((p - 0.5E0) / sqrt(p * (1 - p)))"
    return f"""WITH x AS (SELECT p_partkey, p_retailprice AS entry, p_retailprice * 0.97E0 AS stop, p_size / 51E0 AS p FROM part),
m AS (SELECT p_partkey, 'A4' AS sizer, entry, stop, CASE WHEN p > 0.6E0 THEN 1E0 ELSE 0E0 END AS mult FROM x UNION ALL SELECT p_partkey, 'B1', entry, stop, CASE WHEN p <= 0.6E0 THEN 0E0 ELSE 2 * {d.cdf(z)} - 1 END FROM x),
s AS (SELECT p_partkey, sizer, mult, entry, stop, 100000 * 0.005E0 / (entry - stop) * mult AS want, 100000 * 0.1E0 / entry AS cap, 8000 / entry AS power FROM m)
SELECT p_partkey, sizer, round(mult, 5) AS mult, round(least(want, cap, power), 4) AS shares, CASE WHEN least(want, cap) > power THEN 'buying_power' WHEN want > cap THEN 'position_pct' ELSE 'none' END AS capped_by FROM s"""


def _register() -> None:
    from .. import registry

    registry.ORACLES["vision_match"] = _vision_oracle()


_register()
