"""Rules on grids and on history, the weekly verdict, live alerts over reconstructed signals, confirmation by halves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import Dialect
from ..operators.rules import apply_rule
from ..registry import plan, query
from ..sources.tables import BARS, views
from ..tactical import Rule
from .configured import market
from .decisions import SHORT_TAX, _values
from .events import _TAIL, LOG
from .signals import FEATURES, FLIPS, _newey_west
from .validation import TRADES

_COST = 0.0005
#: Side, stop, target, trail, holding limit, entry day.
_GRID = [
    (1, 0.02, 0.0, 0.0, 5, 0), (-1, 0.02, 0.0, 0.0, 5, 0), (1, 0.03, 0.04, 0.02, 10, 0), (-1, 0.03, 0.04, 0.02, 10, 0), (1, 0.0, 0.03, 0.0, 10, 2), (-1, 0.0, 0.03, 0.0, 10, 2), (1, 0.05, 0.0, 0.015, 8, 20), (-1, 0.0, 0.0, 0.0, 12, 0),
]
_GRID_PATHS, _GRID_DAYS = 100, 12


@plan
def rule_grid(d: Dialect) -> str:
    """Rules of both sides over each ticker's paths, a fold a path and rule; exits in order, statistics by rule.

    An iteration decides on the price of the day before its step, then moves it. A rule that enters after the last day has no trade.
    """
    n = _GRID_DAYS
    cells = _values([(i, *map(float, r)) for i, r in enumerate(_GRID)], "rule, side, stop, target, trail, hold, start")
    source = f"(SELECT rank * 100000 + rule * 1000 + path AS path, side, stop, target, trail, hold, start, (mu - sigma * sigma / 2) / 252 AS a, sigma * sqrt(1E0 / 252) AS v FROM {d.rows(_GRID_PATHS, 'path')} p CROSS JOIN {cells} g CROSS JOIN ranked)"
    day = "({step} - 1)"
    best = "({side} * greatest({side} * {m}, {side} * {x}))"
    stop, target, trail = "({stop} > 0 AND {side} * {x} <= {side} * {e} * (1 - {side} * {stop}))", "({target} > 0 AND {side} * {x} >= {side} * {e} * (1 + {side} * {target}))", f"({{trail}} > 0 AND {{side}} * {{x}} <= {{side}} * {best} * (1 - {{side}} * {{trail}}))"
    why = f"CASE WHEN {stop} THEN 1 WHEN {target} THEN 2 WHEN {trail} THEN 3 WHEN {day} - {{d}} >= {{hold}} OR {day} = {n} THEN 4 ELSE 0 END"
    closes, opens = f"{{o}} = 1 AND {why} > 0", f"{{o}} = 0 AND {day} >= {{start}} AND {day} < {n}"
    fixed = ("side", "stop", "target", "trail", "hold", "start", "a", "v")
    state = {"x": "100", "o": "0", "e": "0", "m": "0", "d": "0", "y": "0", "r": "0", "k": "0"} | {c: c for c in fixed}
    move = {
        "x": f"{{x}} * exp({{a}} + {{v}} * {d.normal(46, repr('grid'), '(path % 1000)', '{step}')})", "o": f"CASE WHEN {closes} THEN 2 WHEN {opens} THEN 1 ELSE {{o}} END", "e": f"CASE WHEN {opens} THEN {{x}} ELSE {{e}} END",
        "m": f"CASE WHEN {opens} THEN {{x}} ELSE {best} END", "d": f"CASE WHEN {opens} THEN {day} ELSE {{d}} END", "y": f"CASE WHEN {closes} THEN {{x}} ELSE {{y}} END", "r": f"CASE WHEN {closes} THEN {why} ELSE {{r}} END",
        "k": f"CASE WHEN {closes} THEN {day} - {{d}} ELSE {{k}} END",
    } | {c: f"{{{c}}}" for c in fixed}
    share = lambda c: f"round(avg(CASE WHEN {c} THEN 1E0 ELSE 0E0 END), 6)"
    return f"""WITH {"RECURSIVE " if d.name == "duckdb" else ""}{BARS}, {market(d)}, ranked AS (SELECT ticker, mu, sigma, CAST(row_number() OVER (ORDER BY ticker) AS BIGINT) AS rank FROM mkt), {d.fold("f", source, state, move, n + 1, [])},
p AS (SELECT ticker, CAST(floor(path / 1000) AS INT) % 100 AS rule, r, k, CASE WHEN o = 2 THEN side * (y - e) - {_COST}E0 * (y + e) ELSE 0E0 END AS pnl, CASE WHEN o = 2 THEN (side * (y - e) - {_COST}E0 * (y + e)) / e ELSE 0E0 END AS pct FROM f JOIN ranked ON ranked.rank = CAST(floor(path / 100000) AS BIGINT))
SELECT ticker, rule, CAST(count(*) AS BIGINT) AS n_paths, {share("pnl > 1E-12")} AS prob_profit, {share("pnl < -1E-12")} AS prob_loss, round(avg(pnl), 6) AS avg_pnl, round({d.quantile("pnl", 0.5)}, 6) AS median_pnl, round(coalesce(stddev_samp(pnl), 0E0), 6) AS std_pnl,
       round(max(pnl), 6) AS best_pnl, round(min(pnl), 6) AS worst_pnl, round(avg(pct), 8) AS avg_pnl_pct, round({d.quantile("pnl", 0.05)}, 6) AS pnl_p05, round({d.quantile("pnl", 0.95)}, 6) AS pnl_p95, {share("r > 0")} AS frac_with_trade,
       {share("r = 1")} AS stop_rate, {share("r = 2")} AS target_rate, {share("r = 3")} AS trail_rate, {share("r = 4")} AS hold_rate, round(avg(k), 6) AS avg_days FROM p GROUP BY ticker, rule"""


_SHORT = Rule("short swing", side="short", stop=0.02, target=0.04, trail=0.015, hold=10)


@query(f"""WITH {BARS}, st AS (SELECT ticker, t AS t0, close AS e FROM bars), z AS (SELECT ticker, max(t) AS z FROM bars GROUP BY ticker),
h AS (SELECT st.ticker, t0, e, b.t - t0 AS k, b.close AS s, least(e, min(b.close) OVER (PARTITION BY st.ticker, t0 ORDER BY b.t)) AS lo FROM st JOIN z ON z.ticker = st.ticker AND t0 + 10 <= z JOIN bars b ON b.ticker = st.ticker AND b.t > t0 AND b.t <= t0 + 10),
w AS (SELECT *, CASE WHEN s >= 1.02 * e THEN 'stop_loss' WHEN s <= 0.96 * e THEN 'take_profit' WHEN s >= 1.015 * lo THEN 'trailing_stop' WHEN k = 10 THEN 'max_holding' END AS why FROM h),
f AS (SELECT *, row_number() OVER (PARTITION BY ticker, t0 ORDER BY k) AS i FROM w WHERE why IS NOT NULL)
SELECT ticker, why AS exit_reason, CAST(count(*) AS BIGINT) AS n, round(avg(e * (1 - 0.0005) - s * (1 + 0.0005)), 6) AS mean_pnl, round(avg(CAST(k AS DOUBLE)), 6) AS mean_days FROM f WHERE i = 1 GROUP BY ticker, why""")
def rule_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule engine on history: a short rule over the eleven closes from every bar on, as far as they go."""
    views(spark, sf_dir)
    rows = spark.sql(f"WITH {BARS}, w AS (SELECT ticker, t, collect_list(close) OVER (PARTITION BY ticker ORDER BY t ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING) AS prices FROM bars) SELECT struct(ticker, t) AS path, prices FROM w WHERE size(prices) = 11")
    return apply_rule(rows, _SHORT, _COST).groupBy(F.col("path.ticker").alias("ticker"), "exit_reason").agg(
        F.count("*").alias("n"), F.round(F.avg("pnl"), 6).alias("mean_pnl"), F.round(F.avg("holding_days"), 6).alias("mean_days")
    )


# Stop in weekly deviations, caps of size and risk, account, stressed multiple of costs.
_STOP_MULT, _KELLY_CAP, _RISK_CAP, _ACCOUNT, _STRESS = 1.5, 0.25, 0.01, 100_000, 2
_WEEK, _MOST, _PATHS = 5, 3, 2000


@plan
def weekly_verdict(d: Dialect) -> str:
    """By ticker: the last bar's signal, its calibrated drift, a stop-and-hold week under noise and under the drift, break-even
    drifts at plain and doubled costs, the momentum lens, the kill switch, the verdict with its reason, and the size.

    The break-even is the drift at which the mean result crosses zero, within [0, 3], to the middle of a 1,024th: a coarse
    grid finds the bracket and a fine one refines it, over common draws. The mean is linear in costs, so one mean exit
    ratio serves both.
    """
    z = "".join(f", {' + '.join(f'n{i}' for i in range(1, j + 1))} AS z{j}" for j in range(1, _WEEK + 1))
    n = "".join(f", {d.normal(47, repr('week'), 'path', j)} AS n{j}" for j in range(1, _WEEK + 1))
    price = lambda a, j: f"exp((({a}) / 252 - w / 2) * {j} + sqrt(w) * z{j})"
    stopped = lambda a, j: f"side * {price(a, j)} <= side - stop"
    leave = lambda a: f"CASE {' '.join(f'WHEN {stopped(a, j)} THEN {price(a, j)}' for j in range(1, _WEEK))} ELSE {price(a, _WEEK)} END"
    any_stop = lambda a: f"({' OR '.join(stopped(a, j) for j in range(1, _WEEK + 1))})"
    net = lambda x, c: f"(side * ({x} - 1) - {c} * (1 + {x}))"
    costs = f"(SELECT {_COST}E0 AS c UNION ALL SELECT {_STRESS * _COST}E0)"
    return f"""WITH {FEATURES}{LOG.removeprefix(BARS)}, {_TAIL}, kill AS (SELECT coalesce(total < 0 AND (SELECT count(*) FROM settled) >= 20, false) AS tripped FROM tl),
smp AS (SELECT ticker, bucket, t, fwd AS x FROM buck WHERE fwd IS NOT NULL), {_newey_west("smp", "ticker, bucket")},
mom AS (SELECT ticker, mbucket AS bucket, t, fwd AS x FROM buck WHERE fwd IS NOT NULL AND mbucket IS NOT NULL), {_newey_west("mom", "ticker, bucket")},
cur AS (SELECT ticker, t, bucket, mbucket, close, CASE WHEN fast > slow THEN 1 ELSE -1 END AS side FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY t DESC) AS k FROM buck) q WHERE k = 1),
m AS (SELECT cur.ticker, cur.bucket, CAST(cur.side AS DOUBLE) AS side, cur.close AS s0, v.ewma_var AS w, least(0.99E0, {_STOP_MULT}E0 * sqrt({_WEEK} * v.ewma_var)) AS stop, a.n, a.m / a.se AS ts,
        coalesce(CASE WHEN abs(a.m / a.se) < 1 THEN 0E0 ELSE a.m * a.n_eff / (a.n_eff + 60) END, 0E0) AS mu, cur.mbucket, CASE WHEN abs(b.m / b.se) < 1 THEN 0E0 ELSE b.m * b.n_eff / (b.n_eff + 60) END AS mom_mu
  FROM cur JOIN ema_rsi v ON v.ticker = cur.ticker AND v.t = cur.t LEFT JOIN smp_nw a ON a.ticker = cur.ticker AND a.bucket = cur.bucket LEFT JOIN mom_nw b ON b.ticker = cur.ticker AND b.bucket = cur.mbucket),
zn AS (SELECT path{n} FROM {d.rows(_PATHS, "path")} p), zc AS (SELECT path{z} FROM zn),
coarse AS (SELECT ticker, g, avg({leave(f"side * {_MOST}E0 * g / 32")}) AS ex FROM m CROSS JOIN (SELECT 0 AS g UNION ALL SELECT g FROM {d.steps(32, "g")} s) gs CROSS JOIN zc GROUP BY ticker, g),
brk AS (SELECT m.ticker, m.side, m.stop, m.w, c, min(CASE WHEN {net("ex", "c")} >= 0 THEN g END) AS g, max(CASE WHEN g = 0 AND {net("ex", "c")} > 0 THEN 1 ELSE 0 END) AS free FROM m JOIN coarse ON coarse.ticker = m.ticker CROSS JOIN {costs} cs GROUP BY m.ticker, m.side, m.stop, m.w, c),
fine AS (SELECT ticker, c, f, side, avg({leave(f"side * {_MOST}E0 * ((g - 1) * 32 + f) / 1024")}) AS ex FROM brk CROSS JOIN {d.steps(32, "f")} fs CROSS JOIN zc WHERE g >= 1 GROUP BY ticker, c, f, side),
fm AS (SELECT ticker, c, min(CASE WHEN {net("ex", "c")} >= 0 THEN f END) AS f FROM fine GROUP BY ticker, c),
be AS (SELECT brk.ticker, brk.c, CASE WHEN free = 1 OR g = 0 THEN 0E0 WHEN g IS NULL THEN {_MOST}E0 ELSE {_MOST}E0 * ((g - 1) * 32 + f - 0.5E0) / 1024 END AS be FROM brk LEFT JOIN fm ON fm.ticker = brk.ticker AND fm.c = brk.c),
bw AS (SELECT ticker, max(CASE WHEN c < {1.5 * _COST}E0 THEN be END) * {_WEEK} / 252 AS be, max(CASE WHEN c > {1.5 * _COST}E0 THEN be END) * {_WEEK} / 252 AS be2 FROM be GROUP BY ticker),
run AS (SELECT ticker, {net(f"({leave('0E0')})", f"{_COST}E0")} AS p0, {any_stop("0E0")} AS hit0, {net(f"({leave(f'mu * 252 / {_WEEK}')})", f"{_COST}E0")} AS p1, {any_stop(f"mu * 252 / {_WEEK}")} AS hit1 FROM m CROSS JOIN zc),
res AS (SELECT ticker, avg(p0) AS drag, avg(CASE WHEN hit0 THEN 1E0 ELSE 0E0 END) AS noise_stop, avg(p1) AS ex, var_pop(p1) AS v, avg(CASE WHEN p1 > 0 THEN 1E0 ELSE 0E0 END) AS win, {d.quantile("p1", 0.05)} AS p05, {d.quantile("p1", 0.95)} AS p95, avg(CASE WHEN hit1 THEN 1E0 ELSE 0E0 END) AS stop_rate FROM run GROUP BY ticker),
y AS (SELECT m.*, res.drag, noise_stop, ex, v, win, p05, p95, stop_rate, be, be2, CASE WHEN m.n IS NULL THEN 'no calibrated drift' WHEN side * mu <= 0 THEN 'edge zero or adverse' WHEN side * mu <= be THEN 'edge within breakeven' WHEN ex <= 0 THEN 'expectancy not positive'
        WHEN side * mu <= be2 THEN 'fails cost stress' WHEN mbucket IS NOT NULL AND coalesce(side * mom_mu, 0E0) <= 0 THEN 'agreement filter' WHEN tripped THEN 'kill switch' END AS reason
      FROM m JOIN res ON res.ticker = m.ticker JOIN bw ON bw.ticker = m.ticker CROSS JOIN kill),
x AS (SELECT *, CASE WHEN reason IS NULL THEN least(least(1E0, ex / v) * {_KELLY_CAP}E0 * {_ACCOUNT}, {_RISK_CAP * _ACCOUNT}E0 / stop) ELSE 0E0 END AS notional FROM y)
SELECT ticker, CASE WHEN side > 0 THEN 'long' ELSE 'short' END AS side, bucket, CASE WHEN reason IS NULL AND notional >= s0 THEN 'TRADE' ELSE 'NO_TRADE' END AS verdict, coalesce(reason, CASE WHEN notional >= s0 THEN 'edge above breakeven' ELSE 'size rounded to zero' END) AS reason,
       round(side * mu, 8) AS edge, round(be, 8) AS breakeven, round(be2, 8) AS breakeven_stress, round(stop, 6) AS stop, round(noise_stop, 6) AS noise_stop_rate, round(drag, 8) AS noise_drag, round(ex, 8) AS expectancy, round(win, 6) AS p_win, round(p05, 6) AS p05, round(p95, 6) AS p95,
       round(stop_rate, 6) AS stop_rate, CASE WHEN notional >= s0 THEN round(notional, 4) ELSE 0E0 END AS notional, CAST(floor(notional / s0) AS BIGINT) AS shares FROM x"""


@plan
def live_overlay(d: Dialect) -> str:
    """Logged alerts over reconstructed trend flips: on a flip's day an alert replaces it, on another known day it is added.

    Orders stand in for the log: the fifth of a ticker's day, if any, as an alert whose side follows its status; of several the last counts.
    """
    return f"""WITH {FEATURES}, {FLIPS},
al AS (SELECT ticker, d, status FROM (SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS d, o_orderstatus AS status, row_number() OVER (PARTITION BY o_orderpriority, CAST(o_orderdate AS DATE) ORDER BY o_orderkey DESC) AS k,
       count(*) OVER (PARTITION BY o_orderpriority, CAST(o_orderdate AS DATE)) AS n FROM orders) q WHERE k = 1 AND n >= 5 AND status IN ('F', 'O')),
lv AS (SELECT b.ticker, b.t, CASE WHEN al.status = 'F' THEN 'long' ELSE 'short' END AS side FROM al JOIN bars b ON b.ticker = al.ticker AND b.d = al.d),
fl AS (SELECT ticker, t, CASE WHEN up THEN 'long' ELSE 'short' END AS side FROM flips)
SELECT coalesce(lv.ticker, fl.ticker) AS ticker, coalesce(lv.t, fl.t) AS t, coalesce(lv.side, fl.side) AS side, CASE WHEN lv.t IS NULL THEN 'reconstructed' ELSE 'live' END AS source FROM fl FULL OUTER JOIN lv ON lv.ticker = fl.ticker AND lv.t = fl.t"""


@plan
def horizon_confirm(d: Dialect) -> str:
    """Walk-forward trades in halves about the middle trade's date: Sharpe after cost and tax against holding all tickers,
    win rate, mean win and loss, the five worst losses; stable if both halves beat the benchmark."""
    sharpe = lambda x, per: f"avg({x}) / nullif(stddev_samp({x}), 0E0) * sqrt({per})"
    net = "((1 + r) * pow(1 - 0.0003E0, 2) - 1)"
    return f"""WITH {TRADES}, o AS (SELECT d, row_number() OVER (ORDER BY d, ticker, t) AS i, count(*) OVER () AS n FROM trades),
mid AS (SELECT max(CASE WHEN i = floor(n / 2) + 1 THEN d END) AS mid, min(d) AS lo, max(d) AS hi FROM o),
part AS (SELECT 'first' AS half, lo, mid AS hi, false AS last FROM mid UNION ALL SELECT 'second', mid, hi, true FROM mid UNION ALL SELECT 'overall', lo, hi, true FROM mid),
x AS (SELECT half, t.d, {net} AS net FROM trades t JOIN part p ON t.d >= p.lo AND (t.d < p.hi OR p.last AND t.d = p.hi)),
wk AS (SELECT half, CAST(date_trunc('week', d) AS DATE) AS w, avg(CASE WHEN net > 0 THEN net * (1 - {SHORT_TAX}E0) ELSE net END) AS r FROM x GROUP BY 1, 2),
s AS (SELECT half, {sharpe("r", "252E0 / 5")} AS sharpe FROM wk GROUP BY half),
bd AS (SELECT d, avg(exp(r) - 1) AS r FROM rets WHERE r IS NOT NULL GROUP BY d),
b AS (SELECT half, {sharpe("r", "252E0")} AS bench FROM bd JOIN part p ON bd.d >= p.lo AND (bd.d < p.hi OR p.last AND bd.d = p.hi) GROUP BY half),
k AS (SELECT half, net, row_number() OVER (PARTITION BY half ORDER BY net) AS k FROM x),
a AS (SELECT half, CAST(count(*) AS BIGINT) AS trades, avg(CASE WHEN net > 0 THEN 1E0 ELSE 0E0 END) AS win, avg(CASE WHEN net > 0 THEN net END) AS avg_win, avg(CASE WHEN net < 0 THEN net END) AS avg_loss, {", ".join(f"max(CASE WHEN k = {i} AND net < 0 THEN net END) AS worst{i}" for i in range(1, 6))} FROM k GROUP BY half),
e AS (SELECT a.*, sharpe, bench, coalesce(sharpe > bench, false) AS beats FROM a JOIN s ON s.half = a.half JOIN b ON b.half = a.half)
SELECT half, trades, round(sharpe, 6) AS sharpe, round(bench, 6) AS benchmark_sharpe, beats, round(win, 6) AS win_rate, round(avg_win, 8) AS avg_win, round(avg_loss, 8) AS avg_loss, {", ".join(f"round(worst{i}, 8) AS worst_{i}" for i in range(1, 6))},
       min(CASE WHEN half <> 'overall' AND NOT beats THEN 0 ELSE 1 END) OVER () = 1 AS stable FROM e"""
