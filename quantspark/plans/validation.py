"""Trade rules, coverage tests, walk-forward trades, labels, overfitting diagnostics."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import Dialect
from ..operators.meta_label import meta_labels
from ..registry import plan, query
from ..sources.tables import BARS, views
from .configured import market
from .signals import FEATURES, FLIPS


def _paths(d: Dialect, n: int = 200, steps: int = 15) -> str:
    """Relations that end in ``px(ticker, path, step, s)``: daily prices from 100 on each ticker's drift and volatility."""
    z = d.normal(41, "'r'", "path", "step")
    return f"{BARS}, {market(d)}, px AS (SELECT ticker, path, step, 100 * exp(sum((mu - sigma * sigma / 2) / 252 + sigma * sqrt(1E0 / 252) * {z}) OVER (PARTITION BY ticker, path ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS s FROM {d.rows(n, 'path')} p CROSS JOIN {d.steps(steps, 'step')} q CROSS JOIN mkt)"


_PNL = "(x * (1 - 0.0005E0) - e * (1 + 0.0005E0))"


@plan
def rule_exits(d: Dialect) -> str:
    """Long rule: stop, then take profit, then trailing stop, then the holding limit; the trailing peak is updated first."""
    return f"""WITH {_paths(d)},
k AS (SELECT ticker, path, step, s, greatest(100E0, max(s) OVER (PARTITION BY ticker, path ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS peak FROM px),
h AS (SELECT ticker, path, step, s, CASE WHEN s <= 98.5E0 THEN 'stop_loss' WHEN s >= 102 THEN 'take_profit' WHEN s <= 0.9875E0 * peak THEN 'trailing_stop' WHEN step >= 10 THEN 'max_holding' END AS why FROM k),
f AS (SELECT ticker, path, min(step) AS step FROM h WHERE why IS NOT NULL GROUP BY ticker, path),
x AS (SELECT h.ticker, h.path, h.step, h.why, h.s AS x, 100E0 AS e FROM h JOIN f ON h.ticker = f.ticker AND h.path = f.path AND h.step = f.step)
SELECT ticker, why AS exit_reason, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(step AS DOUBLE)), 6) AS mean_days, round(avg({_PNL} / e), 6) AS mean_pnl, round(avg(CASE WHEN {_PNL} > 1E-12 THEN 1E0 ELSE 0E0 END), 6) AS win_rate FROM x GROUP BY ticker, why"""


@plan
def rule_reentry(d: Dialect) -> str:
    """Up to three trades a path: after an exit the search goes on with the next bar; entries after a bar of falling price.

    Stop, target, trailing stop and holding limit are checked in this order; a bar without a day after it opens nothing.
    """
    n, hold = 30, 6
    z = d.normal(45, "'re'", "path", "{step}")
    entry, s = "exp({e})", f"{{x}} + {{a}} + {{v}} * {z}"
    now = f"({s})"
    ext = f"greatest({{m}}, {now})"
    out = f"({now} <= {{e}} + ln(0.985E0) OR {now} >= {{e}} + ln(1.025E0) OR {now} <= {ext} + ln(0.9875E0) OR {{step}} - {{d}} >= {hold} OR {{step}} = {n})"
    opens = f"{{o}} = 0 AND {{k}} < 3 AND {now} < {{x}} AND {{step}} < {n}"
    closes = f"{{o}} = 1 AND {out}"
    pnl = f"(exp({now}) * (1 - 0.0005E0) - {entry} * (1 + 0.0005E0)) / {entry}"
    move = {
        "x": s, "o": f"CASE WHEN {closes} THEN 0 WHEN {opens} THEN 1 ELSE {{o}} END", "e": f"CASE WHEN {opens} THEN {now} ELSE {{e}} END", "m": f"CASE WHEN {opens} THEN {now} ELSE {ext} END",
        "d": f"CASE WHEN {opens} THEN {{step}} ELSE {{d}} END", "k": f"CASE WHEN {opens} THEN {{k}} + 1 ELSE {{k}} END", "p": f"CASE WHEN {closes} THEN {{p}} + {pnl} ELSE {{p}} END", "b": f"CASE WHEN {closes} THEN {{b}} + {{step}} - {{d}} ELSE {{b}} END",
    }
    fixed = {"a": "(mu - sigma * sigma / 2) / 252", "v": "sigma * sqrt(1E0 / 252)", "i": "rank"}
    source = f"(SELECT rank * 1000 + path AS path, mu, sigma, rank FROM {d.rows(200, 'path')} p CROSS JOIN ranked)"
    f = d.fold("f", source, {k: "0" for k in move} | fixed, move | {k: f"{{{k}}}" for k in fixed}, n, [])
    return f"""WITH {"RECURSIVE " if d.name == "duckdb" else ""}{BARS}, {market(d)}, ranked AS (SELECT ticker, mu, sigma, CAST(row_number() OVER (ORDER BY ticker) AS BIGINT) AS rank FROM mkt), {f} SELECT ticker, CAST(k AS BIGINT) AS trades, CAST(count(*) AS BIGINT) AS n, round(avg(p), 8) AS mean_pnl, round(avg(CASE WHEN p > 0 THEN 1E0 ELSE 0E0 END), 6) AS win_rate, round(avg(b / nullif(k, 0)), 6) AS mean_days FROM f JOIN ranked ON ranked.rank = CAST(f.i AS BIGINT) GROUP BY ticker, k"""


@plan
def rule_structures(d: Dialect) -> str:
    """Every pair of stop and target over the same paths: one path relation joined to the grid."""
    grid = " UNION ALL ".join(f"SELECT {a}E0 AS stop, {b}E0 AS tp" for a in (0.02, 0.04) for b in (0.03, 0.06, 0.12))
    return f"""WITH {_paths(d)}, g AS ({grid}),
h AS (SELECT ticker, stop, tp, path, step, s FROM px CROSS JOIN g WHERE s <= 100 * (1 - stop) OR s >= 100 * (1 + tp) OR step = 10),
f AS (SELECT ticker, stop, tp, path, min(step) AS step FROM h GROUP BY ticker, stop, tp, path),
x AS (SELECT h.ticker, h.stop, h.tp, h.s AS x, 100E0 AS e FROM h JOIN f ON h.ticker = f.ticker AND h.stop = f.stop AND h.tp = f.tp AND h.path = f.path AND h.step = f.step)
SELECT ticker, stop, tp, round(avg({_PNL} / e), 6) AS expectancy, round(avg(CASE WHEN {_PNL} > 0 THEN 1E0 ELSE 0E0 END), 6) AS p_win, round(avg(CASE WHEN {_PNL} > 0 THEN {_PNL} END) / nullif(-avg(CASE WHEN {_PNL} < 0 THEN {_PNL} END), 0), 6) AS payoff,
       round(least(1E0, greatest(0E0, avg({_PNL} / e) / var_pop({_PNL} / e))) * 0.25E0, 6) AS kelly FROM x GROUP BY ticker, stop, tp"""


@plan
def rule_breakeven(d: Dialect) -> str:
    """Drifts over common draws in one pass; the break-even lies where the mean crosses zero."""
    z = d.normal(42, "'b'", "path", "step")
    mus = " UNION ALL ".join(f"SELECT {m / 10}E0 AS mu" for m in range(-4, 7, 2))
    return f"""WITH {BARS}, {market(d)}, z AS (SELECT path, sum({z}) AS z FROM {d.rows(2000, "path")} p CROSS JOIN {d.steps(5, "step")} q GROUP BY path), m AS ({mus}),
e AS (SELECT ticker, m.mu, avg(exp((m.mu - sigma * sigma / 2) * 5 / 252 + sigma * sqrt(1E0 / 252) * z) * (1 - 0.0005E0) - (1 + 0.0005E0)) AS pnl FROM z CROSS JOIN m CROSS JOIN mkt GROUP BY ticker, m.mu),
n AS (SELECT ticker, mu, pnl, lead(mu) OVER (PARTITION BY ticker ORDER BY mu) AS mu2, lead(pnl) OVER (PARTITION BY ticker ORDER BY mu) AS pnl2 FROM e)
SELECT ticker, mu, round(pnl, 8) AS pnl, CASE WHEN pnl < 0 AND pnl2 >= 0 THEN round(mu + (mu2 - mu) * -pnl / (pnl2 - pnl), 6) END AS breakeven FROM n"""


@plan
def rule_windows(d: Dialect) -> str:
    """A stop-and-hold rule over sliding windows of history, one from each bar."""
    return f"""WITH {BARS}, st AS (SELECT ticker, t AS t0, close AS e FROM bars),
h AS (SELECT st.ticker, t0, e, b.t - t0 AS k, b.close AS s FROM st JOIN bars b ON b.ticker = st.ticker AND b.t > t0 AND b.t <= t0 + 10 WHERE b.close <= 0.98E0 * e OR b.t = t0 + 10),
f AS (SELECT ticker, t0, min(k) AS k FROM h GROUP BY ticker, t0),
x AS (SELECT h.ticker, h.k, h.s AS x, h.e FROM h JOIN f ON h.ticker = f.ticker AND h.t0 = f.t0 AND h.k = f.k)
SELECT ticker, CAST(count(*) AS BIGINT) AS n, round(avg({_PNL} / e), 8) AS expectancy, round(avg(CASE WHEN k < 10 THEN 1E0 ELSE 0E0 END), 6) AS stopped FROM x GROUP BY ticker"""


@plan
def var_coverage(d: Dialect) -> str:
    """Historical and Gaussian VaR of the 252 returns before each bar, breaches, and Kupiec's likelihood ratio."""
    w = "(PARTITION BY ticker ORDER BY t ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)"
    lr = lambda x: f"(-2 * (({x}) * ln(0.05E0) + (n - ({x})) * ln(0.95E0) - CASE WHEN ({x}) = 0 OR ({x}) = n THEN 0E0 ELSE ({x}) * ln(({x}) / n) + (n - ({x})) * ln(1 - ({x}) / n) END))"
    return f"""WITH {BARS}, v AS (SELECT ticker, t, r, -({d.quantile("r", 0.05)} OVER {w}) AS hv, -(avg(r) OVER {w} - 1.6448536269514722E0 * stddev_samp(r) OVER {w}) AS gv FROM rets WHERE r IS NOT NULL),
b AS (SELECT ticker, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CASE WHEN -r > hv + 1E-15 THEN 1 ELSE 0 END) AS DOUBLE) AS hx, CAST(sum(CASE WHEN -r > gv + 1E-15 THEN 1 ELSE 0 END) AS DOUBLE) AS gx FROM v WHERE t > 253 GROUP BY ticker)
SELECT ticker, CAST(n AS BIGINT) AS n, CAST(hx AS BIGINT) AS hist_breaches, CAST(gx AS BIGINT) AS gauss_breaches, round({lr("hx")}, 6) AS hist_lr, round({lr("gx")}, 6) AS gauss_lr,
       round(2 * (1 - {d.cdf(f"sqrt(greatest({lr('hx')}, 0E0))")}), 5) AS hist_p FROM b"""


@plan
def gbm_bands(d: Dialect) -> str:
    w = "(PARTITION BY ticker ORDER BY t ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)"
    return f"""WITH {BARS}, x AS (SELECT ticker, t, avg(r) OVER {w} AS m, stddev_samp(r) OVER {w} AS s, lead(ln(close), 5) OVER (PARTITION BY ticker ORDER BY t) - ln(close) AS f FROM rets)
SELECT ticker, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN abs(f - 5 * m) <= 1.6448536269514722E0 * s * sqrt(5E0) THEN 1E0 ELSE 0E0 END), 6) AS inside90 FROM x WHERE t > 252 AND f IS NOT NULL AND t % 5 = 0 GROUP BY ticker"""


def running_sums(lags: int, window: str, value: str = "x") -> str:
    """Sums, over a window of a bucket's past returns, that Newey-West errors about the window's own mean are made of."""
    own = [f"sum({value}) {window} AS sx", f"sum({value} * {value}) {window} AS sxx", f"count({value}) {window} AS n"]
    for l in range(1, lags + 1):
        both = f"CASE WHEN {value} IS NOT NULL THEN x{l} END"
        own += [f"sum({value} * x{l}) {window} AS p{l}", f"sum({both}) {window} AS a{l}", f"sum(CASE WHEN x{l} IS NOT NULL THEN {value} END) {window} AS b{l}"]
    return ", ".join(own)


def shrunk_drift(source: str, columns: str, variance: str) -> str:
    """Relations that end in one of ``columns`` and mu: the mean, zero where its t statistic is below 1, shrunk otherwise.

    ``variance``: the long-run variance, from g0 and the autocovariances g1, g2, ... about the mean m.
    """
    return f"""(SELECT {columns}, CASE WHEN abs(m / sqrt(lrv / n)) < 1 THEN 0E0 ELSE m * least(CAST(n AS DOUBLE), greatest(1E0, n * v / lrv)) / (least(CAST(n AS DOUBLE), greatest(1E0, n * v / lrv)) + 60) END AS mu
FROM (SELECT *, (sxx - n * m * m) / (n - 1) AS v, greatest({variance}, 1E-18) AS lrv FROM (SELECT *, sx / n AS m, sxx / n - sx / n * sx / n AS g0 FROM {source} WHERE n > 2) q0) q1)"""


def autocovariance(l: int) -> str:
    return f"((coalesce(p{l}, 0E0) - m * (coalesce(a{l}, 0E0) + coalesce(b{l}, 0E0)) + greatest(n - {l}, 0) * m * m) / n)"


_LAGS = 4
#: Settings that were tried: the gauntlet's two sizers at five thresholds.
TRIALS = 10
#: Resamples of a bootstrap.
RESAMPLES = 5000
_PAST = "OVER (PARTITION BY ticker, bucket ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 6 PRECEDING)"
_BARTLETT = "g0 + " + " + ".join(f"{2 * (1 - l / (_LAGS + 1))!r}E0 * {autocovariance(l)}" for l in range(1, _LAGS + 1))
#: Walk-forward decisions every fifth bar from the 313th on. The side is the trend; it is taken where the drift of its bucket,
#: known from returns that ended before, favours it after Newey-West errors and shrinkage, and where momentum agrees
#: (``trades``; ``favoured`` leaves momentum aside). r fills at the next open and five bars later, rc at the closes. Running sums by
#: bucket, no self-join.
TRADES = f"""{FEATURES},
fills AS (SELECT ticker, t, lead(open, 6) OVER (PARTITION BY ticker ORDER BY t) / lead(open, 1) OVER (PARTITION BY ticker ORDER BY t) - 1 AS rx FROM ohlc),
smp AS (SELECT ticker, bucket, t, d, fwd AS x, mom, CASE WHEN fast > slow THEN 1 ELSE -1 END AS side, {", ".join(f"lag(fwd, {l}) OVER (PARTITION BY ticker, bucket ORDER BY t) AS x{l}" for l in range(1, _LAGS + 1))} FROM buck WHERE fwd IS NOT NULL),
known AS (SELECT *, {running_sums(_LAGS, _PAST)} FROM smp),
drift AS {shrunk_drift("known", "ticker, bucket, t, d, side, x, mom", _BARTLETT)},
favoured AS (SELECT g.ticker, g.bucket, g.t, g.d, g.side, g.side * f.rx AS r, g.side * (exp(g.x) - 1) AS rc, coalesce(sign(g.mom) = g.side, false) AS both_lenses
  FROM drift g JOIN fills f ON f.ticker = g.ticker AND f.t = g.t WHERE g.t >= 313 AND (g.t - 313) % 5 = 0 AND f.rx IS NOT NULL AND g.side * g.mu > 0),
trades AS (SELECT * FROM favoured WHERE both_lenses)"""


@plan
def wf_trades(d: Dialect) -> str:
    return f"WITH {TRADES} SELECT ticker, bucket, t, d, side, round(r, 8) AS r, round(rc, 8) AS r_close FROM trades"


@plan
def cost_tax(d: Dialect) -> str:
    cost = " UNION ALL ".join(f"SELECT {c}E0 AS cost" for c in (0, 0.0005, 0.001, 0.002))
    return f"""WITH {TRADES}, c AS ({cost}), x AS (SELECT cost, r - 2 * cost AS net, CASE WHEN r - 2 * cost > 0 THEN (r - 2 * cost) * (1 - 0.35E0) ELSE r - 2 * cost END AS after FROM trades CROSS JOIN c)
SELECT cost, CAST(count(*) AS BIGINT) AS n, round(avg(net), 8) AS net, round(avg(after), 8) AS after_tax, round(avg(after) * 252 / 5, 6) AS annual, round(avg(CASE WHEN net > 0 THEN 1E0 ELSE 0E0 END), 6) AS hit FROM x GROUP BY cost"""


@plan
def perf_stats(d: Dialect) -> str:
    """Equal-weight weekly returns of entry weeks: Sharpe, Sortino over negative weeks only, drawdown, growth."""
    return f"""WITH {TRADES}, w AS (SELECT CAST(date_trunc('week', d) AS DATE) AS wk, avg(r) AS r FROM trades GROUP BY 1),
q AS (SELECT wk, r, exp(sum(ln(1 + r)) OVER (ORDER BY wk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS eq FROM w),
k AS (SELECT wk, r, eq, eq / greatest(1E0, max(eq) OVER (ORDER BY wk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) - 1 AS dd FROM q)
SELECT CAST(count(*) AS BIGINT) AS weeks, round(avg(r) / stddev_samp(r) * sqrt(52E0), 6) AS sharpe, round(avg(r) * sqrt(52E0) / sqrt(avg(CASE WHEN r < 0 THEN r * r END)), 6) AS sortino,
       round(min(dd), 6) AS max_dd, round(pow(exp(sum(ln(1 + r))), 52E0 / count(*)) - 1, 6) AS cagr FROM k"""


@plan
def regime_segments(d: Dialect) -> str:
    """Trades by year and by the ticker's drawdown on the entry date."""
    return f"""WITH {TRADES}, dd AS (SELECT ticker, d, close / max(close) OVER (PARTITION BY ticker ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM bars)
SELECT CAST(year(t.d) AS INT) AS y, CASE WHEN dd.dd < -0.1E0 THEN 'drawdown' ELSE 'normal' END AS regime, CAST(count(*) AS BIGINT) AS n, round(avg(r), 8) AS mean_r, round(exp(sum(ln(1 + r))) - 1, 6) AS compounded
FROM trades t JOIN dd ON t.ticker = dd.ticker AND t.d = dd.d GROUP BY 1, 2"""


@plan
def buy_hold(d: Dialect) -> str:
    """One terminal tax on the gain; beta and correlation of each ticker to the mean of all, by position from the end."""
    return f"""WITH {BARS}, k AS (SELECT ticker, close, r, row_number() OVER (PARTITION BY ticker ORDER BY t DESC) AS k, row_number() OVER (PARTITION BY ticker ORDER BY t) AS f FROM rets),
m AS (SELECT k, avg(r) AS b FROM k GROUP BY k),
x AS (SELECT ticker, max(CASE WHEN k.k = 1 THEN close END) / max(CASE WHEN f = 1 THEN close END) - 1 AS g, covar_samp(r, b) / var_samp(b) AS beta, corr(r, b) AS rho FROM k JOIN m ON k.k = m.k GROUP BY ticker)
SELECT ticker, round(g, 6) AS gross, round(CASE WHEN g > 0 THEN g * (1 - 0.2E0) ELSE g END, 6) AS after_tax, round(beta, 6) AS beta, round(rho, 6) AS rho FROM x"""


@plan
def effective_n(d: Dialect) -> str:
    """Mean pairwise correlation of tickers' weekly trade returns with eight weeks in common."""
    return f"""WITH {TRADES}, w AS (SELECT ticker, CAST(date_trunc('week', d) AS DATE) AS wk, avg(r) AS r FROM trades GROUP BY 1, 2),
p AS (SELECT a.ticker AS a, b.ticker AS b, corr(a.r, b.r) AS rho FROM w a JOIN w b ON a.wk = b.wk AND a.ticker < b.ticker GROUP BY a.ticker, b.ticker HAVING count(*) >= 8),
n AS (SELECT CAST(count(DISTINCT ticker) AS DOUBLE) AS n FROM w)
SELECT CAST(n AS BIGINT) AS tickers, round(avg(rho), 6) AS mean_rho, round(n / (1 + (n - 1) * greatest(avg(rho), 0E0)), 6) AS effective FROM n CROSS JOIN p GROUP BY n"""


@plan
def boot_ci(d: Dialect) -> str:
    """Bootstrap of the mean weekly return: keyed picks joined by position."""
    return f"""WITH {TRADES}, w AS (SELECT CAST(date_trunc('week', d) AS DATE) AS wk, avg(r) AS r FROM trades GROUP BY 1),
k AS (SELECT CAST(row_number() OVER (ORDER BY wk) - 1 AS BIGINT) AS k, r FROM w), n AS (SELECT count(*) AS n FROM k),
p AS (SELECT b, CAST(floor({d.uniform(43, "'bc'", "b", "i.k")} * n) AS BIGINT) AS pick FROM {d.rows(RESAMPLES, "b")} r CROSS JOIN k i CROSS JOIN n),
m AS (SELECT b, avg(r) AS m FROM p JOIN k ON p.pick = k.k GROUP BY b)
SELECT round(avg(m), 8) AS mean, round({d.quantile("m", 0.025)}, 8) AS lo, round({d.quantile("m", 0.975)}, 8) AS hi, round(avg(CASE WHEN m > 0 THEN 1E0 ELSE 0E0 END), 6) AS p_positive FROM m"""


@plan
def reshuffle_dd(d: Dialect) -> str:
    """Drawdowns of the weekly returns of all tickers in 5,000 random orders, one keyed order a replicate."""
    return f"""WITH {TRADES}, wr AS (SELECT CAST(date_trunc('week', d) AS DATE) AS wk, avg(r) AS r FROM trades GROUP BY 1),
w AS (SELECT CAST(row_number() OVER (ORDER BY wk) AS BIGINT) AS k, ln(1 + r) AS l FROM wr),
o AS (SELECT b, k, sum(l) OVER (PARTITION BY b ORDER BY {d.uniform(44, "'rs'", "b", "k")} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e, {d.uniform(44, "'rs'", "b", "k")} AS u FROM w CROSS JOIN {d.rows(5000, "b")} r),
q AS (SELECT b, e - greatest(0E0, max(e) OVER (PARTITION BY b ORDER BY u ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS dd FROM o),
m AS (SELECT b, exp(min(dd)) - 1 AS dd FROM q GROUP BY b)
SELECT round(avg(dd), 6) AS mean_dd, round({d.quantile("dd", 0.05)}, 6) AS p05, round(min(dd), 6) AS worst FROM m"""


@plan
def triple_barrier(d: Dialect) -> str:
    """Every change of trend, long or short: entry at the next open, barriers of 1.5 volatilities over ten bars.

    The stop wins ties; else the close ten bars on, or the last one; net of cost at both ends.
    """
    out = "CASE WHEN stop_hit THEN e * (1 - dir * w) WHEN goal_hit THEN e * (1 + dir * w) WHEN t = last THEN close END"
    return f"""WITH {FEATURES}, {FLIPS},
v AS (SELECT ticker, t, 1.5E0 * sqrt(10E0) * stddev_pop(r) OVER (PARTITION BY ticker ORDER BY t ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS w, max(t) OVER (PARTITION BY ticker) AS n FROM rets),
sg AS (SELECT v.ticker, v.t AS t0, v.w, CASE WHEN f.up THEN 1 ELSE -1 END AS dir, o.open AS e, least(v.t + 11, v.n) AS last FROM v JOIN flips f ON f.ticker = v.ticker AND f.t = v.t JOIN ohlc o ON o.ticker = v.ticker AND o.t = v.t + 1 WHERE v.t > 60 AND v.w > 0),
b AS (SELECT sg.ticker, t0, dir, e, w, last, o.t, o.close, CASE WHEN dir = 1 THEN o.low <= e * (1 - w) ELSE o.high >= e * (1 + w) END AS stop_hit, CASE WHEN dir = 1 THEN o.high >= e * (1 + w) ELSE o.low <= e * (1 - w) END AS goal_hit
      FROM sg JOIN ohlc o ON o.ticker = sg.ticker AND o.t BETWEEN sg.t0 + 1 AND sg.last),
x AS (SELECT *, {out} AS px, CASE WHEN stop_hit THEN 'stop' WHEN goal_hit THEN 'target' ELSE 'time' END AS why FROM b),
f AS (SELECT ticker, t0, min(t) AS t FROM x WHERE px IS NOT NULL GROUP BY ticker, t0),
y AS (SELECT x.*, (1 + dir * (px / e - 1)) * (1 - 0.0005E0) * (1 - 0.0005E0) - 1 AS net FROM x JOIN f ON f.ticker = x.ticker AND f.t0 = x.t0 AND f.t = x.t)
SELECT ticker, t0 AS t, CASE dir WHEN 1 THEN 'long' ELSE 'short' END AS side, t AS exit_t, why AS exit_reason, round(net, 8) AS net, net > 0 AS label FROM y"""


@plan
def deflated_sharpe(d: Dialect) -> str:
    """Sharpe against the expected best of as many trials as the gauntlet's grid has, with skewness and raw kurtosis by moments written out."""
    p, q = 1 - 1 / TRIALS, 1 - 1 / (TRIALS * 2.718281828459045)
    return f"""WITH {TRADES}, w AS (SELECT CAST(date_trunc('week', d) AS DATE) AS wk, avg(r) AS r FROM trades GROUP BY 1), a AS (SELECT avg(r) AS m, stddev_pop(r) AS s, CAST(count(*) AS DOUBLE) AS n FROM w),
g AS (SELECT m / s AS sr, n, avg(pow((r - m) / s, 3)) AS sk, avg(pow((r - m) / s, 4)) AS ku FROM w CROSS JOIN a GROUP BY m, s, n),
z AS (SELECT sr, n, sk, ku, sqrt(1 / (n - 1)) * ((1 - 0.5772156649E0) * {d.ppf(f'CAST({p!r} AS DOUBLE)')} + 0.5772156649E0 * {d.ppf(f'CAST({q!r} AS DOUBLE)')}) AS sr0 FROM g)
SELECT round(sr, 6) AS sharpe, round(sk, 5) AS skew, round(ku, 5) AS kurt, round(sr0, 6) AS expected_best, round({d.cdf("((sr - sr0) * sqrt(n - 1) / sqrt(1 - sk * sr + (ku - 1) / 4 * sr * sr))")}, 5) AS dsr FROM z"""


@plan
def pbo_cscv(d: Dialect) -> str:
    """Probability of overfitting: the in-sample winner's out-of-sample rank over all halvings of eight blocks in a row.

    Halves are made of sums of blocks, eight rows a setting; ratios are compared to nine digits, so equal settings tie.
    """
    combos = " UNION ALL ".join(f"SELECT {i} AS cb, {b} AS blk" for i, c in enumerate(combinations(range(8), 4)) for b in c)
    ratio = lambda n, s, q: f"round(({s}) / ({n}) / nullif(sqrt((({q}) - ({s}) * ({s}) / ({n})) / (({n}) - 1)), 0E0), 9)"
    return f"""WITH {BARS}, c AS ({combos}), x AS (SELECT ticker AS cfg, r, CAST(ntile(8) OVER (PARTITION BY ticker ORDER BY t) - 1 AS INT) AS blk FROM rets WHERE r IS NOT NULL),
g AS (SELECT cfg, blk, CAST(count(*) AS DOUBLE) AS n, sum(r) AS s, sum(r * r) AS q FROM x GROUP BY cfg, blk),
al AS (SELECT cfg, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM g GROUP BY cfg),
h AS (SELECT c.cb, g.cfg, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM g JOIN c ON c.blk = g.blk GROUP BY c.cb, g.cfg),
s AS (SELECT h.cb, h.cfg, {ratio("h.n", "h.s", "h.q")} AS a, {ratio("al.n - h.n", "al.s - h.s", "al.q - h.q")} AS b FROM h JOIN al ON al.cfg = h.cfg),
w AS (SELECT cb, cfg, b, row_number() OVER (PARTITION BY cb ORDER BY a DESC, cfg) AS k FROM s WHERE a IS NOT NULL),
o AS (SELECT w.cb, avg(CASE WHEN w.b >= s.b THEN 1E0 ELSE 0E0 END) AS rank FROM w JOIN s ON w.cb = s.cb WHERE w.k = 1 GROUP BY w.cb)
SELECT CAST(count(*) AS BIGINT) AS splits, round(avg(CASE WHEN rank < 0.5E0 THEN 1E0 ELSE 0E0 END), 6) AS pbo, round(avg(rank), 6) AS mean_rank FROM o"""


@query()
def meta_label_oos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chances, out of sample, that a trade of the walk-forward side ends positive net of cost, and whether it passes 0.6."""
    views(spark, sf_dir)
    rows = spark.sql(f"""WITH {TRADES} SELECT t.ticker, t.t, CAST(t.r > 0.001E0 AS INT) AS label, CAST(t.side AS DOUBLE) AS side, f.osc, ln(f.fast / f.slow) AS trend, f.r AS last, t.side * f.mom AS mom
FROM trades t JOIN feat f ON f.ticker = t.ticker AND f.t = t.t""")
    out = meta_labels(rows, ["side", "osc", "trend", "last", "mom"])
    return out.select("ticker", "t", "label", "fold", F.round("p", 6).alias("p"), (F.col("p") >= 0.6).alias("taken"))
