"""The whole bundle of terminal statistics, options under four models, confidence in a model, comparison with a benchmark."""

from __future__ import annotations

import math

from ..config import RISK_LEVELS
from ..functions.dialect import Dialect
from ..operators.options import Option
from ..operators.simulate import number
from ..registry import plan
from ..sources.tables import BARS
from .configured import _recursive, by_ticker


def _share(c: str) -> str:
    return f"avg(CASE WHEN {c} THEN 1E0 ELSE 0E0 END)"


@plan
def stats_bundle(d: Dialect) -> str:
    """Net ending values of each ticker: moments, chances by threshold, the worst hundredth, losses at three levels, ratios, and their annual values."""
    steps = 42
    ann, per = number(math.sqrt(252 / steps)), number(252 / steps)
    key = lambda v: f"{v:g}".replace(".", "_")
    cuts = ", ".join(f"{d.quantile('s - 100', 1 - v / 100)} AS q{key(v)}" for v in RISK_LEVELS)
    tails = ", ".join(f"coalesce(avg(CASE WHEN s - 100 <= q{key(v)} THEN s - 100 END), min(s - 100)) AS e{key(v)}" for v in RISK_LEVELS)
    risk = ", ".join(f"round(-q{key(v)}, 6) AS var_{key(v)}, round(-q{key(v)} / 100, 8) AS var_pct_{key(v)}, round(-e{key(v)}, 6) AS es_{key(v)}, round(-e{key(v)} / 100, 8) AS es_pct_{key(v)}" for v in RISK_LEVELS)
    ratio = lambda a, b: f"(CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0E0 END)"
    return f"""WITH {_recursive(d)}{BARS}, {by_ticker(d, ("gbm",), 400, steps, 81, {"cost": "0.001E0"})},
q AS (SELECT ticker, {cuts}, {d.quantile("s", 0.01)} AS p01 FROM runs GROUP BY ticker),
a AS (SELECT sim.ticker, count(*) AS n, avg(s) AS m, {d.quantile("s", 0.5)} AS med, coalesce(stddev_samp(s), 0E0) AS sd, min(s) AS lo, max(s) AS hi, {_share("s > 100")} AS up, {_share("s < 100")} AS down, {_share("s > 120")} AS g20, {_share("s < 90")} AS l10, {_share("s < 80")} AS l20,
        avg(CASE WHEN s <= p01 THEN s END) AS w1, {tails}, coalesce(sqrt(avg(CASE WHEN s < 100 THEN (s / 100 - 1) * (s / 100 - 1) END)), 0E0) AS dn, -avg(drawdown) AS mdd, {_share("low <= 50")} AS ruin, {_share("drawdown <= -0.5E0")} AS dd50 FROM runs sim JOIN q ON q.ticker = sim.ticker GROUP BY sim.ticker),
r AS (SELECT a.*, {', '.join(f'q.q{key(v)}' for v in RISK_LEVELS)}, m / 100 - 1 AS er, sd / 100 AS sr FROM a JOIN q ON q.ticker = a.ticker)
SELECT ticker, CAST(n AS BIGINT) AS paths, round(m, 6) AS expected_value, round(med, 6) AS median_value, round(er, 8) AS expected_return, round(sd, 6) AS std_value, round(lo, 6) AS min_value, round(hi, 6) AS max_value, up AS prob_profit, down AS prob_loss, g20 AS prob_gain_20, l10 AS prob_loss_10, l20 AS prob_loss_20,
       round(w1, 6) AS worst_1pct, {risk}, round(sr, 8) AS return_std, round(dn, 8) AS downside_std, round({ratio("er", "sr")}, 6) AS sharpe, round({ratio("er", "dn")}, 6) AS sortino, round({ratio("er", "(sr * sr)")}, 6) AS kelly, round({ann} * {ratio("er", "sr")}, 6) AS sharpe_annual,
       round({ann} * {ratio("er", "dn")}, 6) AS sortino_annual, round(pow(1 + er, {per}) - 1, 8) AS annualized_return, round({ratio(f"(pow(1 + er, {per}) - 1)", "mdd")}, 6) AS calmar, round(mdd, 8) AS mean_max_drawdown, ruin AS prob_ruin, dd50 AS prob_drawdown_50 FROM r"""


_CONTRACTS = {
    "european_call": Option(), "european_put": Option(call=False), "asian_call": Option("asian"), "asian_put": Option("asian", call=False), "geometric_call": Option("asian-geometric"), "digital_call": Option("digital"), "down_out_call": Option("barrier", barrier=88.0),
    "down_in_call": Option("barrier", barrier=88.0, knock="in"), "up_out_put": Option("barrier", barrier=115.0, call=False, direction="up"), "lookback_call": Option("lookback"), "lookback_floating_put": Option("lookback", call=False, floating=True),
}


@plan
def option_models(d: Dialect) -> str:
    """Eleven contracts under four models on each ticker's volatility: price and error, and the discounted mean price over its error from the start (the drift's check)."""
    rate, years, steps = 0.05, 0.5, 20
    disc = number(math.exp(-rate * years))
    cols = lambda x, k: f"round(avg({disc} * {x}), 6) AS {k}, round(stddev_samp({disc} * {x}) / sqrt(CAST(count(*) AS DOUBLE)), 6) AS {k}_se"
    sims = by_ticker(d, ("gbm", "heston", "merton", "regime"), 250, steps, 90, {"mu": number(rate), "dt": number(years / steps)}, averages=True)
    return f"""WITH {_recursive(d)}{BARS}, {sims}
SELECT ticker, model, {", ".join(cols(o.payoff(), k) for k, o in _CONTRACTS.items())}, round((avg({disc} * s) - 100) / (stddev_samp({disc} * s) / sqrt(CAST(count(*) AS DOUBLE))), 5) AS drift_z FROM runs GROUP BY ticker, model"""


@plan
def model_confidence(d: Dialect) -> str:
    """Points against a ticker's estimates: history, drift, volatility, spread and level of the chance of losing 20 % in a year over
    three models, coverage of its bands; the confidence by points, and the warnings."""
    w = "(PARTITION BY ticker ORDER BY t ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)"
    chance = lambda mu: d.cdf(f"((ln(0.8E0) - ({mu} - sigma * sigma / 2)) / sigma)")
    rules = [
        ("n < 252", 2, "very short history"), ("n >= 252 AND n < 504", 1, "limited history"), ("mu > 0.5E0", 2, "extreme drift"), ("mu > 0.3E0 AND mu <= 0.5E0", 1, "high drift"), ("sigma > 0.6E0", 2, "very high volatility"), ("sigma > 0.4E0 AND sigma <= 0.6E0", 1, "elevated volatility"),
        ("spread > 0.15E0", 2, "models disagree strongly"), ("spread > 0.08E0 AND spread <= 0.15E0", 1, "models disagree"), ("middle > 0.25E0", 2, "severe tail risk"), ("middle > 0.15E0 AND middle <= 0.25E0", 1, "notable tail risk"), ("inside IS NOT NULL AND (inside < 0.8E0 OR inside > 0.98E0)", 1, "coverage off target"),
    ]
    points = " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for c, p, _ in rules)
    words = ", ".join(f"CASE WHEN {c} THEN '{m}' END" for c, _, m in rules)
    return f"""WITH {BARS}, e AS (SELECT ticker, count(r) AS n, 252 * avg(r) + 126 * var_samp(r) AS mu, stddev_samp(r) * sqrt(252E0) AS sigma FROM rets GROUP BY ticker),
f AS (SELECT ticker, lead(ln(close), 252) OVER (PARTITION BY ticker ORDER BY t) - ln(close) AS y FROM bars), h AS (SELECT ticker, {_share("y < ln(0.8E0)")} AS hist FROM f WHERE y IS NOT NULL GROUP BY ticker),
b AS (SELECT ticker, t, avg(r) OVER {w} AS m, stddev_samp(r) OVER {w} AS s, lead(ln(close), 5) OVER (PARTITION BY ticker ORDER BY t) - ln(close) AS y FROM rets),
v AS (SELECT ticker, {_share("abs(y - 5 * m) <= 1.6448536269514722E0 * s * sqrt(5E0)")} AS inside FROM b WHERE t > 252 AND y IS NOT NULL GROUP BY ticker),
p AS (SELECT e.*, {chance("mu")} AS a1, {chance("0E0")} AS a2, coalesce(hist, {chance("mu / 2")}) AS a3, inside FROM e LEFT JOIN h ON h.ticker = e.ticker LEFT JOIN v ON v.ticker = e.ticker),
x AS (SELECT *, greatest(a1, a2, a3) - least(a1, a2, a3) AS spread, a1 + a2 + a3 - greatest(a1, a2, a3) - least(a1, a2, a3) AS middle FROM p),
k AS (SELECT *, {points} AS points, concat_ws('; ', {words}) AS warnings FROM x)
SELECT ticker, CAST(n AS BIGINT) AS n, round(mu, 6) AS mu, round(sigma, 6) AS sigma, round(spread, 5) AS spread, round(middle, 5) AS middle, round(inside, 6) AS coverage, CAST(points AS BIGINT) AS points, CASE WHEN points <= 2 THEN 'High' WHEN points <= 5 THEN 'Medium' ELSE 'Low' END AS confidence,
       CASE WHEN points > 5 THEN concat_ws('; ', warnings, 'do not rely on this result alone') ELSE warnings END AS warnings FROM k"""


@plan
def benchmark_compare(d: Dialect) -> str:
    """Each ticker against the mean of all, aligned from the end: annual return, volatility, drawdown, downside deviation, beta, correlation."""
    eq = lambda x: f"exp(sum({x}) OVER (PARTITION BY ticker ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"
    dd = lambda x: f"1 - {x} / max({x}) OVER (PARTITION BY ticker ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    down = lambda x: f"coalesce(sqrt(avg(CASE WHEN {x} < 0 THEN {x} * {x} END)), 0E0)"
    return f"""WITH {BARS}, i AS (SELECT ticker, r, row_number() OVER (PARTITION BY ticker ORDER BY t DESC) AS k FROM rets WHERE r IS NOT NULL),
m AS (SELECT k, avg(r) AS b FROM i GROUP BY k), j AS (SELECT ticker, i.k, r, b FROM i JOIN m ON m.k = i.k), e AS (SELECT *, {eq("r")} AS er, {eq("b")} AS eb FROM j), w AS (SELECT *, {dd("er")} AS dr, {dd("eb")} AS db FROM e)
SELECT ticker, CAST(count(*) AS BIGINT) AS days, round(252 * avg(r), 6) AS annual_return, round(252 * avg(b), 6) AS benchmark_return, round(stddev_samp(r) * sqrt(252E0), 6) AS volatility, round(stddev_samp(b) * sqrt(252E0), 6) AS benchmark_volatility, round(max(dr), 6) AS max_drawdown, round(max(db), 6) AS benchmark_drawdown,
       round(covar_samp(r, b) / nullif(var_samp(b), 0E0), 6) AS beta, round(corr(r, b), 6) AS correlation, round(252 * (avg(r) - avg(b)), 6) AS excess_return, round({down("r")}, 8) AS downside, round({down("b")}, 8) AS benchmark_downside, round({down("r")} - {down("b")}, 8) AS downside_gap FROM w GROUP BY ticker"""
