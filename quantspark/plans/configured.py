"""Configurations as rows: alerts applied to settings, thousands of runs in one plan, model comparison by ticker from its own history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import MODELS
from ..functions.dialect import DUCK, SPARK, Dialect
from ..operators.configured import DEFAULTS, complete, runs
from ..registry import oracle, plan, query
from ..sources.scratch import stored
from ..sources.tables import BARS, views
from .events import _NAMED, ALERTS
from .signals import _SHRINK, FEATURES, _newey_west

def market(d: Dialect, history: bool = False) -> str:
    """Relations ``mkt`` (each ticker's annual drift and volatility, and last close) and, where asked for, ``hist`` (its centred returns)."""
    own = "mkt AS (SELECT ticker, count(r) AS n, 252 * avg(r) + 126 * var_samp(r) AS mu, stddev_samp(r) * sqrt(252E0) AS sigma, max_by(close, t) AS s0 FROM rets GROUP BY ticker)"
    centred = "rm AS (SELECT ticker, t, r, avg(r) OVER (PARTITION BY ticker) AS m FROM rets WHERE r IS NOT NULL)"
    if d.name == "spark":
        rows = "hist AS (SELECT ticker, transform(a, e -> e.r - m) AS h FROM (SELECT ticker, m, sort_array(collect_list(named_struct('t', t, 'r', r))) AS a FROM rm GROUP BY ticker, m) x)"
    else:
        rows = "hist AS (SELECT ticker, list(r - m ORDER BY t) AS h FROM rm GROUP BY ticker)"
    return f"{own}, {centred}, {rows}" if history else own


def _recursive(d: Dialect) -> str:
    return "RECURSIVE " if d.name == "duckdb" else ""


def _applied(d: Dialect) -> str:
    """Relations that end in ``applied``, alerts joined to calibrations and market figures: ticker, price, side by trend, whether a
    long-only user may trade, calibrated drift, volatility and jumps by the oscillator's distance from its middle."""
    pull = "greatest(-1E0, least(1E0, (rsi - 50) / 50))"
    hint = "/*+ BROADCAST(m, t) */ " if d.name == "spark" else ""  # a row a ticker, and a row a ticker's bucket
    return f"""{ALERTS.strip()}, {FEATURES.lstrip()}, smp AS (SELECT ticker, bucket, t, fwd AS x FROM buck WHERE fwd IS NOT NULL), {_newey_west("smp", "ticker, bucket")},
tab AS (SELECT ticker, bucket, 252 / 5E0 * {_SHRINK} AS drift FROM smp_nw), {market(d)},
named AS (SELECT av.event_id, {_NAMED} AS name, av.trend, av.tercile, av.rsi, CAST({d.json("av.props", "k")} AS DOUBLE) AS price FROM av JOIN events e ON e.event_id = av.event_id),
applied AS (SELECT {hint}a.event_id, CASE WHEN a.name = 'NONE' THEN 'DEFAULT' ELSE a.name END AS ticker, CASE WHEN a.price > 0 THEN a.price ELSE coalesce(m.s0, 100E0) END AS s0, CASE a.trend WHEN 'bullish' THEN 'long' WHEN 'bearish' THEN 'short' ELSE 'long' END AS side,
  a.trend <> 'bearish' AS allowed, coalesce(t.drift, 0E0) AS mu, coalesce(m.sigma, 0.3E0) * greatest(0.5E0, least(2E0, 1 + 0.4E0 * {pull})) AS sigma, least(2.5E0, 1 + 0.5E0 * abs({pull})) AS jump_multiplier,
  concat_ws('; ', CASE WHEN a.name <> 'NONE' THEN 'ticker' END, CASE WHEN a.price > 0 THEN 'price' END, CASE WHEN a.trend <> 'neutral' THEN 'side' END, CASE WHEN t.drift IS NOT NULL THEN 'drift' END, CASE WHEN rsi <> 50 THEN 'volatility, jumps' END) AS changed
  FROM named a LEFT JOIN mkt m ON m.ticker = a.name LEFT JOIN tab t ON t.ticker = a.name AND t.bucket = concat(a.trend, '_', a.tercile))"""


@plan
def applied_signals(d: Dialect) -> str:
    """What each alert sets: a left join of alerts, calibrations and market figures; what is missing keeps its default."""
    return f"WITH {_applied(d)} SELECT event_id, ticker, round(s0, 6) AS s0, side, allowed, round(mu, 6) AS mu, round(sigma, 6) AS sigma, round(jump_multiplier, 6) AS jump_multiplier, changed FROM applied"


@plan
def alert_runs(d: Dialect) -> str:
    """A run of jump diffusion for every alert, each with its own price, drift, volatility and jumps; the trade's side decides its profit."""
    paths, days = 8, 5
    source = f"(SELECT event_id AS run, 'merton' AS model, {paths} AS paths, {days} AS horizon, side, s0, mu, sigma, jump_multiplier AS jumps, 0.001E0 AS cost FROM applied)"
    pnl = "(CASE side WHEN 'short' THEN s0 - s ELSE s - s0 END / s0)"
    return f"""WITH {_recursive(d)}{_applied(d)}, cfg AS {complete(source, ("s0", "mu", "sigma", "jumps", "cost"), ("side",))}, {runs(d, "cfg", models=("merton",), keep=("side",), shared=(DEFAULTS["seed"], paths, days))}
SELECT run AS event_id, CAST(count(*) AS BIGINT) AS paths, round(avg(s), 5) AS mean, round(avg({pnl}), 8) AS mean_pnl, round(avg(CASE WHEN {pnl} > 0 THEN 1E0 ELSE 0E0 END), 6) AS prob_profit, round(min(drawdown), 6) AS worst_drawdown FROM runs GROUP BY run"""


#: The comparison's columns, in order.
COMPARISON = (
    "model", "expected_ending_value", "median_ending_value", "prob_profit", "prob_loss", "prob_gain_20", "prob_loss_10", "prob_loss_20", "prob_drawdown_50", "percentile_5", "percentile_95", "var_99", "es_99", "evt_var_99", "evt_es_99", "max_drawdown_prob", "prob_ruin", "sharpe",
    "sortino", "disagreement_rank", "runtime_seconds", "chunk_safe",
)


def compared(d: Dialect, key: str = "ticker") -> str:
    """Relations that end in ``compared``: terminal figures of ``runs(ticker, model, s0, s, low, drawdown)``, tails by peaks over the
    95th percentile of losses, and ranks by distance from the models' medians in units of the median distance."""
    share = lambda c: f"avg(CASE WHEN {c} THEN 1E0 ELSE 0E0 END)"
    metrics = ("m", "q05", "v99", "e99", "l20", "rn")
    med = ", ".join(f"{d.quantile(c, 0.5)} AS {c}" for c in metrics)
    mad = ", ".join(f"{d.quantile(f'abs(a.{c} - b.{c})', 0.5)} AS {c}, coalesce(stddev_pop(a.{c}), 0E0) AS s_{c}" for c in metrics)
    distance = " + ".join(f"abs(a.{c} - b.{c}) / CASE WHEN w.{c} > 1E-12 THEN w.{c} WHEN w.s_{c} > 1E-12 THEN w.s_{c} ELSE 1E0 END" for c in metrics)
    return f"""cut AS (SELECT {key}, model, {d.quantile("s - s0", 0.01)} AS q99, {d.quantile("s0 - s", 0.95)} AS u, CAST(count(*) AS DOUBLE) AS n FROM runs GROUP BY {key}, model),
pot AS (SELECT r.{key}, r.model, c.u, c.n, CAST(count(*) AS DOUBLE) AS k, avg(s0 - s - u) AS m, var_samp(s0 - s - u) AS v FROM runs r JOIN cut c ON c.{key} = r.{key} AND c.model = r.model WHERE s0 - s > u GROUP BY r.{key}, r.model, c.u, c.n),
gp AS (SELECT *, 0.5E0 * (1 - m * m / v) AS xi, 0.5E0 * m * (m * m / v + 1) AS beta FROM pot WHERE k >= 3 AND v > 0),
ev AS (SELECT {key}, model, xi, beta, u, CASE WHEN abs(xi) < 1E-9 THEN u - beta * ln(0.01E0 * n / k) ELSE u + beta / xi * (pow(0.01E0 * n / k, -xi) - 1) END AS var99 FROM gp),
ag AS (SELECT r.{key}, r.model, avg(s) AS m, {d.quantile("s", 0.5)} AS med, {share("s > s0")} AS up, {share("s < s0")} AS down, {share("s > 1.2E0 * s0")} AS g20, {share("s < 0.9E0 * s0")} AS l10, {share("s < 0.8E0 * s0")} AS l20, {share("drawdown <= -0.5E0")} AS d50,
  {d.quantile("s", 0.05)} AS q05, {d.quantile("s", 0.95)} AS q95, -max(q99) AS v99, -coalesce(avg(CASE WHEN s - s0 <= q99 THEN s - s0 END), min(s - s0)) AS e99, {share("low <= 0.5E0 * s0")} AS rn, avg(s / s0) - 1 AS er, stddev_samp(s / s0) AS sr, sqrt(avg(CASE WHEN s < s0 THEN (s / s0 - 1) * (s / s0 - 1) END)) AS dn
  FROM runs r JOIN cut c ON c.{key} = r.{key} AND c.model = r.model GROUP BY r.{key}, r.model),
mid AS (SELECT {key}, {med} FROM ag GROUP BY {key}), spread AS (SELECT a.{key}, {mad} FROM ag a JOIN mid b ON b.{key} = a.{key} GROUP BY a.{key}),
far AS (SELECT a.*, {distance} AS far FROM ag a JOIN mid b ON b.{key} = a.{key} JOIN spread w ON w.{key} = a.{key}),
compared AS (SELECT f.{key}, f.model, m AS expected_ending_value, med AS median_ending_value, up AS prob_profit, down AS prob_loss, g20 AS prob_gain_20, l10 AS prob_loss_10, l20 AS prob_loss_20, d50 AS prob_drawdown_50, q05 AS percentile_5, q95 AS percentile_95, v99 AS var_99, e99 AS es_99,
  ev.var99 AS evt_var_99, CASE WHEN ev.xi < 1 THEN (ev.var99 + ev.beta - ev.xi * ev.u) / (1 - ev.xi) WHEN ev.xi >= 1 THEN CAST('Infinity' AS DOUBLE) END AS evt_es_99, d50 AS max_drawdown_prob, rn AS prob_ruin, CASE WHEN sr > 0 THEN er / sr ELSE 0E0 END AS sharpe, CASE WHEN dn > 0 THEN er / dn ELSE 0E0 END AS sortino,
  CAST(row_number() OVER (PARTITION BY f.{key} ORDER BY round(far, 9) DESC, f.model) AS INT) AS disagreement_rank, CAST(NULL AS DOUBLE) AS runtime_seconds, true AS chunk_safe, far AS distance,
  row_number() OVER (PARTITION BY f.{key} ORDER BY round(v99, 9) DESC, f.model) = 1 AS most_conservative FROM far f LEFT JOIN ev ON ev.{key} = f.{key} AND ev.model = f.model)"""


def by_ticker(d: Dialect, models: tuple[str, ...], paths: int, horizon: int, seed: int, more: dict[str, str] | None = None, averages: bool = False) -> str:
    """Relations ``mkt`` and more that end in ``runs(run, ticker, model, ...)``: every model for every ticker, with the ticker's drift, volatility and history."""
    more = {"jumps": "3E0"} | (more or {})
    mu = more.pop("mu", "m.mu")
    history = any(m.endswith("bootstrap") for m in models)
    names = " UNION ALL ".join(f"SELECT '{m}' AS model" for m in models)
    h = f", CASE WHEN k.model LIKE '%bootstrap' THEN hist.h END AS h FROM mkt m CROSS JOIN ({names}) k JOIN hist ON hist.ticker = m.ticker" if history else f" FROM mkt m CROSS JOIN ({names}) k"
    own = "".join(f", {v} AS {c}" for c, v in more.items())
    source = f"(SELECT concat(m.ticker, ':', k.model) AS run, m.ticker, k.model, {paths} AS paths, {horizon} AS horizon, {mu} AS mu, m.sigma, 100E0 AS s0, {seed} AS seed{own}{h})"
    kept = ("ticker",)
    cfg = complete(source, ("mu", "sigma", "s0", "seed", *more), kept, history)
    return f"{market(d, history)}, cfg AS {cfg}, {runs(d, 'cfg', models=models, keep=('ticker', 'model'), history=history, most_paths=paths, averages=averages)}"


_TABLE = "SELECT ticker, " + ", ".join(c if c in ("model", "disagreement_rank", "runtime_seconds", "chunk_safe") else f"round({c}, 5) AS {c}" for c in COMPARISON) + ", most_conservative FROM compared"


@query(oracle(f"WITH {_recursive(DUCK)}{BARS}, {by_ticker(DUCK, MODELS, 200, 12, 101)}, {compared(DUCK)} {_TABLE}"))
def comparison_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine models on each ticker's own figures and history, as the 22 columns of the comparison."""
    views(spark, sf_dir)
    paths = stored(spark.sql(f"WITH {BARS}, {by_ticker(SPARK, MODELS, 200, 12, 101)} SELECT * FROM runs"), "runs")
    return spark.sql(f"WITH runs AS (SELECT * FROM {{runs}}), {compared(SPARK)} {_TABLE}", runs=paths)


#: What each model assumes besides drift and volatility: names of settings.
ASSUMES = {
    "gbm": (), "student_t": ("t_df",), "bootstrap": (), "block_bootstrap": ("block_length",), "merton": ("jumps", "jump_mean", "jump_vol"), "regime": ("regimes",), "heston": ("kappa", "theta", "xi", "rho", "v0"),
    "garch": ("alpha", "beta", "omega"), "kou": ("jumps", "p_up", "eta_up", "eta_down"),
}


@plan
def model_assumptions(d: Dialect) -> str:
    """A row an assumption of every model for every ticker: its drift and volatility, and the settings that the model reads; what is left open follows from them."""
    derived = {"theta": "sigma * sigma", "v0": "sigma * sigma", "omega": "sigma * sigma / 252 * 0.02E0"}
    value = lambda k: derived.get(k, f"{DEFAULTS[k]!r}E0" if isinstance(DEFAULTS[k], float) else f"CAST({DEFAULTS[k]} AS DOUBLE)")
    rows = [(m, "drift", "mu", "'history'") for m in MODELS] + [(m, "volatility", "sigma", "'history'") for m in MODELS]
    rows += [(m, k, value(k), "'derived'" if k in derived else "'default'") for m, ks in ASSUMES.items() for k in ks if k != "regimes"] + [("regime", "regimes", "CAST(3 AS DOUBLE)", "'stock'")]
    arms = " UNION ALL ".join(f"SELECT ticker, '{m}' AS model, '{k}' AS assumption, {v} AS value, {o} AS origin FROM mkt" for m, k, v, o in rows)
    return f"WITH {BARS}, {market(d)}, a AS ({arms}) SELECT ticker, model, assumption, round(value, 8) AS value, origin FROM a"
