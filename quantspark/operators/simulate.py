"""All nine path models from one configuration: a fold within each path's row, so no step is shuffled.

The same text of a step serves both dialects. ``{name}`` reads the state before the step, ``{step}`` its number.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import REGIME_PRESETS, Simulation
from ..functions.dialect import SPARK, Dialect


def number(x: float) -> str:
    s = repr(float(x))
    return f"({s if 'e' in s else s + 'E0'})"


def _poisson(u: str, lam: float) -> tuple[str, int]:
    """Inverse distribution function, and its largest value: the tail beyond is below 1e-12."""
    mass, total, cases, k = math.exp(-lam), 0.0, "", 0
    while 1 - (total := total + mass) > 1e-12:
        cases += f"WHEN {u} < {number(total)} THEN {k} "
        k += 1
        mass *= lam / k
    return (f"(CASE {cases}ELSE {k} END)" if cases else "0"), k


def _by_regime(values) -> str:
    return f"(CASE {{k}} WHEN 0 THEN {number(values[0])} WHEN 1 THEN {number(values[1])} ELSE {number(values[2])} END)"


def dynamics(d: Dialect, c: Simulation) -> tuple[dict[str, str], dict[str, str]]:
    """The model's state at the start and after a step; ``x`` is the log of the price over s0."""
    mu, sd, dt = c.drift, c.volatility, number(c.dt)
    path = "path"
    sign = ""
    if c.antithetic:  # the second half of the paths takes the first half's draws with the sign turned
        half = (c.paths + 1) // 2
        path, sign = f"(path % {half})", f"(CASE WHEN path >= {half} THEN -1 ELSE 1 END) * "
    draw = lambda kind: d.normal(c.seed, f"'{kind}'", path, "{step}")
    u = lambda kind, *more: d.uniform(c.seed, f"'{kind}'", path, "{step}", *more)
    z = f"{sign}{draw('z')}"
    state: dict[str, str] = {}
    move: dict[str, str] = {}
    drift = number((mu - sd * sd / 2) * c.dt)
    if c.model == "gbm":
        step = f"{drift} + {number(sd * math.sqrt(c.dt))} * {z}"
    elif c.model == "student_t":  # unit variance: a normal over the root of a mean of squares, scaled
        chi = " + ".join(f"pow({d.normal(c.seed, repr('chi'), path, '{step}', i)}, 2)" for i in range(int(c.t_df)))
        step = f"{drift} + {number(sd * math.sqrt(c.dt * (c.t_df - 2)))} * {z} / sqrt({chi})"
    elif c.model in ("bootstrap", "block_bootstrap"):
        length = c.block_length if c.model == "block_bootstrap" else 1
        block = f"CAST(floor(({{step}} - 1) / {number(length)}) AS INT)"
        start = d.uniform(c.seed, "'block'", path, block)
        index = f"(CAST(floor({start} * {d.size('h')}) AS BIGINT) + ({{step}} - 1) % {length}) % {d.size('h')} + 1"
        step = f"{number(c.vol_multiplier)} * {d.item('h', index)} + {number((mu - sd * sd / 2) * c.dt)}"
    elif c.model == "merton":
        k, _ = _poisson(u("n"), c.jumps * c.dt)
        comp = (mu - sd * sd / 2 - c.jumps * (math.exp(c.jump_mean + c.jump_vol**2 / 2) - 1)) * c.dt
        step = f"{number(comp)} + {number(sd * math.sqrt(c.dt))} * {z} + {k} * {number(c.jump_mean)} + sqrt(CAST({k} AS DOUBLE)) * {number(c.jump_vol)} * {draw('j')}"
    elif c.model == "kou":
        k, most = _poisson(u("n"), c.jumps * c.dt)
        size = lambda i: f"(CASE WHEN {u('s', i)} < {number(c.p_up)} THEN -ln({u('m', i)}) / {number(c.eta_up)} ELSE ln({u('m', i)}) / {number(c.eta_down)} END)"
        jump = " + ".join(f"(CASE WHEN {k} > {i} THEN {size(i)} ELSE 0E0 END)" for i in range(most)) or "0E0"
        comp = (mu - sd * sd / 2 - c.jumps * (c.p_up * c.eta_up / (c.eta_up - 1) + (1 - c.p_up) * c.eta_down / (c.eta_down + 1) - 1)) * c.dt
        step = f"{number(comp)} + {number(sd * math.sqrt(c.dt))} * {z} + (CASE WHEN {k} = 0 THEN 0E0 ELSE {jump} END)"
    elif c.model == "regime":  # the transition is drawn first; the new regime drives the step
        p = REGIME_PRESETS[c.regimes]
        low, mid = _by_regime([r[0] for r in p["transition"]]), _by_regime([r[0] + r[1] for r in p["transition"]])
        state["k"] = "0"
        move["k"] = f"(CASE WHEN {u('k')} < {low} THEN 0 WHEN {u('k')} < {mid} THEN 1 ELSE 2 END)"
        arm = lambda i: f"{number((mu * p['mu'][i] - (sd * p['sigma'][i]) ** 2 / 2) * c.dt)} + {number(sd * p['sigma'][i] * math.sqrt(c.dt))} * {z}"
        step = f"(CASE {move['k']} WHEN 0 THEN {arm(0)} WHEN 1 THEN {arm(1)} ELSE {arm(2)} END)"
    elif c.model == "heston":  # full truncation; the price moves with the variance before its update
        theta, v0 = (sd * sd if v is None else v for v in (c.theta, c.v0))
        state["v"] = number(v0)
        v = "greatest(0E0, {v})"
        step = f"({number(mu)} - {v} / 2) * {dt} + sqrt({v} * {dt}) * {z}"
        other = f"({number(c.rho)} * {z} + {number(math.sqrt(1 - c.rho**2))} * {sign}{draw('v')})"
        move["v"] = f"{{v}} + {number(c.kappa)} * ({number(theta)} - {v}) * {dt} + {number(c.xi)} * sqrt({v} * {dt}) * {other}"
    else:
        h0 = sd * sd * c.dt
        omega = h0 * (1 - c.alpha - c.beta) if c.omega is None else c.omega
        state["v"] = number(h0)
        step = f"{number(mu * c.dt)} - {{v}} / 2 + sqrt({{v}}) * {z}"
        move["v"] = f"{number(omega)} + {{v}} * ({number(c.alpha)} * pow({z}, 2) + {number(c.beta)})"
    crash = f" + (CASE WHEN {{step}} = 1 THEN {number(math.log1p(-c.crash))} ELSE 0E0 END)" if c.crash else ""
    # Extremes trail the price by a step; `finish` adds the last one. All include the start.
    state = {"x": "0", "hi": "0", "lo": "0", "dd": "0"} | state
    move = {"x": f"{{x}} + {step}{crash}", "hi": "greatest({hi}, {x})", "lo": "least({lo}, {x})", "dd": "least({dd}, {x} - greatest({hi}, {x}))"} | move
    return state, move


def relation(d: Dialect, c: Simulation, history: str = "", name: str = "sim") -> str:
    """Relation ``name(path, s, low, high, drawdown)``; ``history`` is a one-row relation with the array ``h`` of centred returns."""
    c.check()
    state, move = dynamics(d, c)
    source = f"(SELECT path{', h' if history else ''} FROM {d.rows(c.paths, 'path')} p{f' CROSS JOIN {history}' if history else ''})"
    s0, cost = number(c.s0), number(c.cost)
    finish = f"SELECT path, {s0} * exp(x) * (1 - {cost}) - {s0} * {cost} AS s, {s0} * exp(least(lo, x)) AS low, {s0} * exp(greatest(hi, x)) AS high, exp(least(dd, x - greatest(hi, x))) - 1 AS drawdown"
    return f"{d.fold(name + '_w', source, state, move, c.horizon, ['h'] if history else [])}, {name} AS ({finish} FROM {name}_w)"


def simulate(spark: SparkSession, c: Simulation, returns: DataFrame | None = None) -> DataFrame:
    """``(path, s, low, high, drawdown)`` of every path; bootstraps need ``returns(t, r)``, one instrument's history.

    Costs are taken at entry and exit. Resampled returns are centred on their mean, and the configured drift is added.
    """
    if not c.model.endswith("bootstrap"):
        return spark.sql(f"WITH {relation(SPARK, c)} SELECT * FROM sim")
    if returns is None:
        raise ValueError(f"{c.model} needs returns")
    h = returns.where("r is not null").agg(F.sort_array(F.collect_list(F.struct("t", "r"))).alias("a"), F.avg("r").alias("m"))
    h = h.where("size(a) >= 2").select(F.expr("transform(a, e -> e.r - m)").alias("h"))
    return spark.sql(f"WITH {relation(SPARK, c, '{history}')} SELECT * FROM sim", history=h)


def summarize(paths: DataFrame, c: Simulation) -> DataFrame:
    """One row of terminal and path risk: moments, percentiles, value at risk and shortfall as fractions of s0, probabilities."""
    from ..config import PERCENTILES, RISK_LEVELS

    s, loss = F.col("s"), (c.s0 - F.col("s")) / c.s0
    aggs = [F.count("*").alias("n"), F.avg(s).alias("mean"), F.stddev_samp(s).alias("sd"), F.skewness(s).alias("skew"), F.kurtosis(s).alias("kurtosis")]
    aggs += [F.percentile(s, F.lit(p / 100)).alias(f"p{p:02d}") for p in PERCENTILES]
    share = lambda x: F.avg(x.cast("double"))
    aggs += [share(s > c.s0).alias("prob_profit"), share(s < c.s0).alias("prob_loss"), share(F.col("low") <= c.ruin * c.s0).alias("prob_ruin"), share(F.col("drawdown") <= -0.5).alias("prob_drawdown_50")]
    cuts = [F.percentile(loss, F.lit(v / 100)).alias(f"var_{v:g}".replace(".", "_")) for v in RISK_LEVELS]
    one = paths.agg(*aggs, *cuts, F.max(loss).alias("worst"))
    tails = [F.avg(F.when(loss >= F.col(f"var_{v:g}".replace(".", "_")), loss)).alias(f"es_{v:g}".replace(".", "_")) for v in RISK_LEVELS]
    names = [f"var_{v:g}".replace(".", "_") for v in RISK_LEVELS]
    es = paths.join(F.broadcast(one.select(*names)), F.lit(True)).agg(*tails)  # one row of cuts
    return one.join(F.broadcast(es), F.lit(True))
