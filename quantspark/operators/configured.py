"""Runs whose settings are columns: one fold simulates any number of configurations, each a row of a relation.

The draws are those of ``simulate``: a run of a row equals the single run with the same settings, and rows with one seed share
draws. Only models that occur need be named; a step evaluates the arm of its row's model alone.
"""

from __future__ import annotations

from dataclasses import fields

from ..config import MODELS, REGIME_PRESETS, Simulation
from ..functions.dialect import Dialect
from .simulate import number

#: Columns that a configuration may leave out, with their defaults; drift and volatility are those after mode and stress.
DEFAULTS = {f.name: f.default for f in fields(Simulation)} | {"regimes": "stock", "theta": None, "v0": None, "omega": None}
_USED = ("s0", "mu", "sigma", "dt", "seed", "cost", "crash", "vol_multiplier", "antithetic", "t_df", "block_length", "jumps", "jump_mean", "jump_vol", "regimes", "kappa", "theta", "xi", "rho", "v0", "omega", "alpha", "beta", "p_up", "eta_up", "eta_down")
#: Terms of sums whose length a column sets: degrees of freedom and jumps a step at most.
MOST_DF, MOST_JUMPS = 10, 6


def _literal(v) -> str:
    if v is None:
        return "CAST(NULL AS DOUBLE)"
    if isinstance(v, bool):
        return "true" if v else "false"
    return f"'{v}'" if isinstance(v, str) else str(v) if isinstance(v, int) else number(v)


def complete(source: str, given: tuple[str, ...], keep: tuple[str, ...] = (), history: bool = False) -> str:
    """``source`` (run, model, paths, horizon, and the columns ``given``) with every setting that it leaves out at its default."""
    rest = ", ".join(f"{_literal(DEFAULTS[c])} AS {c}" for c in _USED if c not in given)
    names = ", ".join(dict.fromkeys(["run", "model", "paths", "horizon", *keep, *given, *(["h"] if history else [])]))
    return f"(SELECT {names}{', ' + rest if rest else ''} FROM {source} c0)"


_HALF = "CAST(ceil(paths / 2E0) AS BIGINT)"
#: The path whose draws a path takes.
_DRAWN = f"(CASE WHEN antithetic THEN path % {_HALF} ELSE path END)"


def _steps(d: Dialect, models: tuple[str, ...], draws: dict[str, str] | None = None, fixed: dict[str, str] | None = None) -> tuple[dict[str, str], dict[str, str]]:
    """The state at the start and after a step. Where ``draws`` and ``fixed`` are given, they take the texts that depend on seed, path and
    step alone and those that depend on the row alone, and the steps read columns of those names."""
    path, sign = _DRAWN, f"(CASE WHEN antithetic AND path >= {_HALF} THEN -1 ELSE 1 END)"

    def aside(kept: dict[str, str] | None, name: str, text: str) -> str:
        if kept is None:
            return text
        kept[name] = text
        return name

    def drawn(make, kind: str, *more) -> str:
        return aside(draws, "_".join(map(str, ("draw", kind, *more, "{step}"))), make("seed", f"'{kind}'", path if draws is None else "path", "{step}", *more))

    draw = lambda kind, *more: drawn(d.normal, kind, *more)
    u = lambda kind, *more: drawn(d.uniform, kind, *more)
    z = f"{sign} * {draw('z')}"
    drift, root = "(mu - sigma * sigma / 2) * dt", "sigma * sqrt(dt)"
    lam = "(jumps * dt)"
    below, term = [], f"exp(-{lam})"
    for k in range(MOST_JUMPS):
        below.append(aside(fixed, f"below_{k}", " + ".join(f"{term} * pow({lam}, {i}) / {number(_factorial(i))}" for i in range(k + 1))))
    count = "(" + " + ".join(f"CASE WHEN {u('n')} >= {b} THEN 1 ELSE 0 END" for b in below) + ")"
    chi = " + ".join(f"(CASE WHEN {i} < t_df THEN pow({draw('chi', i)}, 2) ELSE 0E0 END)" for i in range(MOST_DF))
    length = "(CASE model WHEN 'bootstrap' THEN 1 ELSE block_length END)"
    start = d.uniform("seed", "'block'", path, f"CAST(floor(({{step}} - 1) / CAST({length} AS DOUBLE)) AS INT)")
    index = f"(CAST(floor({start} * {d.size('h')}) AS BIGINT) + ({{step}} - 1) % {length}) % {d.size('h')} + 1"
    size = lambda i: f"(CASE WHEN {u('s', i)} < p_up THEN -ln({u('m', i)}) / eta_up ELSE ln({u('m', i)}) / eta_down END)"
    kou = " + ".join(f"(CASE WHEN {count} > {i} THEN {size(i)} ELSE 0E0 END)" for i in range(MOST_JUMPS))
    by_preset = lambda f: "(CASE regimes " + " ".join(f"WHEN '{p}' THEN (CASE {{k}} WHEN 0 THEN {number(f(r, 0))} WHEN 1 THEN {number(f(r, 1))} ELSE {number(f(r, 2))} END)" for p, r in REGIME_PRESETS.items()) + " END)"
    to = f"(CASE WHEN {u('k')} < {by_preset(lambda r, k: r['transition'][k][0])} THEN 0 WHEN {u('k')} < {by_preset(lambda r, k: r['transition'][k][0] + r['transition'][k][1])} THEN 1 ELSE 2 END)"
    arm = lambda r, k: f"(mu * {number(r['mu'][k])} - sigma * {number(r['sigma'][k])} * sigma * {number(r['sigma'][k])} / 2) * dt + sigma * {number(r['sigma'][k])} * sqrt(dt) * {z}"
    regime = "(CASE regimes " + " ".join(f"WHEN '{p}' THEN (CASE {to} WHEN 0 THEN {arm(r, 0)} WHEN 1 THEN {arm(r, 1)} ELSE {arm(r, 2)} END)" for p, r in REGIME_PRESETS.items()) + " END)"
    v = "greatest(0E0, {v})"
    historic = f"vol_multiplier * {d.item('h', index)} + {drift}"
    steps = {
        "gbm": f"{drift} + {root} * {z}",
        "student_t": f"{drift} + sigma * sqrt(dt * (t_df - 2)) * {z} / sqrt({chi})",
        "bootstrap": historic, "block_bootstrap": historic,
        "merton": f"(mu - sigma * sigma / 2 - jumps * (exp(jump_mean + jump_vol * jump_vol / 2) - 1)) * dt + {root} * {z} + {count} * jump_mean + sqrt(CAST({count} AS DOUBLE)) * jump_vol * {draw('j')}",
        "kou": f"(mu - sigma * sigma / 2 - jumps * (p_up * eta_up / (eta_up - 1) + (1 - p_up) * eta_down / (eta_down + 1) - 1)) * dt + {root} * {z} + {kou}",
        "regime": regime,
        "heston": f"(mu - {v} / 2) * dt + sqrt({v} * dt) * {z}",
        "garch": f"mu * dt - {{v}} / 2 + sqrt({{v}}) * {z}",
    }
    case = lambda arms, other: "(CASE model " + " ".join(f"WHEN '{m}' THEN {t}" for m, t in arms.items() if m in models) + f" ELSE {other} END)" if any(m in models for m in arms) else other
    heston = f"{{v}} + kappa * (coalesce(theta, sigma * sigma) - {v}) * dt + xi * sqrt({v} * dt) * (rho * {z} + sqrt(1 - rho * rho) * {sign} * {draw('v')})"
    garch = f"coalesce(omega, sigma * sigma * dt * (1 - alpha - beta)) + {{v}} * (alpha * pow({z}, 2) + beta)"
    state = {"x": "0", "hi": "0", "lo": "0", "dd": "0", "v": case({"heston": "coalesce(v0, sigma * sigma)", "garch": "sigma * sigma * dt"}, "0E0"), "k": "0"}
    move = {
        "x": f"{{x}} + {case(steps, 'CAST(NULL AS DOUBLE)')} + (CASE WHEN {{step}} = 1 AND crash > 0 THEN ln(1 - crash) ELSE 0E0 END)", "hi": "greatest({hi}, {x})", "lo": "least({lo}, {x})",
        "dd": "least({dd}, {x} - greatest({hi}, {x}))", "v": case({"heston": heston, "garch": garch}, "{v}"), "k": case({"regime": to}, "{k}"),
    }
    return state, move


def _factorial(n: int) -> float:
    return float(n * _factorial(n - 1)) if n > 1 else 1.0


def runs(d: Dialect, source: str, name: str = "runs", models: tuple[str, ...] = MODELS, keep: tuple[str, ...] = (), history: bool = False, most_paths: int | None = None, averages: bool = False, shared: tuple[int, int, int] | None = None) -> str:
    """Relation ``name(run, keep..., s0, path, s, low, high, drawdown)`` (with ``averages`` also mean and geometric, without the start) of a ``complete`` source; ``h`` holds centred returns where ``history``.

    With ``most_paths`` a few configurations are sent to tasks that deal out path numbers; without it each configuration's row makes
    its own paths where it is, which suits many configurations. ``shared`` (seed, most paths, most steps; few steps) says that every row
    has that seed: Spark then makes each path's draws once for all rows, and the steps are projections instead of a fold.
    """
    apart = shared is not None and d.name == "spark"
    draws, fixed = ({}, {}) if apart else (None, None)
    state, move = _steps(d, models, draws, fixed)
    if averages:  # these trail the price by a step, as the extremes do
        state |= {"sa": "0", "sg": "0"}
        move |= {"sa": "{sa} + (CASE WHEN {step} > 1 THEN exp({x}) ELSE 0E0 END)", "sg": "{sg} + {x}"}
    kept = ["run", *keep, "path", "paths", "horizon", "model", *_USED, *(["h"] if history else [])]
    kept = list(dict.fromkeys(kept))
    if most_paths:
        rows = f"(SELECT /*+ BROADCAST(c) */ c.*, path FROM {d.rows(most_paths, 'path')} p CROSS JOIN {source} c WHERE path < paths)"
    elif d.name == "spark":
        rows = f"(SELECT c.*, explode(sequence(CAST(0 AS BIGINT), CAST(paths - 1 AS BIGINT))) AS path FROM {source} c)"
    else:
        rows = f"(SELECT c.*, unnest(range(CAST(paths AS BIGINT))) AS path FROM {source} c)"
    if apart:
        seed, paths, last = shared
        init = ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in state.items())
        made = "".join(f", {text.format(step=k)} AS {column.format(step=k)}" for k in range(1, last + 1) for column, text in draws.items())
        own = "".join(f", {text} AS {column}" for column, text in fixed.items())
        after = lambda i: ", ".join(f"CASE WHEN {i} <= horizon THEN CAST({move[k].format(**{k: k for k in state}, step=i)} AS DOUBLE) ELSE {k} END AS {k}" for k in state)
        walk = f"{name}_d AS (SELECT path AS drawn{made} FROM (SELECT path, {seed} AS seed FROM {d.rows(paths, 'path')} p) q), {name}_c AS (SELECT c.*{own} FROM {source} c), "
        walk += f"{name}_0 AS (SELECT /*+ BROADCAST(p, w) */ c.*, p.path, w.*, {init} FROM {name}_c c CROSS JOIN {d.rows(paths, 'path')} p JOIN {name}_d w ON w.drawn = {_DRAWN} WHERE path < paths), "
        walk += "".join(f"{name}_{i} AS (SELECT * EXCEPT ({', '.join(state)}), {after(i)} FROM {name}_{i - 1}), " for i in range(1, last + 1)) + f"{name}_w AS (SELECT * FROM {name}_{last})"
    elif d.name == "spark":
        read = {k: f"a.{k}" for k in state}
        init = ", ".join(f"'{k}', CAST({v} AS DOUBLE)" for k, v in state.items())
        after = ", ".join(f"'{k}', CAST({move[k].format(**read, step='step')} AS DOUBLE)" for k in state)
        out = ", ".join(dict.fromkeys(["run", *keep, "path", "s0", "cost", "horizon"]))
        walk = f"{name}_w AS (SELECT {out}, f.* FROM (SELECT {out}, aggregate(sequence(1, horizon), named_struct({init}), (a, step) -> named_struct({after})) AS f FROM {rows} r) w)"
    else:
        init = ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in state.items())
        after = ", ".join(f"CAST({move[k].format(**{k: k for k in state}, step='(step + 1)')} AS DOUBLE) AS {k}" for k in state)
        own = ", ".join(kept)
        walk = f"{name}_r AS (SELECT {own}, 0 AS step, {init} FROM {rows} r UNION ALL SELECT {own}, step + 1 AS step, {after} FROM {name}_r WHERE step < horizon), {name}_w AS (SELECT * FROM {name}_r WHERE step = horizon)"
    shown = ", ".join(dict.fromkeys(["run", *keep, "s0", "path"]))
    more = ", s0 * (sa + exp(x)) / horizon AS mean, s0 * exp((sg + x) / horizon) AS geometric" if averages else ""
    return f"{walk}, {name} AS (SELECT {shown}{more}, s0 * exp(x) * (1 - cost) - s0 * cost AS s, s0 * exp(least(lo, x)) AS low, s0 * exp(greatest(hi, x)) AS high, exp(least(dd, x - greatest(hi, x))) - 1 AS drawdown FROM {name}_w)"
