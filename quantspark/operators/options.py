"""Options under any model with a risk-neutral drift, and Greeks by estimators that are valid for the payoff.

A path is one row: price, extremes and averages are a fold within it. Both dialects share the text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from ..config import Simulation
from ..functions.dialect import SPARK, Dialect
from .simulate import dynamics, number

# Kinds, models, and which estimator is unbiased for which payoff.
KINDS, MODELS = ("european", "asian", "asian-geometric", "barrier", "lookback", "digital"), ("gbm", "heston", "merton", "regime")
GREEKS, METHODS, PAYOFFS = ("delta", "vega", "gamma"), ("pathwise", "lrm", "fd"), ("european", "digital", "asian")
PATHWISE = {(g, p) for g in ("delta", "vega") for p in ("european", "asian")}
LIKELIHOOD = {(g, p) for g in GREEKS for p in ("european", "digital")}


class InvalidMethod(ValueError):
    """The estimator would be biased for this payoff."""


@dataclass(frozen=True)
class Option:
    kind: str = "european"
    strike: float = 100.0
    call: bool = True
    barrier: float | None = None
    direction: str = "down"
    knock: str = "out"
    floating: bool = False
    cash: float = 1.0

    def check(self) -> Option:
        if self.kind not in KINDS:
            raise ValueError(f"kind must be one of {', '.join(KINDS)}")
        if self.strike <= 0:
            raise ValueError("strike must be positive")
        if self.kind == "barrier" and (self.barrier is None or self.barrier <= 0 or self.direction not in ("down", "up") or self.knock not in ("out", "in")):
            raise ValueError("a barrier option needs a positive barrier, a direction (down, up) and a knock (out, in)")
        return self

    def payoff(self) -> str:
        """Of the columns s, low, high, mean and geometric; extremes include the start, averages do not."""
        self.check()
        k, sign = number(self.strike), 1 if self.call else -1
        plain = lambda x: f"greatest({sign} * ({x} - {k}), 0E0)"
        if self.kind == "lookback":
            return ("s - low" if self.call else "high - s") if self.floating else plain("high" if self.call else "low")
        if self.kind == "digital":
            return f"(CASE WHEN {sign} * (s - {k}) > 0 THEN {number(self.cash)} ELSE 0E0 END)"
        if self.kind == "barrier":
            hit = f"low <= {number(self.barrier)}" if self.direction == "down" else f"high >= {number(self.barrier)}"
            first, then = (plain("s"), "0E0") if self.knock == "in" else ("0E0", plain("s"))
            return f"(CASE WHEN {hit} THEN {first} ELSE {then} END)"
        return plain({"european": "s", "asian": "mean", "asian-geometric": "geometric"}[self.kind])


def paths_relation(d: Dialect, c: Simulation, name: str) -> str:
    """Relation ``name(path, s, low, high, mean, geometric, tilt)``; tilt is the mean of S_t (ln(S_t / s0) - (mu + sigma^2 / 2) t) / sigma."""
    c.check()
    state, move = dynamics(d, c)
    slope = number((c.drift + c.volatility**2 / 2) * c.dt)
    vol = number(c.volatility or 1.0)
    tilted = lambda x, t: f"exp({x}) * ({x} - {slope} * {t}) / {vol}"
    state |= {"sa": "0", "sg": "0", "sv": "0"}  # these trail the price by a step, as the extremes do
    late = lambda x: f"(CASE WHEN {{step}} > 1 THEN {x} ELSE 0E0 END)"
    move |= {"sa": f"{{sa}} + {late('exp({x})')}", "sg": "{sg} + {x}", "sv": f"{{sv}} + {late(tilted('{x}', '({step} - 1)'))}"}
    n, s0 = number(c.horizon), number(c.s0)
    out = f"SELECT path, {s0} * exp(x) AS s, {s0} * exp(least(lo, x)) AS low, {s0} * exp(greatest(hi, x)) AS high, {s0} * (sa + exp(x)) / {n} AS mean, {s0} * exp((sg + x) / {n}) AS geometric, {s0} * (sv + {tilted('x', n)}) / {n} AS tilt FROM {name}_w"
    return f"{d.fold(name + '_w', d.rows(c.paths, 'path'), state, move, c.horizon, [])}, {name} AS ({out})"


def setting(model: str, s0: float, rate: float, sigma: float, maturity: float, steps: int, paths: int, seed: int, **more) -> Simulation:
    """Drift is the rate. A regime's factors scale it, so that model is only about risk-neutral."""
    if model not in MODELS:
        raise ValueError(f"model must be one of {', '.join(MODELS)}")
    return Simulation(model=model, s0=s0, mu=rate, sigma=sigma, dt=maturity / steps, horizon=steps, paths=paths, seed=seed, **more)


def _mean(x: str, source: str) -> str:
    return f"SELECT avg(x) AS value, stddev_samp(x) / sqrt(CAST(count(*) AS DOUBLE)) AS std_error, count(*) AS n FROM (SELECT {x} AS x FROM {source}) q"


def price(spark: SparkSession, option: Option, *, model: str = "gbm", s0: float = 100.0, rate: float = 0.05, sigma: float = 0.2, maturity: float = 1.0, steps: int = 252, paths: int = 100_000, seed: int = 42, **more) -> DataFrame:
    """``(value, std_error, n)``: the discounted mean payoff."""
    c = setting(model, s0, rate, sigma, maturity, steps, paths, seed, **more)
    return spark.sql(f"WITH {paths_relation(SPARK, c, 'sim')} {_mean(f'{number(math.exp(-rate * maturity))} * {option.payoff()}', 'sim')}")


def method_for(greek: str, payoff: str, method: str = "auto") -> str:
    """The first valid estimator of pathwise, likelihood ratio and finite differences; raises InvalidMethod for a biased one."""
    if greek not in GREEKS or payoff not in PAYOFFS or method not in ("auto", *METHODS):
        raise ValueError(f"unknown greek, payoff or method: {greek}, {payoff}, {method}")
    if method == "auto":
        return "pathwise" if (greek, payoff) in PATHWISE else "lrm" if (greek, payoff) in LIKELIHOOD else "fd"
    if method == "pathwise" and (greek, payoff) not in PATHWISE:
        raise InvalidMethod(f"pathwise {greek} of {payoff}: the payoff or its slope jumps; use lrm or fd")
    if method == "lrm" and (greek, payoff) not in LIKELIHOOD:
        raise InvalidMethod(f"likelihood ratios need a payoff of the last price, not {payoff}; use pathwise or fd")
    return method


def greek(spark: SparkSession, greek: str, payoff: str = "european", method: str = "auto", *, strike: float = 100.0, call: bool = True, cash: float = 1.0, bump: float = 0.01, common: bool = True, model: str = "gbm", s0: float = 100.0, rate: float = 0.05, sigma: float = 0.2, maturity: float = 1.0, steps: int = 64, paths: int = 100_000, seed: int = 42, **more) -> DataFrame:
    """``(value, std_error, n)``. Finite differences take any model; their legs share draws, or each has its own (``common=False``)."""
    chosen = method_for(greek, payoff, method)
    if chosen != "fd" and model != "gbm":
        raise InvalidMethod("pathwise and likelihood-ratio estimators are those of geometric Brownian motion; use fd")
    o, disc = Option(payoff, strike, call, cash=cash), number(math.exp(-rate * maturity))
    c = setting(model, s0, rate, sigma, maturity, steps, paths, seed, **more)
    if chosen == "pathwise":
        value, sign = ("s" if payoff == "european" else "mean"), 1 if call else -1
        last = f"s * (ln(s / {number(s0)}) - {number((rate + sigma**2 / 2) * maturity)}) / {number(sigma)}"
        slope = f"{value} / {number(s0)}" if greek == "delta" else last if payoff == "european" else "tilt"
        x = f"(CASE WHEN {sign} * ({value} - {number(strike)}) > 0 THEN {sign} * {disc} * {slope} ELSE 0E0 END)"
        return spark.sql(f"WITH {paths_relation(SPARK, c, 'sim')} {_mean(x, 'sim')}")
    if chosen == "lrm":
        root = sigma * math.sqrt(maturity)
        z = f"((ln(s / {number(s0)}) - {number((rate - sigma**2 / 2) * maturity)}) / {number(root)})"
        weight = {
            "delta": f"{z} / {number(s0 * root)}", "vega": f"(({z} * {z} - 1) / {number(sigma)} - {z} * {number(math.sqrt(maturity))})", "gamma": f"(({z} * {z} - 1) / {number((s0 * root) ** 2)} - {z} / {number(s0 * s0 * root)})",
        }[greek]
        return spark.sql(f"WITH {paths_relation(SPARK, c, 'sim')} {_mean(f'{disc} * {o.payoff()} * {weight}', 'sim')}")
    step = bump * (sigma if greek == "vega" else s0)
    moved = lambda k, i: replace(c, seed=seed if common else seed + 101 * i, **({"sigma": sigma + k * step} if greek == "vega" else {"s0": s0 + k * step}))
    weights = {1: 1 / step**2, 0: -2 / step**2, -1: 1 / step**2} if greek == "gamma" else {1: 0.5 / step, -1: -0.5 / step}
    legs = ", ".join(paths_relation(SPARK, moved(k, i), f"leg{i}") for i, k in enumerate(weights))
    arms = " UNION ALL ".join(f"SELECT path, {i} AS leg, {number(w)} * {disc} * {o.payoff()} AS x FROM leg{i}" for i, w in enumerate(weights.values()))
    if common:
        return spark.sql(f"WITH {legs} {_mean('x', f'(SELECT path, sum(x) AS x FROM ({arms}) a GROUP BY path) b')}")
    return spark.sql(f"WITH {legs} SELECT sum(m) AS value, sqrt(sum(v / n)) AS std_error, max(n) AS n FROM (SELECT leg, avg(x) AS m, var_samp(x) AS v, count(*) AS n FROM ({arms}) a GROUP BY leg) b")
