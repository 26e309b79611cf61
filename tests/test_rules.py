"""The rule engine against a plain loop, and the tactical settings."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quantspark.config import Simulation
from quantspark.operators.rules import apply_rule, outcomes, price_paths, rule_statistics, run_tactical
from quantspark.operators.simulate import simulate
from quantspark.tactical import Rule, Tactical, preset, trend_side

RULES = [
    Rule(), Rule(side="short", stop=0.03), Rule(entry="enter SHORT now", target=0.02, trail=0.015, hold=9), Rule(target=0.03, trail=0.01, hold=7, entry_day=4), Rule(stop=0.0, hold=50),
    Rule(hold=3, reentry=True, max_trades=4), Rule(side="short", hold=4, target=0.02, reentry=True, max_trades=9, entry_day=2), Rule(entry_day=99),
]


def plain(prices, r, cost, signal=None):
    """Trades by looking ahead from each entry."""
    if len(prices) < 2 or any(p is None or not math.isfinite(p) or p <= 0 for p in prices):
        return []
    s, n, out, at = (-1 if r.direction == "short" else 1), len(prices) - 1, [], 0
    while len(out) < r.most:
        e = next((d for d in range(at, n) if (signal(d, prices) if signal else d >= r.entry_day)), None)
        if e is None:
            return out
        for d in range(e + 1, min(e + r.hold, n) + 1):
            p, o = prices[d], prices[e]
            best = (min if s < 0 else max)(prices[e : d + 1])
            if r.stop and s * p <= s * o * (1 - s * r.stop):
                why = "stop_loss"
            elif r.target and s * p >= s * o * (1 + s * r.target):
                why = "take_profit"
            elif r.trail and s * p <= s * best * (1 - s * r.trail):
                why = "trailing_stop"
            elif d == min(e + r.hold, n):
                why = "max_holding"
            else:
                continue
            break
        pnl = p * (1 - cost) - o * (1 + cost) if s > 0 else o * (1 - cost) - p * (1 + cost)
        out.append((len(out), e, d, why, round(pnl, 9)))
        at = d + 1
    return out


@pytest.fixture(scope="module")
def data():
    g = random.Random(4)
    rows = []
    for i in range(40):
        p = [100.0]
        for _ in range(g.choice([1, 5, 20])):
            p.append(p[-1] * math.exp(g.gauss(0, 0.015)))
        rows.append((i, p))
    return [*rows, (40, []), (41, [100.0]), (42, [100.0, None, 101.0]), (43, [100.0, -1.0]), (44, [100.0, math.nan, 1.0]), (45, [100.0, math.inf]), (46, None), (47, [100.0] * 8)]


@pytest.mark.parametrize("rule", RULES, ids=range(len(RULES)))
def test_rules(spark, data, rule):
    df = spark.createDataFrame(data, "path long, prices array<double>")
    got = sorted((r.path, r.trade, r.entry_day, r.exit_day, r.exit_reason, round(r.pnl, 9)) for r in apply_rule(df, rule, 0.001).collect())
    assert got == sorted((i, *t) for i, p in data for t in plain(p or [], rule, 0.001))


def test_entry_signals_and_statistics(spark, data):
    df, rule = spark.createDataFrame(data, "path long, prices array<double>"), Rule(hold=2, reentry=True, max_trades=3)
    fell = lambda day, p: (day > 0) & (F.get(p, day) < F.get(p, day - 1))
    trades = apply_rule(df, rule, 0.0, fell)
    want = {i: plain(p or [], rule, 0.0, lambda d, x: d > 0 and x[d] < x[d - 1]) for i, p in data}
    by = {r.path: r for r in outcomes(df, trades).collect()}
    assert len(by) == len(data)
    for i, ts in want.items():
        assert by[i].n_trades == len(ts) and math.isclose(by[i].pnl, sum(t[4] for t in ts), abs_tol=1e-7) and by[i].exit_reason == (ts[-1][3] if ts else "no_trade")
    s = rule_statistics(outcomes(df, trades)).first()
    assert s.n_paths == len(data) and math.isclose(s.prob_profit + s.prob_loss + s.prob_flat, 1) and s.total_trades == sum(map(len, want.values()))
    assert rule_statistics(outcomes(df.limit(0), trades.limit(0))).first().n_paths == 0


def test_price_paths_end_where_the_simulation_does(spark):
    for model in ("gbm", "heston", "regime"):
        c = Simulation(model=model, paths=20, horizon=6, seed=9)
        ends = {r.path: r.s for r in simulate(spark, c).collect()}
        for r in price_paths(spark, c).collect():
            assert len(r.prices) == 7 and r.prices[0] == 100 and math.isclose(r.prices[-1], ends[r.path], rel_tol=1e-9)


def test_runs_and_settings(spark):
    t = preset("10 days", "x", paths=200, s0=50.0, sigma=0.3)
    trades, stats = run_tactical(spark, t)
    assert stats.first().total_trades == trades.count() == 200
    assert t.rule.hold == 10 and preset("5d").horizon == 5
    for bad in (lambda: preset("7d"), lambda: preset("5", horizon=3), lambda: Tactical(cost=1.0).check(), lambda: Rule(stop=1.0).check(), lambda: Rule(side="up").check(), lambda: Rule(name=" ").check(), lambda: Rule(trail=1.0).check(), lambda: Rule(hold=0).check()):
        with pytest.raises((ValueError, KeyError)):
            bad()
    assert (trend_side("Bullish"), trend_side("down"), trend_side("flat"), trend_side(None)) == ("long", "short", None, None)
    assert Rule(entry="short the rally").direction == "short" and Rule(entry="short", side="long").direction == Rule().direction == "long"
