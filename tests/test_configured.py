"""Runs whose settings are columns against single runs; alerts applied to settings against a plain version; the comparison's figures."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from quantspark import registry
from quantspark.config import MODELS, Simulation
from quantspark.functions.dialect import SPARK
from quantspark.operators.alerts import apply_alerts
from quantspark.operators.configured import complete, runs
from quantspark.operators.simulate import simulate
from quantspark.plans.configured import COMPARISON, compared
from quantspark.sources.tables import TABLES

SETTINGS = [
    Simulation(model=m, paths=30, horizon=4 + i, mu=0.1 + 0.02 * i, sigma=0.2 + 0.02 * i, seed=i, cost=0.001 * (i % 2), crash=0.1 * (i % 3 == 0), jumps=40.0 + i, t_df=5 + i % 3, antithetic=i % 4 == 0, regimes="crypto" if i % 2 else "stock", xi=0.2 + 0.1 * i, s0=50.0 + i)
    for i, m in enumerate(MODELS)
] + [Simulation(model="heston", paths=7, horizon=9, theta=0.05, v0=0.02, rho=0.3, seed=40), Simulation(model="garch", paths=5, horizon=1, omega=1e-5, seed=41), Simulation(model="block_bootstrap", paths=11, horizon=8, block_length=3, vol_multiplier=1.5, sigma=0.4, seed=42)]


@pytest.mark.parametrize("most_paths", [None, 64])
def test_rows_equal_single_runs(spark, most_paths):
    history = pd.DataFrame({"t": range(60), "r": np.random.default_rng(1).normal(0, 0.01, 60)})
    names = ("s0", "mu", "sigma", "seed", "cost", "crash", "jumps", "t_df", "antithetic", "regimes", "xi", "theta", "v0", "rho", "omega", "block_length", "vol_multiplier")
    rows = [(i, c.model, c.paths, c.horizon, c.s0, c.drift, c.volatility, *(getattr(c, n) for n in names[3:]), (history.r - history.r.mean()).tolist() if "bootstrap" in c.model else None) for i, c in enumerate(SETTINGS)]
    kinds = {"seed": "int", "t_df": "int", "antithetic": "boolean", "regimes": "string", "block_length": "int"}
    schema = "run int, model string, paths int, horizon int, " + ", ".join(f"{n} {kinds.get(n, 'double')}" for n in names) + ", h array<double>"
    cfg = spark.createDataFrame(rows, schema).repartition(4)
    got = {}
    text = f"WITH cfg AS {complete('{given}', names, history=True)}, {runs(SPARK, 'cfg', history=True, most_paths=most_paths)} SELECT * FROM runs"
    for r in spark.sql(text, given=cfg).collect():
        got.setdefault(r.run, {})[r.path] = (r.s, r.low, r.high, r.drawdown)
    for i, c in enumerate(SETTINGS):
        want = {r.path: (r.s, r.low, r.high, r.drawdown) for r in simulate(spark, c, spark.createDataFrame(history)).collect()}
        assert got[i].keys() == want.keys() and all(np.allclose(got[i][p], want[p], rtol=1e-9, atol=1e-12) for p in want), c.model


@pytest.mark.parametrize("models", [("merton", "heston", "block_bootstrap"), ("gbm", "student_t", "bootstrap", "garch"), ("kou",), ("regime",)])
def test_shared_draws_equal_each_rows_own(spark, models):
    """Draws that are made once, and steps that are written out, change no bit: rows differ in paths, steps, settings and antithetic halves."""
    rows = [(f"{m}{i}", m, 4 + i, 1 + (i + j) % 3, 0.1 + i, 0.3 + 0.1 * i, 40.0 * i, 0.1 * (i == 2), i % 2 == 1, [0.01, -0.02, 0.03]) for j, m in enumerate(models) for i in range(4)]
    given = ("mu", "sigma", "jumps", "crash", "antithetic")
    cfg = spark.createDataFrame(rows, "run string, model string, paths int, horizon int, mu double, sigma double, jumps double, crash double, antithetic boolean, h array<double>")
    text = lambda **more: f"WITH cfg AS {complete('{given}', given, history=True)}, {runs(SPARK, 'cfg', models=models, history=True, averages=True, **more)} SELECT * FROM runs"
    want, got = (sorted(map(tuple, spark.sql(t, given=cfg).collect())) for t in (text(), text(shared=(0, 8, 3))))
    assert len(got) == sum(r[2] for r in rows) and got == want


def test_alerts_share_their_draws(spark, sf):
    """Draws are made for paths, not for alerts, and alerts are not dealt out by their few names."""
    plan = str(registry.QUERIES["alert_runs"](spark, sf)._jdf.queryExecution().optimizedPlan()).splitlines()
    made = [i for i, node in enumerate(plan) if "md5(" in node]
    assert len(made) == 1 and any("Range (0, 8" in node for node in plan[made[0] + 1 : made[0] + 3]) and not any("aggregate(" in node for node in plan)
    assert sum("LeftOuter" in node and "rightHint=(strategy=broadcast)" in node for node in plan) == 2


def test_alert_runs_of_odd_events(spark, tmp_path):
    """Events that repeat or lack values, against the oracle."""
    con, at = duckdb.connect(), "/root/testdata/sf0.001"
    con.execute(f"CREATE TABLE events AS SELECT * FROM (SELECT * FROM '{at}/events.parquet' WHERE event_id < 40 UNION ALL SELECT event_id, ts, user_id + 1, 'error', 99.5, props FROM '{at}/events.parquet' WHERE event_id < 6)")
    odd = [(None, 3, "view", 10.0, '{"k": 5}'), (1001, None, "view", 10.0, '{"k": 5}'), (1002, 3, None, None, None), (1003, 3, "view", math.nan, '{"k": 0}'), (1004, -1, "error", -math.inf, '{"k": -3}'), (-7, 1, "purchase", math.inf, "{}")]
    con.executemany("INSERT INTO events SELECT $1, NULL, $2, $3, $4, $5", odd)
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    for t in set(TABLES) - {"events"}:
        os.symlink(f"{at}/{t}.parquet", tmp_path / f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    want = con.execute(registry.ORACLES["alert_runs"]).fetchall()
    assert len(want) == 45 and sorted(map(tuple, registry.QUERIES["alert_runs"](spark, str(tmp_path)).collect())) == sorted(want)


def test_alerts_change_settings(spark):
    settings = [
        ("plain", "AAA", 50.0, "long", 0.1, 0.3, True, False, False, True, True), ("fixed", "BBB", 60.0, "long", 0.1, 0.3, False, True, True, False, False), ("bare", "CCC", 70.0, None, 0.1, None, True, True, True, True, True),
    ]
    s = spark.createDataFrame(settings, "run string, ticker string, s0 double, side string, mu double, sigma double, align boolean, block_against boolean, scale_volatility boolean, scale_jumps boolean, use_drift boolean")
    rows = [
        (1, "plain", "abc", None, "12.5", "BEARISH", "100", "b"), (2, "fixed", "", "xyz", "-1", "bearish", "0", "b"), (3, "fixed", "UNKNOWN", None, "NaN", "up", "x", "b"), (4, "bare", None, None, None, None, None, None), (5, "none", "q", None, "1", "up", "50", "b"),
        (6, "plain", "ABC", None, "inf", "sideways", "75", "c"), (7, "fixed", None, "b", "1e1", "Short ", "500", "b"), (8, "bare", "c", None, "3", "sell", "50", "b"),
    ]
    a = spark.createDataFrame(rows, "alert int, run string, ticker string, symbol string, close string, direction string, rsi string, bucket string")
    c = spark.createDataFrame([("ABC", "b", 0.07), ("C", "b", -0.2)], "ticker string, bucket string, mu double")
    got = {r.alert: tuple(r)[1:] for r in apply_alerts(a, s, c).collect()}
    assert got[1] == ("ABC", 12.5, "short", True, 0.07, 0.3, 1.5, "calibration")
    assert got[2] == ("XYZ", 60.0, "long", False, 0.1, 0.3 * 0.6, 1.0, "settings") and got[3] == ("BBB", 60.0, "long", True, 0.1, 0.3, 1.0, "settings")
    assert got[4] == ("CCC", 70.0, None, True, 0.0, None, 1.0, "none") and 5 not in got
    assert got[6] == ("ABC", 50.0, "long", True, 0.0, 0.3, 1.25, "none") and got[7] == ("B", 10.0, "long", False, 0.1, 0.3 * 1.4, 1.0, "settings")
    assert got[8] == ("C", 3.0, "short", True, -0.2, None, 1.0, "calibration")
    assert apply_alerts(a.drop("bucket", "symbol"), s).where("source = 'calibration'").count() == 0 and apply_alerts(a.where("false"), s, c).count() == 0


def test_comparison_against_plain_figures(spark):
    rng = np.random.default_rng(6)
    rows = [(t, m, 100.0, float(100 * np.exp(v * z)), 100 * math.exp(-abs(v * z)), -abs(v * float(z))) for t in "XY" for m, v in (("a", 0.1), ("b", 0.12), ("c", 0.5)) for z in rng.standard_normal(400)]
    df = spark.createDataFrame(rows, "ticker string, model string, s0 double, s double, low double, drawdown double")
    got = {(r.ticker, r.model): r for r in spark.sql(f"WITH runs AS (SELECT * FROM {{runs}}), {compared(SPARK)} SELECT * FROM compared", runs=df).collect()}
    assert set(COMPARISON) <= set(next(iter(got.values())).asDict()) and len(COMPARISON) == 22
    x = pd.DataFrame(rows, columns=df.columns)
    for (t, m), g in x.groupby(["ticker", "model"]):
        r, pnl = got[t, m], g.s - 100
        cut = np.quantile(pnl, 0.01)
        loss = -pnl[-pnl > np.quantile(-pnl, 0.95)] - np.quantile(-pnl, 0.95)
        ratio = loss.mean() ** 2 / loss.var()
        xi, beta = 0.5 * (1 - ratio), 0.5 * loss.mean() * (ratio + 1)
        var = np.quantile(-pnl, 0.95) + beta / xi * ((0.01 * 400 / len(loss)) ** -xi - 1)
        assert np.allclose([r.expected_ending_value, r.median_ending_value, r.prob_loss_10, r.var_99, r.es_99, r.evt_var_99, r.evt_es_99], [g.s.mean(), g.s.median(), (g.s < 90).mean(), -cut, -pnl[pnl <= cut].mean(), var, (var + beta - xi * np.quantile(-pnl, 0.95)) / (1 - xi)])
        assert np.isclose(r.sharpe, (g.s / 100 - 1).mean() / (g.s / 100).std())
    assert got["X", "c"].disagreement_rank == 1 and got["X", "c"].most_conservative and sorted(got["Y", m].disagreement_rank for m in "abc") == [1, 2, 3]
