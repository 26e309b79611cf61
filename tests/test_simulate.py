"""The configured simulator, quasi-random points, fits, meta-labels and sinks against plain versions."""

import json
import math
from collections import Counter

import duckdb
import numpy as np
import pytest

from quantspark.config import JUMP_PRESETS, MODELS, Simulation, preset
from quantspark.functions.dialect import DUCK, SPARK
from quantspark.operators import garch, meta_label
from quantspark.operators.simulate import simulate, summarize
from quantspark.plans.quasi import bridge_weights, direction_numbers
from quantspark.sources import reports


@pytest.mark.parametrize("bad", [{"model": "none"}, {"paths": 0}, {"s0": 0}, {"sigma": -1}, {"cost": 1.0}, {"t_df": 2}, {"rho": 1.5}, {"alpha": 0.3, "beta": 0.7}, {"eta_up": 1.0}, {"ruin": 1.0}, {"crash": 1.0}, {"vol_multiplier": 0}, {"haircut": 1.1}, {"drift_mode": "x"}])
def test_checks(bad):
    with pytest.raises(ValueError):
        Simulation(**bad).check()


def test_presets():
    assert preset("Preview").paths == 10_000 and preset("Custom", 5_000, "crypto").jumps == JUMP_PRESETS["crypto"][0]
    for wrong in ({"mode": "Custom"}, {"mode": "Custom", "paths": 999}, {"mode": "other"}, {"mode": "Preview", "unknown": 1}):
        with pytest.raises(ValueError):
            preset(**wrong)
    c = Simulation(mu=0.1, sigma=0.2, drift_mode="half", haircut=0.4, vol_multiplier=1.5)
    assert math.isclose(c.drift, 0.03) and math.isclose(c.volatility, 0.3)
    assert Simulation(drift_mode="manual", manual_drift=-0.2).drift == -0.2


@pytest.mark.parametrize("model", MODELS)
def test_models_grow_at_the_drift(spark, model):
    c = Simulation(model=model, paths=4000, horizon=20, mu=0.3, sigma=0.2, seed=5, antithetic=True)
    r = spark.range(500).selectExpr("id AS t", "0.0126 * sin(id * 12.9898) * sqrt(2D) + 0.01 AS r")
    rows = simulate(spark, c, r).toPandas()
    assert len(rows) == 4000 and (rows.low <= rows.s + 1e-9).all() and (rows.high >= rows.s - 1e-9).all() and (rows.drawdown <= 0).all()
    if model != "regime":  # regimes change the drift
        assert abs(rows.s.mean() - 100 * math.exp(0.3 * 20 / 252)) < 4 * rows.s.std() / math.sqrt(4000) + 0.15
    out = summarize(simulate(spark, c, r), c).first()
    assert out.n == 4000 and math.isclose(out["mean"], rows.s.mean(), rel_tol=1e-9) and math.isclose(out.p05, np.percentile(rows.s, 5), rel_tol=1e-9)
    loss = (100 - rows.s) / 100
    assert math.isclose(out.es_95, loss[loss >= np.percentile(loss, 95)].mean(), rel_tol=1e-9) and out.es_95 >= out.var_95


def test_antithetic_paths_are_mirrored(spark):
    s = simulate(spark, Simulation(paths=100, horizon=5, seed=1, antithetic=True)).orderBy("path").toPandas().s.to_numpy()
    assert np.allclose(np.log(s[:50] / 100) + np.log(s[50:] / 100), 2 * (0.08 - 0.02) * 5 / 252)


def test_crash_and_missing_history(spark):
    s = simulate(spark, Simulation(paths=10, horizon=3, sigma=0.0, mu=0.0, crash=0.2)).toPandas()
    assert np.allclose(s.s, 80) and np.allclose(s.drawdown, -0.2)
    with pytest.raises(ValueError):
        simulate(spark, Simulation(model="bootstrap", paths=10))


def test_sobol_points_are_balanced():
    for k in range(8):
        v = direction_numbers(k, 10)
        x = [0] * 1024
        for i in range(1024):
            for b in range(10):
                x[i] ^= v[b] if i >> b & 1 else 0
        assert sorted(p >> 22 for p in x) == list(range(1024))  # one point in each of 1024 cells


def test_bridge_is_brownian_motion():
    for n in (1, 2, 7, 8):
        w = np.array(bridge_weights(n))
        t = np.arange(1, n + 1) / n
        assert np.allclose(w @ w.T, np.minimum.outer(t, t))


def test_inverse_normal(spark):
    q = "SELECT {e} AS z FROM (SELECT 0.001E0 AS u UNION ALL SELECT 0.3E0 UNION ALL SELECT 0.975E0 UNION ALL SELECT 0.9999E0) t ORDER BY u"
    want = [-3.090232306, -0.524400513, 1.959963985, 3.719016485]
    assert np.allclose([r.z for r in spark.sql(q.format(e=SPARK.ppf("u"))).collect()], want, atol=1e-7)
    assert np.allclose([r[0] for r in duckdb.sql(q.format(e=DUCK.ppf("u"))).fetchall()], want, atol=1e-7)


def test_garch_fit_recovers_parameters(spark):
    rng, v, r = np.random.default_rng(3), 1e-4, []
    for z in rng.normal(size=6000):
        r.append(math.sqrt(v) * z)
        v = 4e-6 + 0.1 * r[-1] ** 2 + 0.86 * v
    omega, alpha, beta, ll, how = garch.fit(np.array(r))
    assert how == "mle" and abs(alpha - 0.1) < 0.03 and abs(beta - 0.86) < 0.04 and abs(omega / (1 - alpha - beta) - 1e-4) < 3e-5
    x = np.array(r) - np.mean(r)
    assert ll >= garch.log_likelihood(x, *(np.array([p]) for p in (4e-6, 0.1, 0.86)))[0] - 0.5
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(r[:200])] + [("b", 0, 0.1), ("b", 1, None)], "ticker string, t int, r double")
    assert {q.ticker: (q.n, q.method) for q in garch.garch_parameters(df).collect()} == {"a": (200, "mle"), "b": (1, "fallback")}


def test_meta_labels_find_a_planted_edge(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 2))
    y = (rng.uniform(size=500) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    p, fold = meta_label.walk_forward(x, y, np.arange(500) * 5)
    seen = fold >= 0  # the embargo leaves the first fold too few rows
    assert seen[133:].all() and not seen[:133].any() and meta_label.auc(y[seen], p[seen]) > 0.75
    noise, _ = meta_label.walk_forward(x, rng.integers(0, 2, 500), np.arange(500) * 5)
    assert abs(meta_label.auc(rng.integers(0, 2, 367), noise[133:]) - 0.5) < 0.1
    changed = y.copy()
    changed[400:] = 1 - changed[400:]  # labels of the last folds do not reach earlier ones
    q, _ = meta_label.walk_forward(x, changed, np.arange(500) * 5)
    assert np.array_equal(p[:350], q[:350], equal_nan=True)
    df = spark.createDataFrame([("a", int(i), int(y[i]), float(x[i, 0]), float(x[i, 1]) if i else None) for i in range(500)], "ticker string, t int, label int, u double, v double")
    assert Counter(r.ticker for r in meta_label.meta_labels(df, ["u", "v"]).collect()) == {"a": 366}


def test_isotonic():
    at, fit = meta_label.isotonic(np.array([1.0, 2, 3, 4, 4]), np.array([0, 1, 0, 1, 1]))
    assert at.tolist() == [1, 2, 3, 4] and fit.tolist() == [0, 0.5, 0.5, 1]


def test_reports(spark, tmp_path):
    one = spark.createDataFrame([(2, 1.5, None, "x")], "n long, mean double, none double, name string")
    assert {r.metric: r.value for r in reports.metric_rows(one).collect()} == {"n": 2.0, "mean": 1.5, "none": None}
    reports.write_report(one, f"{tmp_path}/r")
    text = lambda kind: "".join(p.read_text() for p in (tmp_path / "r" / kind).glob("part*"))
    assert json.loads(text("json"))["mean"] == 1.5 and "mean,1.5" in text("csv") and "| mean | 1.5 |" in text("md")
    m = reports.matrix(spark.createDataFrame([("a", "a", 1.0), ("a", "b", 0.5), ("b", "a", 0.5), ("b", "b", 1.0)], "i string, j string, v double"), "i", "j", "v")
    assert m.columns == ["i", "a", "b"] and [tuple(r) for r in m.collect()] == [("a", 1.0, 0.5), ("b", 0.5, 1.0)]
    assert json.loads(reports.describe(Simulation()))["model"] == "gbm"


def test_logs(spark, tmp_path):
    log, schema = f"{tmp_path}/log", "id long, verdict string"
    reports.append_log(spark.createDataFrame([(1, "buy"), (2, "wait")], schema), log)
    spark.createDataFrame([("",), ("{broken",), ("[1]",), ("7",), ('{"id": 3, "verdict": "sell"}',)], "value string").write.mode("append").text(log)
    rows = reports.read_log(spark, log, schema)
    assert sorted(tuple(r) for r in rows.collect()) == [(1, "buy"), (2, "wait"), (3, "sell")]
    new = reports.rewrite_log(rows.where("id > 1"), log)
    assert reports.read_log(spark, new, schema).count() == 2 and reports.read_log(spark, log, schema).count() == 3
