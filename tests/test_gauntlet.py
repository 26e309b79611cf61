"""Gates against a plain version, determinism under ties, records that hold under races, sealed models."""

import json
from concurrent.futures import ThreadPoolExecutor
from datetime import date, timedelta
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest

from quantspark.operators import meta_label
from quantspark.plans import gauntlet as ga
from quantspark.sources.records import HoldoutUsed, Records, config_hash

SCHEMA = "variant int, ticker string, t int, d date, side string, sigma double, entry double, net double, label int, p double"


def planted(edge=0.6, seed=3, n=500):
    """Signals of two tickers whose profit follows their chance; variants repeat them with small changes."""
    rng, rows = np.random.default_rng(seed), []
    for ticker in ("A", "B"):
        for i in range(n):
            d = date(2016, 1, 4) + timedelta(days=int(i * 5 + rng.integers(0, 3)))
            p = float(np.clip(rng.normal(0.58, 0.1), 0.05, 0.95))
            net = float((p - 0.5) * edge * 0.2 + rng.normal(0, 0.02))
            for v in range(7):
                rows.append((v, ticker, i, d, "short" if i % 9 == 0 else "long", 0.01, 100.0, net + 0.0001 * v * rng.normal(), int(net > 0), None if i < 40 else p))
    return rows


def sharpe(x):
    x = np.asarray(x, float)
    return np.mean(x) / np.std(x, ddof=1) if len(x) >= 8 and np.std(x, ddof=1) > 1e-9 else np.nan


def multiple(sizer, p, th):
    if sizer == "A4":
        return float(p > th)
    if p <= max(0.5, th - 1e-12):
        return 0.0
    return 2 * NormalDist().cdf((p - 0.5) / np.sqrt(p * (1 - p))) - 1


def weekly(x, sizer, th):
    x = x[x.side == "long"]
    m = x.p.map(lambda p: multiple(sizer, p, th))
    return (x.net * m)[m > 0].groupby(x.week[m > 0]).mean()


def plain(rows, g, trials):
    x = pd.DataFrame(rows, columns=["variant", "ticker", "t", "d", "side", "sigma", "entry", "net", "label", "p"])
    base = x[x.variant == 0].sort_values(["d", "ticker"])
    split = base.d.iloc[int(np.floor(len(base) * (1 - g.holdout)))]
    x["week"] = pd.to_datetime(x.d).dt.to_period("W").dt.start_time
    x = x[x.p.notna()]
    dev, late = x[x.d < split], x[x.d >= split]
    own = weekly(dev[dev.variant == 0], g.sizer, g.threshold)
    sr = sharpe(own)
    weeks = sorted(dev[dev.variant == 0].week.unique())
    m = np.array([weekly(dev[dev.variant == 0], s, t).reindex(weeks).fillna(0).to_numpy() for s, t in g.grid])
    var = np.var([v for v in map(sharpe, m) if np.isfinite(v)])
    nd = NormalDist()
    sr0 = np.sqrt(var) * ((1 - ga.EULER_GAMMA) * nd.inv_cdf(1 - 1 / trials) + ga.EULER_GAMMA * nd.inv_cdf(1 - 1 / (trials * np.e)))
    z = (own - own.mean()) / own.std(ddof=1)
    dsr = nd.cdf((sr - sr0) * np.sqrt(len(own) - 1) / np.sqrt(1 - (z**3).mean() * sr + ((z**4).mean() - 1) / 4 * sr**2))
    blocks, below = np.array_split(np.arange(len(weeks)), g.blocks), []
    for c in combinations(range(g.blocks), g.blocks // 2):
        inside = np.concatenate([blocks[i] for i in c])
        outside = np.setdiff1d(np.arange(len(weeks)), inside)
        a, o = np.round([sharpe(r[inside]) for r in m], 9), np.round([sharpe(r[outside]) for r in m], 9)
        w = int(np.nanargmax(a))
        below.append(np.mean(o[w] >= o[np.isfinite(o)]) < 0.5)
    runs = [sharpe(weekly(dev[dev.variant == 0], g.sizer, g.threshold * k)) for k in (1 - g.bump, 1 + g.bump)]
    runs += [sharpe(weekly(dev[dev.variant == v], g.sizer, g.threshold)) for v in range(1, 7)]
    raw = dev[(dev.variant == 0) & (dev.side == "long")]
    sr_raw = sharpe(raw.net.groupby(raw.week).mean())
    ho = sharpe(weekly(late[late.variant == 0], g.sizer, g.threshold))
    out = {
        "1_costs": (g.cost, True), "2_sharpe": (dsr, sr > 0 and sr > sr0), "3_pbo": (np.mean(below), np.mean(below) < 0.15),
        "4_plateau": (np.nanmin(runs), not (sr > 0 and any(not np.isfinite(r) or r < g.tolerance * sr for r in runs))), "5_beats_raw": (sr - sr_raw, sr > sr_raw), "6_holdout": (ho, ho > 0),
    }
    return {k: (float(v), bool(p)) for k, (v, p) in out.items()}


@pytest.mark.parametrize(("edge", "seed"), [(0.9, 3), (0.0, 4), (-0.4, 5)])
def test_gates_against_a_plain_version(spark, edge, seed):
    rows, g = planted(edge, seed), ga.Gauntlet()
    got = {r.gate: (r.value, r["pass"]) for r in ga.run_gates(spark.createDataFrame(rows, SCHEMA), g, 25).collect()}
    want = plain(rows, g, 25)
    assert set(got) == set(want)
    for k, (v, p) in want.items():
        assert got[k][1] == p and np.isclose(got[k][0], v, atol=2e-6), k
    assert edge <= 0.5 or all(p for _, p in want.values())


def test_equal_settings_tie_whatever_the_partitions(spark):
    rows = [(*r[:9], None if r[9] is None else 0.9 if r[9] > 0.5 else 0.1) for r in planted(0.3)]  # all thresholds choose the same trades
    found = set()
    for parts in (1, 5, 8):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        found.add(tuple((r.gate, r.value, r["pass"]) for r in sorted(ga.run_gates(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(found) == 1
    assert dict((x[0], x[1]) for x in found.pop())["3_pbo"] == round(plain(rows, ga.Gauntlet(), 10)["3_pbo"][0], 6)


def test_few_signals_fail_the_gates(spark):
    rows = [r for r in planted() if r[2] < 45]
    assert not any(r.ready for r in ga.run_gates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert len(ga.run_gates(spark.createDataFrame([], SCHEMA)).collect()) <= 6


def test_trials_add_up_and_the_holdout_opens_once(spark, tmp_path):
    records = Records(spark, str(tmp_path / "r"))
    assert records.trials() == 0
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda i: records.put_once(f"trials/{i}.json", json.dumps({"added": 10})), range(8)))
        assert records.trials() == 80
        assert sorted(pool.map(lambda i: records.put_once("holdout.json", str(i)), range(16)))[-2:] == [False, True]
    with pytest.raises(HoldoutUsed):
        records.open_holdout({"a": 1})
    assert config_hash({"a": 1, "b": [2]}) == config_hash({"b": [2], "a": 1}) != config_hash({"a": 1, "b": [3]})


def test_reports_are_certified(spark, tmp_path):
    records, g = Records(spark, str(tmp_path / "r")), ga.Gauntlet()
    chances = spark.createDataFrame(planted(0.9), SCHEMA)
    report, certificate = ga.run_gauntlet(spark, chances, records, g)
    assert report["trials"] == 10 and not report["ready"] and report["gates"]["6_holdout"]["pass"] is None and not records.valid(certificate)
    report, certificate = ga.run_gauntlet(spark, chances, records, g, holdout=True)
    assert report["trials"] == 20 and report["ready"] and certificate["universe"] == ["A", "B"] and records.valid(certificate)
    with pytest.raises(HoldoutUsed):
        ga.run_gauntlet(spark, chances, records, g, holdout=True)
    assert records.trials() == 20
    assert not records.valid({**certificate, "config": "other"}) and not records.valid(None) and not records.valid({**certificate, "report": "0" * 64})
    (tmp_path / "r" / "reports" / f"{certificate['report']}.json").write_text("{}")
    assert not records.valid(certificate)


@pytest.mark.parametrize("n", [80, 300])
def test_models_are_applied_as_expressions(spark, tmp_path, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] + rng.normal(size=n) > 0).astype(int)
    rows = pd.DataFrame(x, columns=["f0", "f1", "f2"]).assign(ticker="A", t=np.arange(n), label=y)
    rows = pd.concat([rows, rows.assign(ticker="B", label=1)])
    names = ["f0", "f1", "f2"]
    meta_label.final_models(spark.createDataFrame(rows), names).write.parquet(f"{tmp_path}/m")
    models = meta_label.load_models(spark, f"{tmp_path}/m")
    assert [r.ticker for r in models.collect()] == ["A"]  # one class alone gives no model
    new = pd.DataFrame(rng.normal(size=(50, 3)) * 2, columns=names).assign(ticker="A", t=np.arange(50))
    got = meta_label.apply_models(spark.createDataFrame(new), models, names).orderBy("t").toPandas()
    assert np.allclose(got.p, meta_label.calibrated(x, y, new[names].to_numpy()), atol=1e-12)
    assert meta_label.apply_models(spark.createDataFrame(rows[rows.ticker == "B"]), models, names).where("p is not null").count() == 0
    models.withColumn("n", models.n + 1).write.parquet(f"{tmp_path}/changed")
    with pytest.raises(meta_label.ModelChanged):
        meta_label.load_models(spark, f"{tmp_path}/changed")


def test_decisions_state_the_first_reason(spark):
    g = ga.Gauntlet()
    rows = [("A", 1, "long", 100.0, 0.01, 0.7, 150), ("A", 2, "short", 100.0, 0.01, 0.9, 150), ("A", 3, "long", 100.0, 0.01, 0.7, 99), ("A", 4, "long", 100.0, 0.01, None, 150), ("A", 5, "long", 100.0, 0.01, 0.6, 150), ("A", 6, "long", 90_000.0, 0.5, 0.61, 150), ("A", 7, "long", 100.0, 0.0001, 0.99, 150)]
    alerts = spark.createDataFrame(rows, "ticker string, t int, side string, price double, sigma double, p double, n long")
    got = {r.t: r for r in spark.sql(f"WITH alerts AS (SELECT * FROM {{alerts}}), {ga.decisions(ga.SPARK, g, 'true')} {ga._DECIDED}", alerts=alerts).collect()}
    assert got[1].verdict == "TRADE" and got[1].gauntlet_pass and [got[i].verdict for i in range(2, 7)] == ["NO_TRADE"] * 5
    assert [got[i].reason.split()[0] for i in range(2, 7)] == ["short", "insufficient", "no", "chance", "sized"]
    stop = 100 * (1 - 1.5 * 0.01 * np.sqrt(10))
    want = min(100 / (100 - stop) * multiple("B1", 0.7, 0.6), 10)
    assert np.isclose(got[1].stop_price, stop, atol=1e-6) and got[1].shares == int(want) and got[7].capped_by == "position_pct" and got[7].shares == 10
