"""Every core plan against its oracle, and recurrences, streams and random numbers against plain versions."""

import math
import os

import duckdb
import numpy as np
import pytest

from quantspark import registry
from quantspark.functions.dialect import DUCK, SPARK
from quantspark.operators import recurrences
from quantspark.sources.tables import TABLES
from quantspark.streaming.dedupe import dedupe, dedupe_stream

SF = os.environ.get("TEST_ORACLE_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def cell(v):
    if v is None or v != v:
        return ""
    if isinstance(v, (float, np.floating)):
        return f"{float(v) + 0.0:.5g}"
    return str(v)[:10] if hasattr(v, "year") else str(v)


def alike(x, y):
    """Cells are equal, or numbers within two units of the sixth digit: sums are made in another order, and then rounded."""
    return all(p == q or number(p) and number(q) and math.isclose(float(p), float(q), rel_tol=2e-5, abs_tol=2e-8) for p, q in zip(x, y, strict=True))


def number(x):
    try:
        return math.isfinite(float(x))
    except ValueError:
        return False


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_oracle(spark, con, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in registry.ORACLES:
        want = con.execute(registry.ORACLES[name]).fetchdf().astype(object)
        assert sorted(got.columns) == sorted(want.columns)
        rows = lambda x: sorted(tuple("" if str(v) == "<NA>" else cell(v) for v in r) for r in x[sorted(got.columns)].itertuples(index=False))
        a, b = rows(got.astype(object)), rows(want)
        assert len(a) == len(b) and [(x, y) for x, y in zip(a, b, strict=True) if not alike(x, y)] == []


#: The published worked example of the relative strength index.
CLOSES = [44.34, 44.09, 44.15, 43.61, 44.33, 44.83, 45.10, 45.42, 45.84, 46.08, 45.89, 46.03, 45.61, 46.28, 46.28, 46.00]


def test_rsi_worked_example():
    x = recurrences.rsi(np.array(CLOSES))
    assert np.isnan(x[:14]).all() and math.isclose(x[14], 70.46, abs_tol=0.1) and math.isclose(x[15], 66.25, abs_tol=0.1)
    assert recurrences.rsi(np.ones(20))[-1] == 50 and recurrences.rsi(np.arange(20.0))[-1] == 100


def test_recurrences_are_causal():
    x = np.exp(np.cumsum(np.random.default_rng(1).normal(0, 0.01, 120)))
    for f in (lambda v: recurrences.ema(v, 9), recurrences.rsi, lambda v: recurrences.ewma_variance(np.diff(np.log(v)))):
        whole, part = f(x), f(x[:80])
        assert np.array_equal(whole[: len(part)], part, equal_nan=True)


def test_normals(spark, con):
    q = "SELECT avg({z}) AS m, var_samp({z}) AS v FROM {r} p"
    a = spark.sql(q.format(z=SPARK.normal(1, "path"), r=SPARK.rows(20000, "path"))).first()
    b = con.execute(q.format(z=DUCK.normal(1, "path"), r=DUCK.rows(20000, "path"))).fetchall()[0]
    assert abs(a.m) < 0.03 and abs(a.v - 1) < 0.04 and np.allclose(tuple(a), b, atol=1e-9)


def test_prices_near_closed_forms(spark):
    exact = {r.ticker: r for r in registry.QUERIES["opt_closed_forms"](spark, SF).collect() if r.s == 100}
    for mc in registry.QUERIES["opt_payoffs"](spark, SF).collect():
        e = exact[mc.ticker]
        assert abs(mc.european - e.bs_call) < 4 * mc.european_se and abs(mc.digital - e.digital) < 4 * mc.digital_se
        assert math.isclose(mc.down_in + mc.down_out, mc.european, abs_tol=1e-5) and mc.geometric <= mc.asian
    lsm = registry.QUERIES["opt_american_lsm"](spark, SF).first()
    assert lsm.price > lsm.european and lsm.price >= 40 * math.exp(-0.006) - 36 - 2 * lsm.std_error  # what the first date alone is worth
    for g in registry.QUERIES["greeks"](spark, SF).collect():
        e = exact[g.ticker]
        assert abs(g.pw_delta - e.delta) < 4 * g.pw_delta_se and abs(g.lr_gamma - e.gamma) < 4 * g.lr_gamma_se and abs(g.pw_vega - e.vega) < 4 * g.pw_vega_se


def test_fifty_exercise_dates(spark):
    """The published put: 36 against 40, 6 %, volatility 20 %, one year, fifty dates; 4.472 by the method's authors, 4.487 by a lattice."""
    from quantspark.operators.early_exercise import least_squares_put

    r = least_squares_put(spark, s0=36.0, strike=40.0, rate=0.06, sigma=0.2, years=1.0, dates=50, paths=6000)
    found = r.first()
    assert abs(found.price - 4.4867) < 3 * found.std_error + 0.03 and found.std_error < 0.05 and abs(found.european - 3.844) < 0.12


def test_directional_index():
    x = np.arange(60.0)
    assert np.isnan(recurrences.directional_index(x + 1, x, x + 0.5)[:27]).all() and np.allclose(recurrences.directional_index(x + 1, x, x + 0.5)[27:], 100)
    assert np.allclose(recurrences.directional_index(np.ones(40), np.ones(40), np.ones(40))[27:], 0) and np.isnan(recurrences.directional_index(x[:27], x[:27], x[:27])).all()


def test_dedupe_compares_with_the_stored_alert(spark, tmp_path):
    rows = [(i, f"2026-01-05 10:{s // 60:02d}:{s % 60:02d}", "A", "bullish", "mid") for i, s in enumerate((0, 100, 650, 700, 1300))]
    rows.append((9, "2026-01-05 10:02:00", "B", "bullish", "mid"))
    df = spark.createDataFrame(rows, "event_id long, t string, ticker string, trend string, tercile string").selectExpr("event_id", "to_timestamp(t) AS ts", "ticker", "trend", "tercile")
    want = {0: False, 1: True, 2: False, 3: True, 4: False, 9: False}
    assert {r.event_id: r.duplicate for r in dedupe(df).collect()} == want
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = dedupe_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("dups").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.event_id: r.duplicate for r in spark.table("dups").collect()} == want
