"""Decision plans against plain versions and what must hold of them."""

import os

import duckdb

from quantspark import registry

SF = os.environ.get("TEST_ORACLE_DIR", "/root/testdata/sf0.01")


def rows(spark, name, sf=SF):
    return registry.QUERIES[name](spark, sf).collect()


def test_reversal_trades_do_not_overlap(spark):
    by = {}
    for r in rows(spark, "reversal_trades"):
        by.setdefault(r.ticker, []).append(r.t)
    assert by
    for ts in by.values():
        ts.sort()
        assert all(b - a >= 5 for a, b in zip(ts, ts[1:]))


def test_levels_match_in_order(spark):
    from quantspark.functions.dialect import DUCK
    from quantspark.plans.decisions import _charts

    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{SF}/part.parquet')")
    true, read = {}, {}
    for c, _, px in con.execute(f"WITH {_charts(DUCK)} SELECT chart, k, px FROM lv ORDER BY chart, k").fetchall():
        true.setdefault(c, []).append(px)
    for c, _, rp in con.execute(f"WITH {_charts(DUCK)} SELECT chart, w, rp FROM rd ORDER BY chart, w").fetchall():
        read.setdefault(c, []).append(rp)
    want = {}
    for c, p in read.items():
        free = list(p)
        want[c] = 0
        for t in true[c]:
            hit = next((i for i, x in enumerate(free) if abs(t - x) / t <= 0.01), None)
            if hit is not None:
                free.pop(hit)
                want[c] += 1
    assert {r.chart: r.hits for r in rows(spark, "vision_match")} == want


def test_gates_and_stress(spark):
    gates = {r.gate: r for r in rows(spark, "gauntlet_gates")}
    assert len(gates) == 6 and all(r.ready == all(g["pass"] for g in gates.values()) for r in gates.values())
    for ticker in ("1-URGENT", "5-LOW"):
        runs = {r.scenario: r for r in rows(spark, "stress_suite") if r.ticker == ticker}
        worst = min(runs.values(), key=lambda r: r.expected_value)
        assert len(runs) == 7 and worst.worst and sum(r.worst for r in runs.values()) == 1
        assert runs["One-day crash -20%"].expected_value < runs["One-day crash -10%"].expected_value < runs["Half historical drift"].expected_value


def test_sweep_agrees_with_the_walk_forward_trades(spark):
    """At five bars the sweep's clock gives the trades of the range frames, with the same returns."""
    from quantspark.plans.decisions import _sweep
    from quantspark.plans.signals import FEATURES
    from quantspark.plans.validation import TRADES
    from quantspark.sources.tables import views

    views(spark, SF)
    clock = spark.sql(f"WITH {FEATURES}, {_sweep((4, 5, 6))} SELECT ticker, t, side, round(r, 9) FROM swept WHERE taken AND h = 5").collect()
    frames = spark.sql(f"WITH {TRADES} SELECT ticker, t, side, round(r, 9) FROM trades").collect()
    assert clock and sorted(map(tuple, clock)) == sorted(map(tuple, frames))
