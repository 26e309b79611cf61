"""Settlement of every order against a plain replay."""

import os
from bisect import bisect_right

from quantspark import registry
from quantspark.sources.tables import BARS, views

SF = os.environ.get("TEST_ORACLE_DIR", "/root/testdata/sf0.01")


def test_every_order_is_settled(spark):
    views(spark, SF)
    bars = {}
    for r in spark.sql(f"WITH {BARS} SELECT ticker, d, close FROM bars ORDER BY ticker, t").collect():
        bars.setdefault(r.ticker, ([], []))[0].append(r.d)
        bars[r.ticker][1].append(r.close)
    want = {}
    for id, ticker, d in spark.sql("SELECT o_orderkey, o_orderpriority, CAST(o_orderdate AS DATE) FROM orders").collect():
        dates, closes = bars[ticker]
        at = bisect_right(dates, d)
        path = closes[at : at + 6]
        k = next((k for k in range(1, len(path)) if path[k] <= 0.98 * path[0]), 5)
        if k < len(path):
            want[id] = (k, round(path[k] / path[0] - 1.001, 7))
    got = {r.id: (r.held, round(r.net, 7)) for r in registry.QUERIES["settle"](spark, SF).collect()}
    assert len(want) > 0.9 * spark.table("orders").count() and got.keys() == want.keys()
    assert all(got[i][0] == k and abs(got[i][1] - net) < 2e-7 for i, (k, net) in want.items())
    last = [want[i][1] for i in sorted(want)[-20:]]
    r = registry.QUERIES["kill_switch"](spark, SF).first()
    assert r.n == len(want) and abs(r.trailing - sum(last) / 20) < 1e-6 and r.killed == (sum(last) < 0)
