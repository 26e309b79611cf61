"""Reshuffled drawdowns against random orders of the whole strategy's weekly returns."""

import os

import numpy as np

from quantspark import registry
from quantspark.plans.validation import TRADES
from quantspark.sources.tables import views

SF = os.environ.get("TEST_ORACLE_DIR", "/root/testdata/sf0.01")


def test_all_tickers_are_reshuffled(spark):
    views(spark, SF)
    r = np.array([x.r for x in spark.sql(f"WITH {TRADES} SELECT date_trunc('week', d) AS wk, avg(r) AS r FROM trades GROUP BY 1 ORDER BY 1").collect()])
    rng = np.random.default_rng(13)
    dds = []
    for _ in range(5000):
        eq = np.r_[1, np.cumprod(1 + rng.permutation(r))]
        dds.append((eq / np.maximum.accumulate(eq) - 1).min())
    got = registry.QUERIES["reshuffle_dd"](spark, SF).first()
    error = np.std(dds) / np.sqrt(5000)
    assert abs(got.mean_dd - np.mean(dds)) < 6 * error and abs(got.p05 - np.quantile(dds, 0.05)) < 15 * error
