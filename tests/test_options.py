"""Options and Greeks through the API against closed forms; estimators that would be biased are refused."""

import math
from statistics import NormalDist

import pytest

from quantspark.operators.options import GREEKS, InvalidMethod, Option, greek, method_for, price

N = NormalDist()
S, K, R, V, T = 100.0, 100.0, 0.05, 0.2, 1.0
D1 = (math.log(S / K) + (R + V * V / 2) * T) / (V * math.sqrt(T))
D2 = D1 - V * math.sqrt(T)
CALL = S * N.cdf(D1) - K * math.exp(-R * T) * N.cdf(D2)
SMALL = {"paths": 20_000, "steps": 16, "seed": 5}


def near(row, exact, k=4):
    assert row.std_error > 0 and abs(row.value - exact) < k * row.std_error, (row, exact)


def test_prices(spark):
    near(price(spark, Option(), **SMALL).first(), CALL)
    near(price(spark, Option(call=False), model="merton", **SMALL).first(), CALL - S + K * math.exp(-R * T), 40)
    near(price(spark, Option("digital"), **SMALL).first(), math.exp(-R * T) * N.cdf(D2))
    a, b = (price(spark, Option("barrier", barrier=90.0, knock=k), **SMALL).first().value for k in ("in", "out"))
    assert math.isclose(a + b, price(spark, Option(), **SMALL).first().value, rel_tol=1e-9)
    assert price(spark, Option("asian-geometric"), **SMALL).first().value < price(spark, Option("asian"), **SMALL).first().value < price(spark, Option("lookback"), **SMALL).first().value
    for bad in (Option("swing"), Option("barrier"), Option(strike=0)):
        with pytest.raises(ValueError):
            price(spark, bad)


def test_greeks(spark):
    exact = {"delta": N.cdf(D1), "vega": S * N.pdf(D1) * math.sqrt(T), "gamma": N.pdf(D1) / (S * V * math.sqrt(T))}
    for g in GREEKS:
        near(greek(spark, g, method="lrm", **SMALL).first(), exact[g])
        near(greek(spark, g, method="fd", **SMALL).first(), exact[g], 5)
    for g in ("delta", "vega"):
        near(greek(spark, g, method="pathwise", **SMALL).first(), exact[g])
        a, b = greek(spark, g, "asian", **SMALL).first(), greek(spark, g, "asian", "fd", **SMALL).first()
        assert abs(a.value - b.value) < 4 * (a.std_error + b.std_error)
    common, own = (greek(spark, "delta", method="fd", common=x, **SMALL).first() for x in (True, False))
    assert own.std_error > 5 * common.std_error
    near(greek(spark, "delta", "digital", **SMALL).first(), math.exp(-R * T) * N.pdf(D2) / (S * V * math.sqrt(T)))
    assert 0.4 < greek(spark, "delta", method="fd", model="heston", **SMALL).first().value < 0.9


def test_validity():
    assert (method_for("gamma", "european"), method_for("delta", "asian"), method_for("gamma", "asian"), method_for("vega", "digital")) == ("lrm", "pathwise", "fd", "lrm")
    for bad in (("gamma", "european", "pathwise"), ("delta", "digital", "pathwise"), ("delta", "asian", "lrm")):
        with pytest.raises(InvalidMethod):
            method_for(*bad)
    with pytest.raises(ValueError):
        method_for("theta", "european")
