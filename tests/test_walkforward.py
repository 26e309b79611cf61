"""Walk-forward trades and barrier labels step by step, in plain Python."""

import math
import statistics

import pytest

from quantspark import registry
from quantspark.sources.tables import BARS, views

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def series(spark):
    views(spark, SF)
    rows = spark.sql(f"WITH {BARS} SELECT ticker, t, open, high, low, close FROM ohlc ORDER BY ticker, t").collect()
    out = {}
    for r in rows:
        out.setdefault(r.ticker, []).append(r)
    return out


def smooth(x, alpha, length):
    y = [None] * len(x)
    if len(x) >= length:
        y[length - 1] = sum(x[:length]) / length
        for i in range(length, len(x)):
            y[i] = y[i - 1] + alpha * (x[i] - y[i - 1])
    return y


def features(close):
    """(trend, bucket) of each bar, None before they are defined."""
    fast, slow = smooth(close, 2 / 10, 9), smooth(close, 2 / 22, 21)
    move = [b - a for a, b in zip(close, close[1:], strict=False)]
    up, down = (smooth(m, 1 / 14, 14) for m in ([max(m, 0) for m in move], [max(-m, 0) for m in move]))
    for i in range(len(close)):
        if slow[i] is None or up[i - 1] is None:
            yield None, None
            continue
        u, d = up[i - 1], down[i - 1]
        rsi = (100 if u > 0 else 50) if d == 0 else 100 - 100 / (1 + u / d)
        trend = 1 if fast[i] > slow[i] else -1
        yield trend, (trend, "low" if rsi < 40 else "high" if rsi > 60 else "mid")


def shrunk(x, lags=4):
    n = len(x)
    if n < 3:
        return 0.0
    m = sum(x) / n
    e = [v - m for v in x]
    lrv = sum(v * v for v in e) / n + sum(2 * (1 - k / (lags + 1)) * sum(a * b for a, b in zip(e, e[k:], strict=False)) / n for k in range(1, lags + 1))
    lrv = max(lrv, 1e-18)
    if abs(m / math.sqrt(lrv / n)) < 1:
        return 0.0
    n_eff = min(n, max(1, n * statistics.variance(x) / lrv))
    return m * n_eff / (n_eff + 60)


def test_trades(spark, series):
    want = {}
    for ticker, bars in series.items():
        close, opens = [b.close for b in bars], [b.open for b in bars]
        f = list(features(close))
        for t in range(312, len(close) - 6, 5):
            side, bucket = f[t]
            past = [math.log(close[i + 5] / close[i]) for i in range(t - 5) if f[i][1] == bucket]
            momentum = math.log(close[t - 21] / close[t - 252])
            if side * shrunk(past) > 0 and side * momentum > 0:
                want[ticker, t + 1] = (side, side * (opens[t + 6] / opens[t + 1] - 1), side * (close[t + 5] / close[t] - 1))
    got = {(r.ticker, r.t): (r.side, r.r, r.r_close) for r in registry.QUERIES["wf_trades"](spark, SF).collect()}
    assert got.keys() == want.keys() and len(got) > 50
    for k, (side, r, rc) in want.items():
        assert got[k][0] == side and math.isclose(got[k][1], r, abs_tol=2e-8) and math.isclose(got[k][2], rc, abs_tol=2e-8)


def test_labels(spark, series):
    want = {}
    for ticker, bars in series.items():
        close = [b.close for b in bars]
        trend = [x for x, _ in features(close)]
        slow = [i for i in range(20, len(close))]
        fast9, slow21 = smooth(close, 2 / 10, 9), smooth(close, 2 / 22, 21)
        side = {i: 1 if fast9[i] > slow21[i] else -1 for i in slow}
        assert all(trend[i] in (None, side[i]) for i in slow)
        r = [math.log(b / a) for a, b in zip(close, close[1:], strict=False)]
        for t in range(60, len(close) - 1):
            if side[t] == side[t - 1]:
                continue
            w, e, last = 1.5 * math.sqrt(10) * statistics.pstdev(r[t - 60 : t]), bars[t + 1].open, min(t + 11, len(close) - 1)
            for i in range(t + 1, last + 1):
                low, high = bars[i].low, bars[i].high
                stop, goal = e * (1 - side[t] * w), e * (1 + side[t] * w)
                if low <= stop if side[t] == 1 else high >= stop:
                    x, why = stop, "stop"
                elif high >= goal if side[t] == 1 else low <= goal:
                    x, why = goal, "target"
                elif i == last:
                    x, why = close[i], "time"
                else:
                    continue
                want[ticker, t + 1] = (i + 1, why, (1 + side[t] * (x / e - 1)) * 0.9995**2 - 1)
                break
    got = {(r.ticker, r.t): (r.exit_t, r.exit_reason, r.net) for r in registry.QUERIES["triple_barrier"](spark, SF).collect()}
    assert got.keys() == want.keys()
    for k, (t, why, net) in want.items():
        assert got[k][:2] == (t, why) and math.isclose(got[k][2], net, abs_tol=2e-8)
