"""The latest view in versions, sketches of streams, message signatures, correlated portfolios."""

import hmac
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantspark.functions.authentication import hmac_sha256, secret_known, signed
from quantspark.operators import correlated
from quantspark.streaming import quantiles
from quantspark.streaming.latest import LatestView

ALERT = "event_id long, ticker string, ts long, trend string"


def test_latest_view_in_versions(spark, tmp_path):
    view = LatestView(spark, f"{tmp_path}/s", buckets=8)
    batch = lambda *rows: spark.createDataFrame(rows, ALERT)
    assert view.read() is None
    assert view.update(batch((1, "A", 10, "bullish"), (2, "B", 5, "bearish"), (9, None, 5, "bearish")), 0)
    old = view.read()
    assert view.update(batch((4, "A", 12, "bearish"), (3, "A", 12, "neutral"), (5, "B", 1, "neutral")), 1)
    now = lambda df: {r.ticker: r.event_id for r in df.collect()}
    assert now(view.read()) == {"A": 4, "B": 2} and now(old) == now(view.read(0)) == {"A": 1, "B": 2}  # a reader keeps its version
    assert view.history().count() == 5
    assert not view.update(batch((7, "A", 99, "bullish")), 1) and now(view.read()) == {"A": 4, "B": 2}  # a replay
    before = set((tmp_path / "s" / "versions").iterdir())
    (tmp_path / "s" / "versions" / "2").mkdir()
    (tmp_path / "s" / "versions" / "2" / "half").write_text("broken")  # a writer that died before its manifest
    assert now(view.read()) == {"A": 4, "B": 2}
    assert view.update(batch((6, "C", 9, "bullish")), 2) and now(view.read()) == {"A": 4, "B": 2, "C": 6}
    places = json.loads((tmp_path / "s" / "manifests" / f"{2:012d}.json").read_text())["places"]
    assert len(before) == 2 and sum(v == 2 for v in places.values()) == 1  # the batch wrote its own bucket only


def test_latest_view_follows_a_stream(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(10 * i + j, f"T{j}", i, "bullish") for j in range(5)], ALERT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    view = LatestView(spark, f"{tmp_path}/s")
    stream = spark.readStream.schema(ALERT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    view.follow(stream, f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(180)
    assert {r.ticker: r.event_id for r in view.read().collect()} == {f"T{j}": 20 + j for j in range(5)} and len(view.versions()) == 3


def test_sketches_of_batches_and_streams(spark, tmp_path):
    """Rank errors on all event values stay within 1.7 / SIZE, and merging parts keeps them."""
    events = spark.read.parquet("/root/testdata/sf0.1/events.parquet").select("event_type", "value", (F.col("event_id") % 7).alias("part"))
    whole = {r.event_type: r for r in quantiles.composite_risk(quantiles.sketches(events, "value", "event_type"), "event_type").collect()}
    merged = {r.event_type: r for r in quantiles.composite_risk(quantiles.merge(quantiles.sketches(events, "value", "event_type", "part"), "event_type"), "event_type").collect()}
    events.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = quantiles.sketches(stream, "value", "event_type").writeStream.format("memory").queryName("sketched").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(180)
    streamed = {r.event_type: r for r in quantiles.composite_risk(spark.table("sketched"), "event_type").collect()}
    rows = events.toPandas()
    assert set(whole) == set(merged) == set(streamed) == set(rows.event_type)
    for kind, g in rows.groupby("event_type"):
        x = np.sort(g.value.to_numpy())
        for found in (whole[kind], merged[kind], streamed[kind]):
            assert found.n == len(x) and np.isclose(found["mean"], x.mean()) and np.isclose(found.sd, x.std(ddof=1)) and (found.least, found.most) == (x[0], x[-1])
            for value, p in ((found["median"], 0.5), (-found["var"], 0.05)):
                assert abs(np.searchsorted(x, value) / len(x) - p) <= 1.7 / quantiles.SIZE + 1 / len(x)
            tail = x[x <= np.quantile(x, 0.05)].mean()
            assert abs(-found["es"] - tail) <= 0.15 * abs(tail) + 1e-9
    odd = spark.createDataFrame([("a", None), ("a", float("nan")), ("b", 1.0)], "k string, value double")
    got = {r.k: tuple(r)[1:] for r in quantiles.composite_risk(quantiles.sketches(odd, "value", "k"), "k").collect()}
    assert got["a"][0] == 0 and set(got["a"][1:]) == {None} and got["b"][:3] == (1, 1.0, None)


#: The published test vectors of RFC 4231 (cases 1, 2, 3 and 6).
VECTORS = [
    (b"\x0b" * 20, b"Hi There", "b0344c61d8db38535ca8afceaf0bf12b881dc200c9833da726e9376c2e32cff7"), (b"Jefe", b"what do ya want for nothing?", "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"),
    (b"\xaa" * 20, b"\xdd" * 50, "773ea91e36800e46854db8ebd09181a72959098b3ef8c122d9635514ced565fe"), (b"\xaa" * 131, b"Test Using Larger Than Block-Size Key - Hash Key First", "60e431591ee0b67f0d8a26aacbf5b77f8e0bc6213728c5140546040f0ee37f54"),
]


@pytest.mark.parametrize(("key", "body", "want"), VECTORS)
def test_published_vectors(spark, key, body, want):
    assert spark.createDataFrame([(bytearray(body),)], "b binary").select(hmac_sha256(key, F.col("b"))).first()[0] == want == hmac.new(key, body, "sha256").hexdigest()


def test_signatures_and_secrets(spark):
    own = hmac.new(b"k", "bödy".encode(), "sha256").hexdigest()
    cases = [({"x-signature": own}, True), ({"x-signature": f" SHA256={own.upper()} "}, True), ({"x-hub-signature-256": f"sha256={own}"}, True), ({"x-signature-sha256": "0", "x-signature": own}, False), ({"x-signature-sha256": " ", "x-signature": own}, True), ({}, False), ({"x-signature": own[:-1]}, False), (None, False)]
    df = spark.createDataFrame([(i, "bödy", h) for i, (h, _) in enumerate(cases)], "i int, body string, headers map<string,string>")
    assert [r[0] for r in df.orderBy("i").select(signed("k", F.col("body"), F.col("headers"))).collect()] == [ok for _, ok in cases]
    assert df.select(signed("", F.col("body"), F.col("headers"))).distinct().collect()[0][0]
    doors = [({"secret": "s"}, {}, "", True), ({"token": "s"}, {}, "", True), ({"secret": "x"}, {"x-webhook-secret": " s "}, "", True), ({}, {"authorization": "Bearer s"}, "", True), ({}, {}, '{"token": "s"}', True), ({}, {}, '{"token": 1}', False), ({}, {"authorization": "s"}, "{broken", False), (None, None, None, False)]
    df = spark.createDataFrame([(i, *d[:3]) for i, d in enumerate(doors)], "i int, q map<string,string>, h map<string,string>, b string")
    assert [r[0] for r in df.orderBy("i").select(secret_known("s", F.col("q"), F.col("h"), F.col("b"))).collect()] == [d[3] for d in doors]
    assert not df.select(secret_known("", F.col("q"), F.col("h"), F.col("b"))).first()[0]


def test_factor_and_repair():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(6, 6))
    assert np.allclose(correlated.factor(a @ a.T) @ correlated.factor(a @ a.T).T, a @ a.T)
    b = rng.normal(size=(6, 2))
    low = correlated.factor(b @ b.T)  # rank two of six
    assert np.allclose(low @ low.T, b @ b.T, atol=1e-8) and np.allclose(low, np.tril(low))
    c = np.array([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1]])  # no covariance at all
    low = correlated.factor(c)
    assert np.linalg.eigvalsh(low @ low.T).min() > 0 and np.isfinite(low).all()


def test_portfolio_of_given_returns(spark):
    rng = np.random.default_rng(5)
    common = rng.normal(0, 0.01, 400)
    rows = [(t, i, float(0.0005 * k + common[i] * w + rng.normal(0, 0.005))) for k, (t, w) in enumerate((("A", 1.0), ("B", 1.0), ("C", -1.0))) for i in range(400 - 50 * k)] + [("A", 400, None)]
    returns = spark.createDataFrame(rows, "ticker string, t int, r double")
    cov = {(r.a, r.b): r for r in correlated.shrunk_covariance(returns).collect()}
    last = {t: np.array([r for x, i, r in rows if x == t and r is not None])[-300:] for t in "ABC"}
    want = np.cov([last[t] for t in "ABC"])
    assert len(cov) == 9 and cov["A", "B"].n == 300 and np.isclose(cov["A", "A"].cov, want[0, 0]) and np.isclose(cov["A", "C"].cov, 0.9 * want[0, 2])
    x = correlated.portfolio(spark, returns, 4000, 10, {"A": 0.5, "B": 0.25, "C": 0.25}, seed=3).toPandas()
    p = x.pivot(index="path", columns="ticker", values="s")
    assert np.allclose(x.groupby("path").basket.first(), 0.5 * p.A + 0.25 * p.B + 0.25 * p.C)
    rho = np.corrcoef(np.log(p.to_numpy()).T)
    shrunk = want * 0.9 + np.diag(np.diag(want)) * 0.1
    assert np.allclose(rho, shrunk / np.sqrt(np.outer(np.diag(shrunk), np.diag(shrunk))), atol=0.05)
    assert np.allclose(np.log(p / 100).mean(), [10 * last[t].mean() for t in "ABC"], atol=0.004)
    with pytest.raises(ValueError):
        correlated.portfolio(spark, returns, 10, 5, {"A": 0.7})
