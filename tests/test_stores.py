"""Stored calibrations and their age, archives of alerts, ingestion as a stream."""

import json
from datetime import datetime, timedelta, timezone

import pytest

from quantspark.sources import reports
from quantspark.streaming.ingest import ingest


def test_calibrations_age(spark, tmp_path):
    path, now = f"{tmp_path}/cal", datetime(2026, 5, 1, tzinfo=timezone.utc)
    table = lambda t, mu: spark.createDataFrame([(t, "bullish_low", mu)], "ticker string, bucket string, mu double")
    reports.save_calibration(table("A", 0.1), path, now)
    reports.save_calibration(table("B", 0.2), path, now - timedelta(days=60))
    reports.save_calibration(table("A", 0.3), path, now - timedelta(days=1))
    assert [r.mu for r in reports.load_calibration(spark, path, "A", now).collect()] == [0.3]
    with pytest.warns(UserWarning):
        assert reports.load_calibration(spark, path, "B", now).count() == 1
    with pytest.raises(reports.StaleCalibration):
        reports.load_calibration(spark, path, "B", now + timedelta(days=90))
    with pytest.raises(FileNotFoundError):
        reports.load_calibration(spark, path, "C", now)


def test_archive(spark, tmp_path):
    for i, text in enumerate((json.dumps({"ticker": "a", "price": 1.0}, indent=2), "\n" + json.dumps({"ticker": "B", "price": 2.0}), "[1]", "{broken", "", '"x"')):
        (tmp_path / f"{i}.json").write_text(text)
    (tmp_path / "note.txt").write_text('{"ticker": "A"}')
    schema = "ticker string, price double"
    assert sorted(r.price for r in reports.read_archive(spark, str(tmp_path), schema).collect()) == [1.0, 2.0]
    assert [r.price for r in reports.read_archive(spark, str(tmp_path), schema, "A").collect()] == [1.0]


def test_ingest(spark, tmp_path):
    row = lambda **k: json.dumps({"ts": "2026-01-05T10:00:00Z", "ticker": "x", **k})
    lines = [row(event_id=1, trend="Buy", rsi=20), row(event_id=1, trend="Buy", rsi=20), row(event_id=2, direction="down", momentum=150, close=3), row(ticker=None, symbol=" q ", trend="odd"), row(ts=None), "no object", "", row(ticker="")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(lines))
    q = ingest(spark, f"{tmp_path}/in", files=1).writeStream.format("memory").queryName("alerts_in").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.ticker, r.trend, r.rsi, r.tercile, r.price) for r in spark.table("alerts_in").collect() if r.ticker == "X")
    assert got == [("X", "bearish", 100.0, "high", 3.0), ("X", "bullish", 20.0, "low", None)]
    assert [(r.trend, r.rsi, r.tercile) for r in spark.table("alerts_in").collect() if r.ticker == "Q"] == [("neutral", None, None)]
