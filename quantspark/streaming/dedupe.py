"""Consecutive deduplication of alerts against the stored latest one, in batch and as a keyed stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WINDOW_S = 600
OUT = "event_id long, ticker string, duplicate boolean"
STATE = "trend string, tercile string, ts double"


def step(stored: tuple | None, trend: str | None, tercile: str | None, at: float) -> tuple[bool, tuple]:
    """(is a duplicate, what is stored afterwards): equal trend and tercile within the window of the stored alert."""
    if stored and stored[0] == trend and stored[1] == tercile and abs(at - stored[2]) <= WINDOW_S:
        return True, stored
    return False, (trend, tercile, at)


def _mark(pdf: pd.DataFrame, stored: tuple | None) -> tuple[pd.DataFrame, tuple | None]:
    pdf = pdf.sort_values(["ts", "event_id"])
    twice = []
    for row in zip(pdf["trend"], pdf["tercile"], pdf["ts"].astype("int64") / 1e9, strict=True):
        again, stored = step(stored, *row)
        twice.append(again)
    return pd.DataFrame({"event_id": pdf["event_id"], "ticker": pdf["ticker"], "duplicate": twice}), stored


def _sorted_alerts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Alerts sorted by ticker and time, a batch at a time: of a ticker only its stored alert is carried on."""
    ticker, stored = None, None
    for b in batches:
        twice = []
        for own, *row in zip(*(b.column(c).to_pylist() for c in ("ticker", "trend", "tercile", "at")), strict=True):
            if own != ticker:
                ticker, stored = own, None
            again, stored = step(stored, *row)
            twice.append(again)
        yield pa.record_batch([b.column("event_id"), b.column("ticker"), pa.array(twice, pa.bool_())], ["event_id", "ticker", "duplicate"])


def dedupe(alerts: DataFrame) -> DataFrame:
    """Batch: a ticker's alerts in order of time, however many, as a stream through one task."""
    x = alerts.select("event_id", "ticker", "trend", "tercile", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return x.repartition("ticker").sortWithinPartitions("ticker", "at", "event_id").mapInArrow(_sorted_alerts, OUT)


def dedupe_stream(alerts: DataFrame) -> DataFrame:
    """Stream: the stored alert of each ticker is keyed state; a micro-batch is taken in order of time."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, stored = _mark(pd.concat(list(frames)), tuple(state.get) if state.exists else None)
        state.update(stored)
        yield out

    return alerts.groupBy("ticker").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
