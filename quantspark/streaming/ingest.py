"""Alerts as a stream: JSON objects by the file or line, fields by their first name or an alias, late rows dropped by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tactical import LONG_TRENDS, SHORT_TRENDS

_FIELDS = "event_id long, ts timestamp, received_at_utc timestamp, ticker string, symbol string, price double, close double, trend string, direction string, momentum double, rsi double"


def normalize(lines: DataFrame) -> DataFrame:
    """``(event_id, ts, ticker, trend, rsi, tercile, price)`` of ``lines(value)``; lines that are no objects, or have no name or time, are skipped.

    An alert without event_id takes a hash of its line. A trend that names no side is neutral; an oscillator outside 0..100 is clipped.
    """
    x = lines.select("value", F.from_json("value", _FIELDS).alias("r")).where(F.trim("value").startswith("{")).select("value", "r.*")
    word = F.lower(F.trim(F.coalesce("trend", "direction", F.lit(""))))
    rsi = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce("momentum", "rsi")))
    out = x.select(
        F.coalesce("event_id", F.xxhash64("value")).alias("event_id"), F.coalesce("ts", "received_at_utc").alias("ts"), F.upper(F.trim(F.coalesce("ticker", "symbol"))).alias("ticker"),
        F.when(word.isin(*LONG_TRENDS), "bullish").when(word.isin(*SHORT_TRENDS), "bearish").otherwise("neutral").alias("trend"), F.when(F.coalesce("momentum", "rsi").isNotNull(), rsi).alias("rsi"), F.coalesce("price", "close").alias("price"),
    )
    tercile = F.when(F.col("rsi") < 40, "low").when(F.col("rsi") > 60, "high").when(F.col("rsi").isNotNull(), "mid")
    return out.withColumn("tercile", tercile).where("ticker is not null and ticker <> '' and ts is not null")


def ingest(spark: SparkSession, path: str, late: str = "10 minutes", files: int | None = None) -> DataFrame:
    """The folder as a stream of alerts, each event_id once within the watermark. ``files``: the most a micro-batch takes."""
    reader = spark.readStream.schema("value string")
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    return normalize(reader.text(path)).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
