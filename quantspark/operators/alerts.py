"""Alerts applied to settings, as joins: what an alert says comes first, then the calibration, then the settings' own values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tactical import LONG_TRENDS, SHORT_TRENDS

#: Names under which a payload may hold a field; the first with a value counts.
FIELDS = {"ticker": ("ticker", "symbol", "sym"), "price": ("price", "close", "last"), "trend": ("trend", "direction", "signal"), "rsi": ("momentum", "rsi", "mom")}


def named(alerts: DataFrame, field: str) -> Column:
    """The first alias of ``field`` among the columns with a value that is not empty, as text."""
    there = [F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in FIELDS[field] if c in alerts.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def side_of(trend: Column) -> Column:
    word = F.lower(F.trim(trend))
    return F.when(word.isin(*LONG_TRENDS), "long").when(word.isin(*SHORT_TRENDS), "short")


def apply_alerts(alerts: DataFrame, settings: DataFrame, calibrations: DataFrame | None = None, *, strength: float = 0.4, jump_strength: float = 0.5) -> DataFrame:
    """``(alert, ticker, s0, side, allowed, mu, sigma, jump_multiplier, source)`` of every row of ``alerts(alert, run, payload fields...)``.

    ``settings(run, ticker, s0, side, mu, sigma, align, block_against, scale_volatility, scale_jumps, use_drift)`` is joined by run, and
    ``calibrations(ticker, bucket, mu)`` by instrument and by ``bucket`` of the alert, where it has that column. A side that the
    settings fix and that fights the trend is not allowed where ``block_against`` is set and the side is not aligned. With ``use_drift``
    the drift is the calibrated one, zero where there is none. An alert whose run has no settings is left out; fields that are
    missing, empty, not finite or (prices) not positive change nothing.
    """
    own = ["alert", "run", *(["bucket"] if "bucket" in alerts.columns else [])]
    a = alerts.select(*own, F.nullif(F.upper(named(alerts, "ticker")), F.lit("UNKNOWN")).alias("a_ticker"), named(alerts, "price").try_cast("double").alias("a_price"), side_of(named(alerts, "trend")).alias("a_side"), named(alerts, "rsi").try_cast("double").alias("a_rsi"))
    sound = lambda c: F.when(F.abs(c) < float("inf"), c)
    x = a.join(settings, "run").withColumn("ticker", F.coalesce("a_ticker", "ticker"))
    if calibrations is not None and "bucket" in own:
        c = calibrations.select(F.col("ticker").alias("c_ticker"), F.col("bucket").alias("c_bucket"), F.col("mu").alias("c_mu"))
        x = x.join(c, (F.col("ticker") == F.col("c_ticker")) & (F.col("bucket") == F.col("c_bucket")), "left")
    else:
        x = x.withColumn("c_mu", F.lit(None).cast("double"))
    price, pull = sound(F.col("a_price")), (sound(F.col("a_rsi")) - 50) / 50
    pull = F.when(pull.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), pull)))
    aligned = F.coalesce(F.when(F.col("align"), F.col("a_side")), F.col("side"))
    fights = F.col("block_against") & (F.coalesce(aligned, F.lit("long")) != F.col("a_side"))
    scale = lambda on, value: F.coalesce(F.when(F.col(on), value), F.lit(1.0))
    return x.select(
        "alert", "ticker", F.coalesce(F.when(price > 0, price), F.col("s0")).alias("s0"), aligned.alias("side"), (~F.coalesce(fights, F.lit(False))).alias("allowed"),
        F.when(F.col("use_drift"), F.coalesce("c_mu", F.lit(0.0))).otherwise(F.col("mu")).alias("mu"), (F.col("sigma") * scale("scale_volatility", F.when(pull.isNotNull(), F.greatest(F.lit(0.5), F.least(F.lit(2.0), 1 + strength * pull))))).alias("sigma"),
        scale("scale_jumps", F.when(pull.isNotNull(), F.least(F.lit(2.5), 1 + jump_strength * F.abs(pull)))).alias("jump_multiplier"), F.when(F.col("use_drift"), F.when(F.col("c_mu").isNotNull(), "calibration").otherwise("none")).otherwise("settings").alias("source"),
    )
