"""Evaluation of chart readings against the truth: cases from folders or lines, scores by expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A reading of a chart, as far as scores need it.
READING = "ticker string, timeframe string, bias string, indicators struct<rsi:struct<value:double>>, levels array<struct<price:double,kind:string,strength:double>>, confidence struct<overall:double>"


def _reading(text: Column) -> Column:
    """The reading in a JSON object; null for anything else."""
    r = F.from_json(F.when(F.trim(text).startswith("{"), text), f"{READING}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return F.when(r.isNotNull() & r["_bad"].isNull(), r.dropFields("_bad"))


def read_cases(spark: SparkSession, folder: str) -> DataFrame:
    """``(case, truth, pred)`` of the folders below with both ``ground_truth.json`` and ``prediction.json``; ``truth`` or ``pred`` is null where broken."""
    files = spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).text(folder, wholetext=True)
    part = F.split(F.col("_metadata.file_path"), "/")
    x = files.select(F.element_at(part, -2).alias("case"), F.element_at(part, -1).alias("name"), F.regexp_replace("value", r"^\s+", "").alias("value"))
    by = x.where(F.col("name").isin("ground_truth.json", "prediction.json")).groupBy("case").pivot("name", ["ground_truth.json", "prediction.json"]).agg(F.first("value"))
    both = by.where("`ground_truth.json` is not null and `prediction.json` is not null")
    return both.select("case", _reading(F.col("`ground_truth.json`")).alias("truth"), _reading(F.col("`prediction.json`")).alias("pred"))


def read_case_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same from lines with the fields id, truth and pred; without an id the line's hash names it. Blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    part = lambda f: _reading(F.get_json_object("value", f"$.{f}")).alias(f)
    return lines.select(F.coalesce(F.nullif(F.get_json_object("value", "$.id"), F.lit("")), F.hex(F.xxhash64("value"))).alias("case"), part("truth"), part("pred"))


def matched(truth: Column, read: Column, tolerance: float = 0.01) -> Column:
    """How many true prices, in order, find a read price of their own within the tolerance: the first that is free. A fold over few levels."""
    near = lambda t, p: F.abs(t - p) / F.greatest(F.abs(t), F.lit(1e-9)) <= tolerance
    free = lambda used, t: F.filter(F.sequence(F.lit(1), F.size(read)), lambda j: ~F.array_contains(used, j) & near(t, F.element_at(read, j)))
    used = F.aggregate(truth, F.array().cast("array<int>"), lambda used, t: F.concat(used, F.slice(free(used, t), 1, 1)))
    return F.when((F.size(truth) > 0) & (F.size(read) > 0), F.size(used)).otherwise(0)


def score_cases(cases: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """A row a case whose readings are both sound: accuracies, the oscillator's error (null without both values), and levels' precision, recall and F1.

    Without levels on either side all three are 1; without read levels precision is 1, without true levels recall is 1.
    """
    prices = lambda c: F.transform(F.filter(F.coalesce(F.col(c)["levels"], F.array().cast("array<struct<price:double,kind:string,strength:double>>")), lambda x: x["price"].isNotNull()), lambda x: x["price"])
    same = lambda f, how=lambda c: c: F.coalesce(how(F.col("truth")[f]).eqNullSafe(how(F.col("pred")[f])), F.lit(False)).cast("double")
    x = cases.where("truth is not null and pred is not null").withColumns({"t": prices("truth"), "p": prices("pred")}).withColumn("hits", matched(F.col("t"), F.col("p"), tolerance))
    precision = F.when(F.size("p") > 0, F.col("hits") / F.size("p")).otherwise(1.0)
    recall = F.when(F.size("t") > 0, F.col("hits") / F.size("t")).otherwise(1.0)
    f1 = F.when((F.size("t") == 0) & (F.size("p") == 0), 1.0).when(F.col("hits") > 0, 2.0 * F.col("hits") / (F.size("p") + F.size("t"))).otherwise(0.0)
    precision = F.when((F.size("t") == 0) & (F.size("p") > 0), 0.0).otherwise(precision)
    recall = F.when((F.size("p") == 0) & (F.size("t") > 0), 0.0).otherwise(recall)
    return x.select(
        "case", same("ticker", F.upper).alias("ticker_accuracy"), same("bias").alias("bias_accuracy"), F.abs(F.col("truth.indicators.rsi.value") - F.col("pred.indicators.rsi.value")).alias("rsi_abs_error"),
        precision.alias("level_precision"), recall.alias("level_recall"), f1.alias("level_f1"), same("timeframe", F.lower).alias("timeframe_match"), F.col("pred.confidence.overall").alias("confidence"),
    )


def aggregate_scores(scores: DataFrame) -> DataFrame:
    """One row: the number of cases and the means over those with a value; nulls without any."""
    names = {"ticker_accuracy": "ticker_accuracy", "bias_accuracy": "bias_accuracy", "rsi_abs_error": "mean_rsi_abs_error", "level_f1": "mean_level_f1", "level_precision": "mean_level_precision", "level_recall": "mean_level_recall", "timeframe_match": "timeframe_accuracy", "confidence": "mean_pred_confidence"}
    return scores.agg(F.count("*").alias("n"), *[F.avg(c).alias(k) for c, k in names.items()])


def level_key(price: Column) -> Column:
    """A price as text of six significant digits without trailing zeros, by which levels of two readings are compared."""
    digits = F.lit(5) - F.floor(F.log10(F.abs(price))).cast("int")
    text = F.format_string("%.10f", F.when(price == 0, F.lit(0.0)).otherwise(F.round(price * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits)))
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")


def signals_of(readings: DataFrame) -> DataFrame:
    """``readings(case, reading)`` as alerts with both names of every field; a missing overall confidence is the mean of the levels' positive strengths."""
    r = F.col("reading")
    strengths = F.transform(F.filter(F.coalesce(r["levels"], F.array().cast("array<struct<price:double,kind:string,strength:double>>")), lambda x: x["strength"] > 0), lambda x: x["strength"])
    mean = F.when(F.size(strengths) > 0, F.aggregate(strengths, F.lit(0.0), lambda a, x: a + x) / F.size(strengths))
    pair = lambda value, *names: [value.alias(n) for n in names]
    return readings.select(
        "case", F.lit("chart_vision").alias("source"), *pair(F.upper(r["ticker"]), "ticker", "symbol"), *pair(r["bias"], "trend", "direction"), *pair(r["indicators"]["rsi"]["value"], "momentum", "rsi"),
        *pair(r["timeframe"], "timeframe", "tf"), F.lit("vision").alias("parse_status"), F.coalesce(r["confidence"]["overall"], mean).alias("confidence_overall"), F.transform(r["levels"], lambda x: level_key(x["price"])).alias("levels"),
    )
