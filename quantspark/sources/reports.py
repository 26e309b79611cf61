"""Sinks and stores: reports as JSON, CSV and Markdown, matrices, append-only logs, the latest alert beside its history, calibrations with an age."""

from __future__ import annotations

import json
import uuid
import warnings
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def metric_rows(row: DataFrame) -> DataFrame:
    """``(metric, value)`` of the numeric columns of a one-row relation."""
    numbers = [c for c, t in row.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal")]
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in numbers])
    return row.select(F.inline(pairs))


def matrix(pairs: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Long pairs as a matrix with a line for each ``row`` and a column for each ``column``."""
    return pairs.groupBy(row).pivot(column).agg(F.first(value)).orderBy(row)


def markdown(title: str, rows: list, columns: list[str]) -> str:
    cell = lambda v: "" if v is None else f"{v:,.6g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows]) + "\n"


def write_report(summary: DataFrame, path: str, title: str = "Risk report") -> None:
    """A one-row summary under ``path``: json (the row), csv (metric, value) and md (a table)."""
    rows = metric_rows(summary).persist()
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/json")
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    text = markdown(title, rows.collect(), ["metric", "value"])  # a row a column of the summary
    summary.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/md")
    rows.unpersist()


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a log of JSON lines; blank lines, broken lines and values that are no objects are skipped."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where(F.col("line").startswith("{"))
    x = lines.select(F.from_json("line", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return x.where("r is not null and r._bad is null").select("r.*").drop("_bad")


def append_log(entries: DataFrame, path: str) -> None:
    entries.select(F.to_json(F.struct(*entries.columns)).alias("value")).write.mode("append").text(path)


def rewrite_log(entries: DataFrame, path: str) -> str:
    """The whole log in a folder of its own; returns it. The one it was read from stays as it was."""
    new = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    append_log(entries, new)
    return new


def describe(config: object) -> str:
    """A configuration as JSON with sorted keys, for reports and for its hash."""
    return json.dumps({k: v for k, v in vars(config).items() if not k.startswith("_")}, sort_keys=True)


# Days after which a stored calibration warns and is refused.
WARN_DAYS, REFUSE_DAYS = 30, 120


class StaleCalibration(ValueError):
    """The stored table is too old to be trusted."""


def save_calibration(table: DataFrame, path: str, created: datetime | None = None) -> None:
    """Buckets ``table(ticker, bucket, ...)`` with the time of their making, a folder a ticker; only the tickers given are replaced."""
    at = F.lit(created or datetime.now(timezone.utc))
    table.withColumn("created_at", at).repartition("ticker").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ticker").parquet(path)


def load_calibration(spark: SparkSession, path: str, ticker: str, now: datetime | None = None, warn_days: int = WARN_DAYS, refuse_days: int = REFUSE_DAYS) -> DataFrame:
    """A ticker's buckets. None stored: FileNotFoundError; older than ``refuse_days``: StaleCalibration; than ``warn_days``: a warning."""
    found = spark.read.parquet(path).where(F.col("ticker") == ticker)
    made = found.agg(F.min(F.unix_seconds("created_at")).alias("t"), F.count("*").alias("n")).first()
    if not made["n"]:
        raise FileNotFoundError(f"no calibration of {ticker} in {path}")
    if made["t"] is None:
        raise ValueError(f"the calibration of {ticker} has no time")
    age = ((now or datetime.now(timezone.utc)).timestamp() - made["t"]) / 86400
    if age > refuse_days:
        raise StaleCalibration(f"the calibration of {ticker} is {age:.0f} days old")
    if age > warn_days:
        warnings.warn(f"the calibration of {ticker} is {age:.0f} days old", UserWarning, stacklevel=2)
    return found


def read_archive(spark: SparkSession, path: str, schema: str, ticker: str | None = None) -> DataFrame:
    """A folder of saved alerts, one JSON object a file in any layout; files that are no objects are skipped, the name ignores case."""
    whole = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True).select(F.trim(F.regexp_replace("value", r"^\s+", "")).alias("t"), F.col("_metadata.file_path").alias("file"))
    x = whole.where(F.col("t").startswith("{")).select("file", F.from_json("t", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).where("r._bad is null")
    rows = x.select("file", "r.*").drop("_bad")
    return rows if ticker is None else rows.where(F.upper("ticker") == ticker.upper())


def rendered(sections: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """``(ticker, markdown)`` of ``sections(ticker, place, section, text)`` and the rows of ``table(ticker, ...)``: a few rows a ticker, joined as text."""
    shown = lambda c: F.when(F.col(c).isNull(), "").otherwise(F.regexp_replace(F.format_number(c, 4) if dict(table.dtypes)[c] == "double" else F.col(c).cast("string"), r"\|", r"\\|"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *map(shown, columns)), F.lit(" |"))
    rows = table.groupBy("ticker").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("rows"))
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns) + "\n"
    part = F.struct("place", F.concat(F.lit("## "), F.col("section"), F.lit("\n\n"), F.col("text")).alias("text"))
    texts = sections.groupBy("ticker").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["text"]), "\n\n").alias("texts"))
    body = F.concat(F.lit("# "), F.col("ticker"), F.lit("\n\n"), F.col("texts"), F.when(F.col("rows").isNotNull(), F.concat(F.lit("\n\n## Models\n\n" + head), F.col("rows"))).otherwise(""), F.lit("\n"))
    return texts.join(rows, "ticker", "left").select("ticker", body.alias("markdown"))


def write_bundle(sections: DataFrame, table: DataFrame, path: str, columns: list[str]) -> None:
    """The report of every ticker below ``path``: json and csv of the table, md of sections and table, a folder a ticker; no row meets the driver."""
    kept = ["ticker", *[c for c in columns if c != "ticker"]]
    table.select(*kept).repartition("ticker").write.mode("overwrite").partitionBy("ticker").json(f"{path}/json")
    table.select(*kept).repartition("ticker").write.mode("overwrite").option("header", True).partitionBy("ticker").csv(f"{path}/csv")
    rendered(sections, table, columns).repartition("ticker").write.mode("overwrite").partitionBy("ticker").option("lineSep", "\n\n").text(f"{path}/md")


def markdown_text(title: str, table: DataFrame, order: list[str]) -> DataFrame:
    """One row with a small table as Markdown (``value``), sorted by ``order``; made by a grouped aggregate, for summaries of some hundred rows."""
    kinds = dict(table.dtypes)
    shown = lambda c: F.coalesce(F.format_string("%.6g", F.col(c)) if kinds[c] == "double" else F.regexp_replace(F.col(c).cast("string"), r"\|", r"\\|"), F.lit(""))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *map(shown, table.columns)), F.lit(" |"))
    rows = table.agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("line_")))).alias("rows"))
    head = f"# {title}\n\n| " + " | ".join(table.columns) + " |\n|" + "---|" * len(table.columns) + "\n"
    return rows.select(F.concat(F.lit(head), F.array_join(F.transform("rows", lambda r: r["line_"]), "\n"), F.lit("\n")).alias("value"))


def write_outcomes(by_path: DataFrame, path: str) -> None:
    """Outcomes of every path, as ``rules.outcomes`` gives them, as CSV parts with a header."""
    by_path.write.mode("overwrite").option("header", True).csv(path)
