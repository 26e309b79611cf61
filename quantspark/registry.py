"""Queries by name, and their SQL oracles."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .functions.dialect import DUCK, SPARK, Dialect
from .sources.tables import DIRECTIONAL, RECURRENCES, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def oracle(sql: str) -> str:
    """The oracle's text; the recurrences come first where it reads them."""
    first = [text for name, text in (("ema_rsi", RECURRENCES), ("dmi", DIRECTIONAL)) if re.search(rf"\b{name}\b", sql)]
    if not first:
        return sql
    body = sql.strip().removeprefix("WITH").strip().removeprefix("RECURSIVE").strip()
    return f"WITH RECURSIVE {', '.join(first)}, {body}"


def plan(build: Callable[[Dialect], str]) -> Callable[[Dialect], str]:
    """Register a plan that both dialects can state. Catalyst gets the whole relational plan; nothing is collected."""
    name = build.__name__

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir)
        return spark.sql(build(SPARK))

    QUERIES[name], ORACLES[name] = run, oracle(build(DUCK))
    return build


def query(sql: str | None = None):
    """Register a DataFrame query, with its oracle where SQL has one."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def load() -> None:
    from .plans import configured, decisions, events, gauntlet, messages, pricing, quasi, report, signals, simulation, statistics, tactical, validation  # noqa: F401


load()
