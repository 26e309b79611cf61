"""Distributed connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


#: Links that a task takes on average, and tasks at least: small sets of links do not go through all shuffle partitions.
TASK_LINKS, TASKS = 200_000, 8


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one link, and to a node without any: nothing is left to do."""
    n, starts = edges.agg(F.count("*"), F.count_distinct("u")).first()
    return n == starts and edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` -> ``(node, component)`` for every node but the roots; ``component`` is the smallest node reachable.

    Rounds end when the links are stars. A round takes two grouped minima and two equi-joins; a hub's rows can be split by adaptive execution since only
    joins, never windows, hold them. Links stay distributed, and each round is cut off in the shared checkpoint folder.
    Nulls and loops are ignored; an empty input gives an empty result.
    """
    now = checkpoint(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(now)
    while not _stars(now):
        tasks = max(TASKS, -(-state[0] // TASK_LINKS))
        now = now.coalesce(tasks)
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpoint(small.unionAll(least.select("u", F.col("m").alias("v"))).coalesce(tasks).distinct().coalesce(tasks))
        last, state = state, _state(now)
        if last == state:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
