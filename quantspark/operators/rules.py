"""Trade rules over rows of prices: a fold within the row, so no step of a path is shuffled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Simulation
from ..functions.dialect import SPARK
from ..tactical import Rule, Tactical
from .simulate import dynamics, number

#: An entry signal: of the day and the whole row of prices; it must read no price after the day.
Entry = Callable[[Column, Column], Column]

_TRADE = "struct<entry_day:int,exit_day:int,entry_price:double,exit_price:double,exit_reason:string>"


def price_paths(spark: SparkSession, c: Simulation) -> DataFrame:
    """``(path, prices)`` of a model without history: the price at the start and after each step."""
    c.check()
    state, move = dynamics(SPARK, c)
    read = {k: f"a.{k}" for k in state}
    start = ", ".join(f"'{k}', CAST({v} AS DOUBLE)" for k, v in state.items())
    after = ", ".join(f"'{k}', CAST({move[k].format(**read, step='step')} AS DOUBLE)" for k in state)
    fold = f"aggregate(sequence(1, {c.horizon}), named_struct({start}, 'xs', CAST(array() AS ARRAY<DOUBLE>)), (a, step) -> named_struct({after}, 'xs', array_append(a.xs, a.x)))"
    return spark.sql(f"SELECT path, transform(array_append(f.xs, f.x), x -> {number(c.s0)} * exp(x)) AS prices FROM (SELECT path, {fold} AS f FROM {SPARK.rows(c.paths, 'path')} p) q")


def apply_rule(paths: DataFrame, rule: Rule, cost: float = 0.0, entry: Entry | None = None) -> DataFrame:
    """One row a trade of ``paths(path, prices)``: path, trade, side, days, prices, pnl, pnl_pct, exit_reason, holding_days.

    On each later day, in this order: stop, target, trailing stop from the best price since entry, holding limit or the
    path's end. After an exit the search goes on with the next day where the rule allows. A signal on the last day opens
    nothing. A row with fewer than two prices, or with one that is null, not finite or not positive, has no trade.
    """
    rule.check()
    s = -1.0 if rule.direction == "short" else 1.0
    prices, last = F.col("prices"), F.size("prices") - 1
    signal = entry or (lambda day, _: day >= rule.entry_day)

    def move(a: Column, day: Column) -> Column:
        now = F.get(prices, day)
        best = s * F.greatest(s * a.m, s * now)
        hit = lambda share, on: s * now <= s * on * (1 - s * share)
        why = F.when(F.lit(rule.stop > 0) & hit(rule.stop, a.e), "stop_loss")
        if rule.target:
            why = why.when(s * now >= s * a.e * (1 + s * rule.target), "take_profit")
        if rule.trail:
            why = why.when(hit(rule.trail, best), "trailing_stop")
        why = why.when((day - a.d >= rule.hold) | (day == last), "max_holding")
        closes = a.held & why.isNotNull()
        opens = ~a.held & (F.size(a.trades) < rule.most) & (day < last) & F.coalesce(signal(day, prices), F.lit(False))
        trade = F.struct(a.d.alias("entry_day"), day.alias("exit_day"), a.e.alias("entry_price"), now.alias("exit_price"), why.alias("exit_reason"))
        return F.struct(
            F.when(closes, False).when(opens, True).otherwise(a.held).alias("held"), F.when(opens, now).otherwise(a.e).alias("e"), F.when(opens, now).otherwise(best).alias("m"),
            F.when(opens, day).otherwise(a.d).alias("d"), F.when(closes, F.array_append(a.trades, trade)).otherwise(a.trades).alias("trades"),
        )

    start = F.struct(F.lit(False).alias("held"), F.lit(0.0).alias("e"), F.lit(0.0).alias("m"), F.lit(0).alias("d"), F.array().cast(f"array<{_TRADE}>").alias("trades"))
    sound = (F.size(prices) >= 2) & F.coalesce(F.forall(prices, lambda x: (x > 0) & (x < float("inf"))), F.lit(False))
    trades = paths.where(sound).select("path", F.posexplode(F.aggregate(F.sequence(F.lit(0), last), start, move, lambda a: a.trades)).alias("trade", "t")).select("path", "trade", "t.*")
    pnl = s * (F.col("exit_price") - F.col("entry_price")) - cost * (F.col("exit_price") + F.col("entry_price"))
    return trades.select(
        "path", "trade", F.lit(rule.direction).alias("side"), "entry_day", "exit_day", "entry_price", "exit_price", pnl.alias("pnl"), (pnl / F.col("entry_price")).alias("pnl_pct"),
        "exit_reason", (F.col("exit_day") - F.col("entry_day")).alias("holding_days"),
    )


def outcomes(paths: DataFrame, trades: DataFrame) -> DataFrame:
    """One row a path: sums over its trades, what was ever hit, the last exit; a path without trades has zeros and ``no_trade``."""
    hit = lambda why: F.max((F.col("exit_reason") == why).cast("int")) == 1
    by = trades.groupBy("path").agg(
        F.count("*").alias("n_trades"), F.sum("pnl").alias("pnl"), F.min_by("entry_price", "trade").alias("entry_price"), F.max_by("exit_reason", "trade").alias("exit_reason"), F.sum("holding_days").alias("holding_days"),
        hit("stop_loss").alias("stop_hit"), hit("take_profit").alias("target_hit"), hit("trailing_stop").alias("trail_hit"),
    )
    x = paths.select("path").join(by, "path", "left").withColumn("pnl_pct", F.col("pnl") / F.col("entry_price"))
    return x.fillna({"n_trades": 0, "pnl": 0.0, "pnl_pct": 0.0, "exit_reason": "no_trade", "holding_days": 0, "stop_hit": False, "target_hit": False, "trail_hit": False})


def rule_statistics(by_path: DataFrame) -> DataFrame:
    """One row of shares, moments and percentiles of ``outcomes``; a result within 1e-12 of zero is flat."""
    share = lambda c: F.avg(c.cast("double"))
    p = F.col("pnl")
    aggs = {
        "n_paths": F.count("*"), "prob_profit": share(p > 1e-12), "prob_loss": share(p < -1e-12), "prob_flat": share(F.abs(p) <= 1e-12), "avg_pnl": F.avg(p), "median_pnl": F.median(p), "std_pnl": F.coalesce(F.stddev_samp(p), F.lit(0.0)),
        "best_pnl": F.max(p), "worst_pnl": F.min(p), "avg_pnl_pct": F.avg("pnl_pct"), "median_pnl_pct": F.median("pnl_pct"), **{f"pnl_p{k:02d}": F.percentile(p, F.lit(k / 100)) for k in (5, 25, 75, 95)},
        "total_trades": F.sum("n_trades"), "frac_paths_with_trade": share(F.col("n_trades") > 0), "stop_hit_rate": share(F.col("stop_hit")), "take_profit_rate": share(F.col("target_hit")), "trailing_stop_rate": share(F.col("trail_hit")),
        "max_hold_exit_rate": share(F.col("exit_reason") == "max_holding"), "avg_holding_days": F.avg("holding_days"), "median_holding_days": F.median("holding_days"),
    }
    return by_path.agg(*(v.alias(k) for k, v in aggs.items()))


def run_tactical(spark: SparkSession, t: Tactical, model: str = "gbm", entry: Entry | None = None) -> tuple[DataFrame, DataFrame]:
    """Trades and their statistics for a configuration with price and volatility; draws follow the seed, so all runs share them."""
    t.check()
    if t.s0 is None or t.sigma is None:
        raise ValueError("a run needs s0 and sigma")
    paths = price_paths(spark, Simulation(model=model, s0=t.s0, paths=t.paths, horizon=t.horizon, mu=t.drift, sigma=t.sigma, seed=t.seed))
    trades = apply_rule(paths, t.rule or Rule(hold=t.horizon), t.cost, entry)
    return trades, rule_statistics(outcomes(paths, trades))
