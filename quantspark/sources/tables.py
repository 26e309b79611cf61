"""Input tables as views, and market data derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.recurrences import with_directional_index, with_recurrences

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str) -> None:
    """The input tables by name, and ``ema_rsi`` and ``dmi``: the recurrences by ticker and bar."""
    for name in TABLES:
        read(spark, sf_dir, name).createOrReplaceTempView(name)
    with_recurrences(spark.sql(f"WITH {BARS} SELECT ticker, t, close FROM bars")).createOrReplaceTempView("ema_rsi")
    with_directional_index(spark.sql(f"WITH {BARS} SELECT ticker, t, high, low, close FROM ohlc")).createOrReplaceTempView("dmi")


#: Daily bars: a ticker for each order priority, an index level that follows the day's average order total.
BARS = """
day AS (
  SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS d, avg(o_totalprice) AS a, min(o_totalprice) AS lo, max(o_totalprice) AS hi
  FROM orders WHERE o_totalprice > 0 GROUP BY o_orderpriority, CAST(o_orderdate AS DATE)),
bars AS (
  SELECT ticker, CAST(row_number() OVER (PARTITION BY ticker ORDER BY d) AS INT) AS t, d,
         100 * exp(sum(0.01E0 * (a - 250000) / 144000) OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS close,
         0.01E0 * (hi - a) / 144000 AS up, 0.01E0 * (a - lo) / 144000 AS down
  FROM day),
ohlc AS (
  SELECT ticker, t, d, close, coalesce(lag(close) OVER (PARTITION BY ticker ORDER BY t), close) AS open,
         greatest(close, coalesce(lag(close) OVER (PARTITION BY ticker ORDER BY t), close)) * exp(up) AS high,
         least(close, coalesce(lag(close) OVER (PARTITION BY ticker ORDER BY t), close)) * exp(-down) AS low
  FROM bars),
rets AS (SELECT ticker, t, d, close, ln(close) - lag(ln(close)) OVER (PARTITION BY ticker ORDER BY t) AS r FROM bars)
"""


#: ``ema_rsi`` in the oracle's SQL, by a recursive relation.
RECURRENCES = f"""eb AS (WITH {BARS} SELECT ticker, t, close FROM bars),
em AS (SELECT ticker, t, close, ln(close) - lag(ln(close)) OVER o AS r, greatest(close - lag(close) OVER o, 0) AS up, greatest(lag(close) OVER o - close, 0) AS dn FROM eb WINDOW o AS (PARTITION BY ticker ORDER BY t)),
es AS (
  SELECT ticker, avg(close) FILTER (WHERE t <= 9) AS s9, avg(close) FILTER (WHERE t <= 21) AS s21, avg(up) FILTER (WHERE t BETWEEN 2 AND 15) AS su, avg(dn) FILTER (WHERE t BETWEEN 2 AND 15) AS sd,
         var_pop(r) FILTER (WHERE t BETWEEN 2 AND 21) AS sv FROM em GROUP BY ticker),
ew AS (
  SELECT m.ticker, m.t, m.close, CAST(NULL AS DOUBLE) AS e9, CAST(NULL AS DOUBLE) AS e21, CAST(NULL AS DOUBLE) AS u, CAST(NULL AS DOUBLE) AS dn, CAST(NULL AS DOUBLE) AS v FROM em m WHERE m.t = 1
  UNION ALL
  SELECT m.ticker, m.t, m.close, CASE WHEN m.t = 9 THEN s9 ELSE e9 + 0.2E0 * (m.close - e9) END, CASE WHEN m.t = 21 THEN s21 ELSE e21 + 2E0 / 22 * (m.close - e21) END,
         CASE WHEN m.t = 15 THEN su ELSE w.u + (m.up - w.u) / 14 END, CASE WHEN m.t = 15 THEN sd ELSE w.dn + (m.dn - w.dn) / 14 END, CASE WHEN m.t = 21 THEN sv ELSE 0.94E0 * v + 0.06E0 * m.r * m.r END
  FROM ew w JOIN em m ON m.ticker = w.ticker AND m.t = w.t + 1 JOIN es s ON s.ticker = w.ticker),
ema_rsi AS (SELECT ticker, t, close, e9 AS ema9, e21 AS ema21, CASE WHEN dn = 0 THEN CASE WHEN u > 0 THEN 100E0 ELSE 50E0 END ELSE 100 - 100 / (1 + u / dn) END AS rsi14, v AS ewma_var FROM ew)"""

#: ``dmi`` in the oracle's SQL: averaged moves, then the averaged index of them.
DIRECTIONAL = f"""db AS (WITH {BARS} SELECT ticker, t, high, low, close FROM ohlc),
dw AS (SELECT ticker, t, high - lag(high) OVER o AS up, lag(low) OVER o - low AS dn, greatest(high - low, abs(high - lag(close) OVER o), abs(low - lag(close) OVER o)) AS tr FROM db WINDOW o AS (PARTITION BY ticker ORDER BY t)),
dq AS (SELECT ticker, t, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pm, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS nm, tr FROM dw WHERE t > 1),
dsd AS (SELECT ticker, avg(pm) AS pm, avg(nm) AS nm, avg(tr) AS tr FROM dq WHERE t <= 15 GROUP BY ticker HAVING count(*) = 14),
dr AS (SELECT ticker, 15 AS t, pm, nm, tr FROM dsd UNION ALL SELECT q.ticker, q.t, r.pm + (q.pm - r.pm) / 14, r.nm + (q.nm - r.nm) / 14, r.tr + (q.tr - r.tr) / 14 FROM dr r JOIN dq q ON q.ticker = r.ticker AND q.t = r.t + 1),
dx AS (SELECT ticker, t, CASE WHEN tr > 0 AND pm + nm > 0 THEN 100 * abs(pm - nm) / (pm + nm) ELSE 0E0 END AS x FROM dr),
dz AS (SELECT ticker, avg(x) AS x FROM dx WHERE t <= 28 GROUP BY ticker HAVING count(*) = 14),
da AS (SELECT ticker, 28 AS t, x FROM dz UNION ALL SELECT d.ticker, d.t, a.x + (d.x - a.x) / 14 FROM da a JOIN dx d ON d.ticker = a.ticker AND d.t = a.t + 1),
dmi AS (SELECT b.ticker, b.t, da.x AS adx14 FROM db b LEFT JOIN da ON da.ticker = b.ticker AND da.t = b.t)"""
