"""Alert ingestion, decisions, settlement and monitoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import Dialect
from ..registry import plan, query
from ..sources.tables import BARS, views
from ..streaming.dedupe import dedupe
from .signals import _SHRINK, FEATURES, _newey_west

#: Events as alerts: user as ticker, event type as trend, value as a clipped oscillator.
ALERTS = """
al AS (
  SELECT event_id, ts, concat('T', CAST(user_id AS VARCHAR(20))) AS ticker, CASE WHEN event_type IN ('purchase', 'view') THEN 'bullish' WHEN event_type = 'error' THEN 'bearish' ELSE 'neutral' END AS trend,
         greatest(0E0, least(100E0, value)) AS rsi, props FROM events),
av AS (SELECT *, CASE WHEN rsi < 40 THEN 'low' WHEN rsi > 60 THEN 'high' ELSE 'mid' END AS tercile FROM al)"""


@plan
def ingest_normalize(d: Dialect) -> str:
    """Payload fields by alias, side by trend, volatility and jump multipliers from the oscillator."""
    return f"""WITH {ALERTS} SELECT event_id, ticker, trend, tercile, CAST({d.json("props", "k")} AS BIGINT) AS k, CASE trend WHEN 'bullish' THEN 'long' WHEN 'bearish' THEN 'short' END AS side,
       round(greatest(0.5E0, least(2E0, 1 + 0.4E0 * greatest(-1E0, least(1E0, (rsi - 50) / 50)))), 6) AS vol_mult, round(least(2.5E0, 1 + 0.5E0 * abs(rsi - 50) / 50), 6) AS jump_mult FROM av"""


@plan
def latest_signal(d: Dialect) -> str:
    """The last alert of each ticker, its age at the end of the data and whether it is fresh (30 hours)."""
    return f"""WITH {ALERTS}, k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC, event_id DESC) AS rn FROM av), z AS (SELECT max(ts) AS now FROM av)
SELECT ticker, event_id, trend, tercile, round(({d.seconds("now")} - {d.seconds("ts")}) / 3600E0, 6) AS age_hours, {d.seconds("now")} - {d.seconds("ts")} <= 108000 AS fresh FROM k CROSS JOIN z WHERE rn = 1"""


#: Alerts name an instrument by their user; every sixth has none that was ever calibrated.
_NAMED = "CASE user_id % 6 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM' WHEN 3 THEN '4-NOT SPECIFIED' WHEN 4 THEN '5-LOW' ELSE 'NONE' END"


@plan
def signal_to_drift(d: Dialect) -> str:
    """Calibrated, shrunk drift by instrument and bucket of trend and oscillator; any miss is zero with its first reason."""
    return f"""WITH {ALERTS}, {FEATURES.lstrip()}, smp AS (SELECT ticker, bucket, t, fwd AS x FROM buck WHERE fwd IS NOT NULL), {_newey_west("smp", "ticker, bucket")},
tab AS (SELECT ticker, bucket, n, m, m / se AS ts, {_SHRINK} AS mu FROM smp_nw), known AS (SELECT DISTINCT ticker FROM tab),
k AS (SELECT av.event_id, {_NAMED} AS name, CASE WHEN av.trend IN ('bullish', 'bearish') THEN concat(av.trend, '_', av.tercile) END AS bucket FROM av JOIN events e ON av.event_id = e.event_id)
SELECT k.event_id, k.name, k.bucket, CASE WHEN k.bucket IS NULL THEN 'undefined bucket' WHEN known.ticker IS NULL THEN 'no calibration table' WHEN tab.n IS NULL THEN 'no usable samples' WHEN tab.mu = 0 THEN 'shrunk to zero' ELSE '' END AS reason,
       CASE WHEN tab.n IS NULL THEN 'none' ELSE 'calibration' END AS source, round(coalesce(tab.mu, 0E0), 8) AS mu, round(coalesce(252 / 5E0 * tab.mu, 0E0), 6) AS mu_annual, round(tab.ts, 5) AS t_stat
FROM k LEFT JOIN known ON known.ticker = k.name LEFT JOIN tab ON tab.ticker = k.name AND tab.bucket = k.bucket"""


@plan
def confluence(d: Dialect) -> str:
    """Charts by role, the first of each: a stance and an action, flat and when holding; gates in order, halvings stack.

    Alerts stand in for charts: the role by event_id, the confidence by the payload. Flat: missing charts, doubtful reads,
    differing symbols, a bearish week, then the day's timing. Holding keeps the position unless the week turns bearish
    or the day and the ratio both are.
    """
    role = "CASE event_id % 4 WHEN 0 THEN 'weekly' WHEN 1 THEN 'daily' WHEN 2 THEN 'ratio' ELSE 'hourly' END"
    pick = lambda r, c: f"max(CASE WHEN role = '{r}' THEN {c} END)"
    return f"""WITH {ALERTS}, r AS (SELECT ticker, {role} AS role, trend, rsi, 0.3E0 + 0.007E0 * rsi AS confidence, CASE WHEN event_id % 97 = 0 THEN 'OTHER' ELSE ticker END AS symbol, ts, event_id FROM av),
l AS (SELECT *, row_number() OVER (PARTITION BY ticker, role ORDER BY ts, event_id) AS k FROM r WHERE role <> 'hourly'),
p AS (SELECT ticker, {pick("weekly", "trend")} AS weekly, {pick("daily", "trend")} AS daily, {pick("ratio", "trend")} AS ratio, {pick("daily", "rsi")} AS rsi, {pick("weekly", "symbol")} AS ws, {pick("daily", "symbol")} AS ds, min(confidence) AS confidence
      FROM l WHERE k = 1 GROUP BY ticker),
g AS (SELECT *, weekly IS NULL OR daily IS NULL AS missing, coalesce(confidence, 0E0) < 0.45E0 AS doubtful FROM p),
s AS (SELECT *, CASE WHEN missing THEN 'INCOMPLETE' WHEN doubtful OR ws <> ds OR weekly = 'bearish' THEN 'NO_TRADE' WHEN daily <> 'bullish' THEN 'MIXED' ELSE 'ALIGNED_LONG' END AS stance,
      NOT missing AND NOT doubtful AND (ws = ticker OR ds = ticker) AND (weekly = 'bearish' OR daily = 'bearish' AND coalesce(ratio = 'bearish', false)) AS sell FROM g)
SELECT ticker, weekly, daily, ratio, round(confidence, 6) AS min_confidence, stance, CASE stance WHEN 'INCOMPLETE' THEN 'UPLOAD_MORE' WHEN 'NO_TRADE' THEN 'AVOID' WHEN 'MIXED' THEN 'WAIT' ELSE 'BUY' END AS action,
       CASE WHEN stance = 'ALIGNED_LONG' THEN (CASE WHEN weekly = 'neutral' THEN 0.5E0 ELSE 1E0 END) * (CASE WHEN rsi > 75 THEN 0.5E0 ELSE 1E0 END) * (CASE WHEN ratio = 'bearish' THEN 0.5E0 ELSE 1E0 END) ELSE 0E0 END AS size_multiplier,
       CASE WHEN sell THEN 'EXIT' ELSE 'HOLDING' END AS holding_stance, CASE WHEN sell THEN 'SELL' ELSE 'HOLD' END AS holding_action FROM s"""


@plan
def position_size(d: Dialect) -> str:
    """Shares under the risk budget and notional cap; conviction 2 cdf(z) - 1."""
    return f"""SELECT p_partkey, CAST(floor(least(100000 * 0.01E0 / (p_retailprice * 0.05E0), 100000 * 0.25E0 / p_retailprice)) AS BIGINT) AS shares,
       round(greatest(0E0, 2 * {d.cdf("((p_size - 25) / 12.5E0)")} - 1), 5) AS conviction FROM part"""


_LAST = 5
_HIT = [f"x{k} <= 0.98E0 * e" for k in range(1, _LAST + 1)]
_HELD = f"CASE {' '.join(f'WHEN {h} THEN {k}' for k, h in enumerate(_HIT, 1))} WHEN x{_LAST} IS NOT NULL THEN {_LAST} END"

#: Every order as a logged verdict: a long entry on the first close after the order date, held five bars with a stop.
#: An outcome depends on the entry's bar alone, so it is found once a bar, from the closes that follow it; orders take the bar that follows their date.
LOG = f"""{BARS},
lg AS (SELECT o_orderkey AS id, o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS d FROM orders),
days AS (SELECT ticker, d, max(t) AS t FROM (SELECT DISTINCT ticker, d, CAST(NULL AS INT) AS t FROM lg UNION ALL SELECT ticker, d, t FROM bars) u GROUP BY ticker, d),
st AS (SELECT ticker, d, min(t) OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS t FROM days),
ahead AS (SELECT ticker, t, close AS e, {", ".join(f"lead(close, {k}) OVER (PARTITION BY ticker ORDER BY t) AS x{k}" for k in range(1, _LAST + 1))} FROM bars),
hx AS (SELECT *, {_HELD} AS k FROM ahead),
fx AS (SELECT ticker, t, e, k, CASE k {" ".join(f"WHEN {k} THEN x{k}" for k in range(1, _LAST + 1))} END AS x FROM hx WHERE k IS NOT NULL),
settled AS (SELECT lg.id, fx.e, fx.x, fx.k, fx.x <= 0.98E0 * fx.e AS hit, fx.x / fx.e - 1 - 0.001E0 AS net FROM lg JOIN st ON st.ticker = lg.ticker AND st.d = lg.d JOIN fx ON fx.ticker = st.ticker AND fx.t = st.t)"""

#: The last twenty settled trades in log order.
_TAIL = "tl AS (SELECT avg(net) AS tail, sum(net) AS total FROM (SELECT net FROM settled ORDER BY id DESC LIMIT 20) z)"


@plan
def settle(d: Dialect) -> str:
    """Entry at the first close strictly after the signal date; realised exits by stop or holding limit."""
    return f"WITH {LOG} SELECT id, round(e, 6) AS entry, round(x, 6) AS exit, CAST(k AS INT) AS held, CASE WHEN hit THEN 'stop_loss' ELSE 'max_holding' END AS exit_reason, round(net, 8) AS net FROM settled"


@plan
def kill_switch(d: Dialect) -> str:
    """Hit rate and mean of the last twenty settled trades in log order, and the state that they give."""
    return f"""WITH {LOG}, {_TAIL}, r AS (SELECT count(*) AS n, avg(CASE WHEN net > 0 THEN 1E0 ELSE 0E0 END) AS hit FROM settled)
SELECT CAST(n AS BIGINT) AS n, round(hit, 6) AS hit_rate, round(tail, 8) AS trailing, total < 0 AND n >= 20 AS killed FROM r CROSS JOIN tl"""


@plan
def track_record(d: Dialect) -> str:
    """Realised against predicted by ticker: a trade's prediction is the record of trades that had ended twenty days before; the ratio of their means.

    ``trailing20`` is the mean of the ticker's last twenty. Nothing is predicted, and no ratio given, without an earlier trade.
    """
    w = f"OVER (PARTITION BY ticker ORDER BY {d.epoch_day('dy')} RANGE BETWEEN UNBOUNDED PRECEDING AND 20 PRECEDING)"
    return f"""WITH {LOG}, tr AS (SELECT s.id, lg.ticker, lg.d AS dy, s.net, CASE WHEN s.net > 0 THEN 1E0 ELSE 0E0 END AS win FROM settled s JOIN lg ON lg.id = s.id),
dl AS (SELECT ticker, dy, CAST(count(*) AS DOUBLE) AS n, sum(net) AS net, sum(win) AS win FROM tr GROUP BY ticker, dy),
pd AS (SELECT ticker, dy, n, net, win, sum(net) {w} / sum(n) {w} AS mu, sum(win) {w} / sum(n) {w} AS p FROM dl),
ls AS (SELECT ticker, avg(net) AS tail FROM (SELECT ticker, net, row_number() OVER (PARTITION BY ticker ORDER BY id DESC) AS k FROM tr) q WHERE k <= 20 GROUP BY ticker)
SELECT pd.ticker, CAST(sum(n) AS BIGINT) AS trades, round(sum(win) / sum(n), 6) AS hit_rate, round(sum(CASE WHEN p IS NOT NULL THEN p * n END) / sum(CASE WHEN p IS NOT NULL THEN n END), 6) AS predicted_p_win, round(sum(net) / sum(n), 8) AS mean_realized,
       round(sum(CASE WHEN mu IS NOT NULL THEN mu * n END) / sum(CASE WHEN mu IS NOT NULL THEN n END), 8) AS mean_predicted, round(sum(net) / sum(n) / nullif(sum(CASE WHEN mu IS NOT NULL THEN mu * n END) / sum(CASE WHEN mu IS NOT NULL THEN n END), 0E0), 5) AS calibration_ratio, round(max(tail), 8) AS trailing20
FROM pd JOIN ls ON ls.ticker = pd.ticker GROUP BY pd.ticker"""


@plan
def recent_verdicts(d: Dialect) -> str:
    """The last twelve settled trades, newest first."""
    return f"""WITH {LOG}, k AS (SELECT id, net, hit, k AS held FROM settled ORDER BY id DESC LIMIT 12)
SELECT CAST(row_number() OVER (ORDER BY id DESC) AS INT) AS place, id, round(net, 8) AS net, CASE WHEN hit THEN 'stop_loss' ELSE 'max_holding' END AS exit_reason, CAST(held AS INT) AS held FROM k"""


@plan
def snapshot(d: Dialect) -> str:
    """States of the monitored sections by rank good, info, warn, critical, with their figures, and the worst of them.

    The latest alert is stale after 30 hours; the record is critical once the last twenty settled trades lose on average;
    the calibration warns after 30 days. The time is the end of the alerts.
    """
    return f"""WITH {ALERTS}, {LOG.lstrip()},
now AS (SELECT max(ts) AS now FROM av), {_TAIL},
rec AS (SELECT n, hit, tail FROM (SELECT count(*) AS n, avg(CASE WHEN net > 0 THEN 1E0 ELSE 0E0 END) AS hit FROM settled) r CROSS JOIN tl),
sig AS (SELECT count(*) AS n, max(CASE WHEN trend <> 'neutral' THEN {d.seconds("ts")} END) AS seen FROM av), cal AS (SELECT max(d) AS d FROM bars),
s AS (
  SELECT 'signal' AS section, CASE WHEN n = 0 THEN 2 WHEN seen IS NULL OR {d.seconds("now.now")} - seen > 108000 THEN 2 ELSE 0 END AS level, ({d.seconds("now.now")} - seen) / 3600E0 AS figure FROM sig CROSS JOIN now
  UNION ALL SELECT 'record', CASE WHEN n >= 20 AND tail < 0 THEN 3 WHEN n = 0 THEN 1 ELSE 0 END, hit FROM rec
  UNION ALL SELECT 'calibration', CASE WHEN {d.seconds("now.now")} - {d.seconds("CAST(cal.d AS TIMESTAMP)")} > 2592000 THEN 2 ELSE 0 END, NULL FROM cal CROSS JOIN now)
SELECT section, CASE level WHEN 0 THEN 'good' WHEN 1 THEN 'info' WHEN 2 THEN 'warn' ELSE 'critical' END AS state, round(figure, 6) AS figure, CASE max(level) OVER () WHEN 0 THEN 'good' WHEN 1 THEN 'info' WHEN 2 THEN 'warn' ELSE 'critical' END AS worst FROM s"""


_WALK = f"""WITH RECURSIVE {ALERTS},
sq AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts, event_id) AS n FROM av),
walk AS (
  SELECT ticker, n, event_id, trend AS lt, tercile AS lr, ts AS lts, false AS dup FROM sq WHERE n = 1
  UNION ALL
  SELECT s.ticker, s.n, s.event_id, CASE WHEN q.dup THEN w.lt ELSE s.trend END, CASE WHEN q.dup THEN w.lr ELSE s.tercile END, CASE WHEN q.dup THEN w.lts ELSE s.ts END, q.dup
  FROM walk w JOIN sq s ON s.ticker = w.ticker AND s.n = w.n + 1
  CROSS JOIN LATERAL (SELECT s.trend = w.lt AND s.tercile = w.lr AND abs(epoch(s.ts) - epoch(w.lts)) <= 600 AS dup) q)
SELECT event_id, ticker, dup AS duplicate FROM walk"""


@query(_WALK)
def dedupe_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts equal to the stored latest of their ticker within 600 seconds; a duplicate does not move the stored one."""
    views(spark, sf_dir)
    return dedupe(spark.sql(f"WITH {ALERTS} SELECT event_id, ts, ticker, trend, tercile FROM av"))
