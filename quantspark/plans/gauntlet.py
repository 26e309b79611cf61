"""Go/no-go gates over chances that a labelled signal profits, with variants of the labels as rows, and live decisions.

A signal is a change of trend. Its label is the trade that enters at the next open and ends at a barrier or after the holding
time. Variants of the barriers are rows of a relation, so one plan labels all of them. Chances are always out of sample. The
text of the gates reads one relation ``chances``, whichever model made them.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import DUCK, SPARK, Dialect
from ..operators.meta_label import apply_models, final_models, meta_labels
from ..registry import oracle, plan, query
from ..sources.records import Records, config_hash
from ..sources.scratch import stored
from ..sources.tables import BARS, views
from .signals import FEATURES, FLIPS

EULER_GAMMA = 0.5772156649015329
FEATURE_NAMES = ("ret_1", "ret_2", "ret_3", "vol_20", "atr_ratio", "ma50_dist", "regime", "dow", "dir_long")
#: A comparison of two settings' ratios reads so many digits: settings with the same trades tie, in whatever order they are summed.
DIGITS = 9


@dataclass(frozen=True)
class Gauntlet:
    """Settings of labels, model, validation and risk. The defaults."""

    k_pt: float = 1.5
    k_sl: float = 1.5
    max_hold: int = 10
    vol_window: int = 60
    cost: float = 0.0005
    threshold: float = 0.60
    sweep: tuple[float, ...] = (0.55, 0.575, 0.60, 0.625, 0.65)
    sizer: str = "B1"
    least: int = 100
    holdout: float = 0.20
    blocks: int = 8
    tolerance: float = 0.70
    bump: float = 0.20
    least_weeks: int = 8
    most_overfit: float = 0.15
    equity: float = 10_000.0
    risk: float = 0.01
    most_position: float = 0.10

    def check(self) -> Gauntlet:
        if self.blocks % 2 or self.blocks < 2 or not 0 < self.holdout < 1 or self.max_hold < 1 or self.sizer not in ("A4", "B1") or not self.sweep:
            raise ValueError("blocks must be even, holdout a fraction, max_hold positive, sizer A4 or B1, and the sweep not empty")
        return self

    @property
    def grid(self) -> list[tuple[str, float]]:
        return [(s, t) for s in ("A4", "B1") for t in self.sweep]

    def variants(self) -> list[tuple[int, float, float, int]]:
        """(variant, k_pt, k_sl, max_hold): 0 is the setting itself, the others move one of them by the bump."""
        out = [self]
        for m in (1 - self.bump, 1 + self.bump):
            out += [replace(self, k_pt=self.k_pt * m), replace(self, k_sl=self.k_sl * m), replace(self, max_hold=max(2, round(self.max_hold * m)))]
        return [(i, g.k_pt, g.k_sl, g.max_hold) for i, g in enumerate(out)]


def settings(g: Gauntlet) -> dict:
    """What the hash of a configuration is taken of."""
    return {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(g).items()}


def _rows(rows, names: str) -> str:
    cell = lambda v: f"'{v}'" if isinstance(v, str) else f"{v!r}E0" if isinstance(v, float) else str(v)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) v({names}))"


def labelled(g: Gauntlet, variants) -> str:
    """Relation ``labels(variant, ticker, t, d, side, dir, sigma, entry, exit_t, net, label)`` of every change of trend.

    The stop wins a bar that touches both barriers; without a touch the trade ends at the close ``max_hold`` bars after entry,
    or at the last bar. Returns are net of costs at both ends.
    """
    goal, stop = "e * (1 + dir * k_pt * w)", "e * (1 - dir * k_sl * w)"
    return f"""{FLIPS},
vr AS {_rows(variants, "variant, k_pt, k_sl, hold")},
vol AS (SELECT ticker, t, CASE WHEN t > {g.vol_window} THEN stddev_pop(r) OVER (PARTITION BY ticker ORDER BY t ROWS BETWEEN {g.vol_window - 1} PRECEDING AND CURRENT ROW) END AS sigma, max(t) OVER (PARTITION BY ticker) AS z FROM rets),
sg AS (SELECT f.ticker, f.t AS t0, f.d, CASE WHEN f.up THEN 1 ELSE -1 END AS dir, vol.sigma, vol.z, o.open AS e FROM flips f JOIN vol ON vol.ticker = f.ticker AND vol.t = f.t JOIN ohlc o ON o.ticker = f.ticker AND o.t = f.t + 1 WHERE vol.sigma > 0),
sv AS (SELECT sg.*, variant, k_pt, k_sl, sigma * sqrt(CAST(hold AS DOUBLE)) AS w, least(t0 + 1 + hold, z) AS last FROM sg CROSS JOIN vr),
bb AS (SELECT sv.*, o.t, o.close, CASE WHEN dir = 1 THEN o.low <= {stop} ELSE o.high >= {stop} END AS stopped, CASE WHEN dir = 1 THEN o.high >= {goal} ELSE o.low <= {goal} END AS reached FROM sv JOIN ohlc o ON o.ticker = sv.ticker AND o.t BETWEEN sv.t0 + 1 AND sv.last),
bx AS (SELECT *, row_number() OVER (PARTITION BY variant, ticker, t0 ORDER BY t) AS k FROM bb WHERE stopped OR reached OR t = last),
nt AS (SELECT *, (1 + dir * (CASE WHEN stopped THEN {stop} WHEN reached THEN {goal} ELSE close END / e - 1)) * (1 - {g.cost!r}E0) * (1 - {g.cost!r}E0) - 1 AS net FROM bx WHERE k = 1),
labels AS (SELECT variant, ticker, t0 AS t, d, CASE dir WHEN 1 THEN 'long' ELSE 'short' END AS side, dir, sigma, e AS entry, t AS exit_t, net, CASE WHEN net > 0 THEN 1 ELSE 0 END AS label FROM nt)"""


def features(d: Dialect) -> str:
    """Relation ``fm(ticker, t, <FEATURE_NAMES but the last>)``: what was known at the close of a bar, from the 211th on."""
    dow = "weekday(q.d)" if d.name == "spark" else "(isodow(q.d) - 1)"
    o = "(PARTITION BY {}ticker ORDER BY {}t ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
    own = "PARTITION BY ticker ORDER BY t"
    return f"""tr AS (SELECT ticker, t, d, close, greatest(high - low, abs(high - lag(close) OVER ({own})), abs(low - lag(close) OVER ({own}))) AS tr FROM ohlc),
fq AS (SELECT q.ticker, q.t, q.close / lag(q.close, 1) OVER w - 1 AS ret_1, q.close / lag(q.close, 2) OVER w - 1 AS ret_2, q.close / lag(q.close, 3) OVER w - 1 AS ret_3, stddev_pop(r.r) OVER {o.format("q.", "q.", 19)} AS vol_20,
       avg(q.tr) OVER {o.format("q.", "q.", 13)} / q.close AS atr_ratio, q.close / avg(q.close) OVER {o.format("q.", "q.", 49)} - 1 AS ma50_dist,
       CASE WHEN avg(q.close) OVER {o.format("q.", "q.", 49)} > avg(q.close) OVER {o.format("q.", "q.", 199)} THEN 1E0 ELSE 0E0 END AS regime, CAST({dow} AS DOUBLE) AS dow
       FROM tr q JOIN rets r ON r.ticker = q.ticker AND r.t = q.t WINDOW w AS (PARTITION BY q.ticker ORDER BY q.t)),
fm AS (SELECT * FROM fq WHERE t > 210)"""


def frequencies(d: Dialect) -> str:
    """Relation ``chances``: a signal's chance is the smoothed share of profits among recent signals of its side and regime.

    Recent means 21 days ago at least, when their trades have ended, and 250 at most; five of them are needed.
    """
    w = "OVER (PARTITION BY l.variant, l.side, f.regime ORDER BY {0} RANGE BETWEEN 250 PRECEDING AND 21 PRECEDING)".format(d.epoch_day("l.d"))
    return f"""chances AS (SELECT variant, ticker, t, d, side, sigma, entry, net, label, CASE WHEN n >= 5 THEN (hits + 1E0) / (n + 2) END AS p
FROM (SELECT l.*, count(*) {w} AS n, coalesce(sum(l.label) {w}, 0) AS hits FROM labels l JOIN fm f ON f.ticker = l.ticker AND f.t = l.t) q)"""


def _multiple(d: Dialect, sizer: str, p: str, threshold: str) -> str:
    z = f"(({p} - 0.5E0) / sqrt({p} * (1 - {p})))"
    bet = f"CASE WHEN {p} >= 1 THEN 1E0 WHEN {p} <= greatest(0.5E0, {threshold} - 1E-12) THEN 0E0 ELSE 2 * {d.cdf(z)} - 1 END"
    return f"(CASE WHEN {sizer} = 'B1' THEN {bet} WHEN {p} > {threshold} THEN 1E0 ELSE 0E0 END)"


def gates(d: Dialect, g: Gauntlet, trials: int) -> dict[str, str]:
    """Relations by name, in order, that end in ``gate(gate, value, pass)``, from ``chances``.

    1 costs are modelled; 2 the Sharpe ratio is positive, and above the best that ``trials`` of noise would show; 3 the chance that
    the in-sample winner of the grid is in the lower half out of sample; 4 the ratio holds under moved thresholds and relabelled
    variants; 5 it beats the unfiltered signals; 6 it is positive on the last part of the signals, which no other gate reads.
    """
    ratio = lambda n, s, q: f"CASE WHEN {n} >= {g.least_weeks} AND ({q} - {s} * {s} / {n}) / ({n} - 1) > 1E-18 THEN {s} / {n} / sqrt(({q} - {s} * {s} / {n}) / ({n} - 1)) END"
    of = lambda x: ratio(f"count({x})", f"sum({x})", f"sum({x} * {x})")
    grid = [(i, s, t) for i, (s, t) in enumerate(g.grid)]
    runs = [(0, 0, g.sizer, g.threshold), (1, 0, g.sizer, g.threshold * (1 - g.bump)), (2, 0, g.sizer, g.threshold * (1 + g.bump))]
    runs += [(2 + v[0], v[0], g.sizer, g.threshold) for v in g.variants()[1:]]
    halves = [(i, b) for i, c in enumerate(combinations(range(g.blocks), g.blocks // 2)) for b in c]
    week = "CAST(date_trunc('week', {}) AS DATE)".format
    best = f"((1 - {EULER_GAMMA!r}E0) * {d.ppf(f'CAST({1 - 1 / trials!r} AS DOUBLE)')} + {EULER_GAMMA!r}E0 * {d.ppf(f'CAST({1 - 1 / (trials * 2.718281828459045)!r} AS DOUBLE)')})" if trials > 1 else "0E0"
    return {
        "sp": f"""(SELECT d AS split FROM (SELECT d, row_number() OVER (ORDER BY d, ticker) AS k, count(*) OVER () AS n FROM chances WHERE variant = 0) q WHERE k = CAST(floor(n * {1 - g.holdout!r}E0) AS BIGINT) + 1)""",
        "cw": f"""(SELECT c.variant, c.side, c.net, c.p, c.d >= sp.split AS late, {week("c.d")} AS wk FROM chances c CROSS JOIN sp WHERE c.p IS NOT NULL)""",
        "rn": f"""{_rows(runs, "run, variant, sizer, th")}""",
        "wr": f"""(SELECT rn.run, cw.late, cw.wk, avg({_multiple(d, "rn.sizer", "cw.p", "rn.th")} * net) AS r FROM cw JOIN rn ON rn.variant = cw.variant WHERE cw.side = 'long' AND {_multiple(d, "rn.sizer", "cw.p", "rn.th")} > 0 GROUP BY rn.run, cw.late, cw.wk)""",
        "sr": f"""(SELECT run, late, {of("r")} AS sr FROM wr GROUP BY run, late)""",
        "raw": f"""(SELECT {of("r")} AS sr FROM (SELECT wk, avg(net) AS r FROM cw WHERE variant = 0 AND side = 'long' AND NOT late GROUP BY wk) q)""",
        "base": f"""(SELECT count(r) AS n, avg(r) AS m, stddev_samp(r) AS sd, {of("r")} AS sr FROM wr WHERE run = 0 AND NOT late)""",
        "mo": f"""(SELECT avg(pow((r - m) / sd, 3)) AS sk, avg(pow((r - m) / sd, 4)) AS ku FROM wr CROSS JOIN base WHERE run = 0 AND NOT late)""",
        "gr": f"""{_rows(grid, "cfg, sizer, th")}""",
        "cal": f"""(SELECT wk, CAST(ntile({g.blocks}) OVER (ORDER BY wk) - 1 AS INT) AS blk, count(*) OVER () AS weeks FROM (SELECT DISTINCT wk FROM cw WHERE variant = 0 AND NOT late) q)""",
        "gw": f"""(SELECT gr.cfg, cw.wk, avg({_multiple(d, "gr.sizer", "cw.p", "gr.th")} * net) AS r FROM cw CROSS JOIN gr WHERE variant = 0 AND NOT late AND side = 'long' AND {_multiple(d, "gr.sizer", "cw.p", "gr.th")} > 0 GROUP BY gr.cfg, cw.wk)""",
        "sz": f"""(SELECT blk, count(*) AS n, max(weeks) AS weeks FROM cal GROUP BY blk)""",
        "bs": f"""(SELECT gw.cfg, cal.blk, sum(r) AS s, sum(r * r) AS q FROM gw JOIN cal ON cal.wk = gw.wk GROUP BY gw.cfg, cal.blk)""",
        "gb": f"""(SELECT gr.cfg, sz.blk, CAST(sz.n AS DOUBLE) AS n, coalesce(bs.s, 0E0) AS s, coalesce(bs.q, 0E0) AS q FROM gr CROSS JOIN sz LEFT JOIN bs ON bs.cfg = gr.cfg AND bs.blk = sz.blk)""",
        "al": f"""(SELECT cfg, {ratio("sum(n)", "sum(s)", "sum(q)")} AS sr, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM gb GROUP BY cfg)""",
        "tv": f"""(SELECT count(sr) AS k, coalesce(var_pop(sr), 0E0) AS v FROM al)""",
        "hv": f"""{_rows(halves, "cb, blk")}""",
        "hs": f"""(SELECT hv.cb, gb.cfg, sum(gb.n) AS n, sum(gb.s) AS s, sum(gb.q) AS q FROM gb JOIN hv ON hv.blk = gb.blk GROUP BY hv.cb, gb.cfg)""",
        "io": f"""(SELECT hs.cb, hs.cfg, round({ratio("hs.n", "hs.s", "hs.q")}, {DIGITS}) AS a, round({ratio("(al.n - hs.n)", "(al.s - hs.s)", "(al.q - hs.q)")}, {DIGITS}) AS o FROM hs JOIN al ON al.cfg = hs.cfg)""",
        "wn": f"""(SELECT cb, o, row_number() OVER (PARTITION BY cb ORDER BY a DESC, cfg) AS k FROM io WHERE a IS NOT NULL)""",
        "rk": f"""(SELECT wn.cb, avg(CASE WHEN wn.o >= io.o THEN 1E0 ELSE 0E0 END) AS rank, count(*) AS k FROM wn JOIN io ON io.cb = wn.cb WHERE wn.k = 1 AND wn.o IS NOT NULL AND io.o IS NOT NULL GROUP BY wn.cb)""",
        "pb": f"""(SELECT CASE WHEN (SELECT max(weeks) FROM sz) >= {2 * g.blocks} THEN avg(CASE WHEN rank < 0.5E0 THEN 1E0 ELSE 0E0 END) END AS pbo FROM rk WHERE k >= 2)""",
        "ds": f"""(SELECT sr, sr - sqrt(CASE WHEN tv.k >= 2 AND tv.v > 0 THEN tv.v ELSE 1E0 / greatest(n - 1, 1) END) * {best} AS excess FROM base CROSS JOIN tv)""",
        "dz": f"""(SELECT ds.sr, excess, {d.cdf("q.z")} AS dsr FROM ds CROSS JOIN (SELECT excess * sqrt(CAST(greatest(n - 1, 1) AS DOUBLE)) / sqrt(greatest(1E-12, 1 - sk * base.sr + (ku - 1) / 4 * base.sr * base.sr)) AS z FROM ds CROSS JOIN base CROSS JOIN mo) q)""",
        "pl": f"""(SELECT min(CASE WHEN base.sr > 0 AND (sr.sr IS NULL OR sr.sr < {g.tolerance!r}E0 * base.sr) THEN 0 ELSE 1 END) AS ok, count(*) AS k, min(sr.sr) AS worst FROM base CROSS JOIN rn LEFT JOIN sr ON sr.run = rn.run AND NOT sr.late WHERE rn.run > 0)""",
        "gate": f"""(SELECT '1_costs' AS gate, {g.cost!r}E0 AS value, {"true" if g.cost >= 0.0005 else "false"} AS pass
  UNION ALL SELECT '2_sharpe', dsr, sr > 0 AND excess > 0 FROM dz
  UNION ALL SELECT '3_pbo', pbo, pbo < {g.most_overfit!r}E0 FROM pb
  UNION ALL SELECT '4_plateau', worst, ok = 1 AND base.sr IS NOT NULL FROM pl CROSS JOIN base
  UNION ALL SELECT '5_beats_raw', base.sr - raw.sr, base.sr IS NOT NULL AND (raw.sr IS NULL OR base.sr > raw.sr) FROM base CROSS JOIN raw
  UNION ALL SELECT '6_holdout', (SELECT max(sr) FROM sr WHERE run = 0 AND late), (SELECT max(sr) FROM sr WHERE run = 0 AND late) > 0)""",
    }


def _with(relations: dict[str, str]) -> str:
    return ", ".join(f"{name} AS {text}" for name, text in relations.items())


_REPORT = "SELECT gate, round(value, 6) AS value, coalesce(pass, false) AS pass, min(CASE WHEN pass THEN 1 ELSE 0 END) OVER () = 1 AS ready FROM gate"


def _by_frequency(d: Dialect, g: Gauntlet) -> str:
    return f"WITH {FEATURES}, {labelled(g, g.variants())}, {features(d)}, {frequencies(d)}"


@query(oracle(f"{_by_frequency(DUCK, Gauntlet())}, {_with(gates(DUCK, Gauntlet(), len(Gauntlet().grid)))} {_REPORT}"))
def gauntlet_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six gates over chances by frequency, the grid's ten settings counted as trials."""
    views(spark, sf_dir)
    return run_gates(spark.sql(f"{_by_frequency(SPARK, Gauntlet())} SELECT * FROM chances"))


@plan
def label_variants(d: Dialect) -> str:
    """Barrier labels of every signal under the setting and its six variants, as rows of one plan."""
    g = Gauntlet()
    return f"WITH {FEATURES}, {labelled(g, g.variants())} SELECT variant, ticker, t, d, side, round(entry, 6) AS entry, exit_t, round(net, 8) AS net, label FROM labels"


@plan
def signal_features(d: Dialect) -> str:
    """The nine features of every signal, from what its bar's close had shown."""
    names = ", ".join(f"round({n}, 8) AS {n}" for n in FEATURE_NAMES[:-1])
    return f"WITH {FEATURES}, {FLIPS}, {features(d)} SELECT f.ticker, f.t, {names}, CASE WHEN f.up THEN 1E0 ELSE 0E0 END AS dir_long FROM fm JOIN flips f ON f.ticker = fm.ticker AND f.t = fm.t"


def model_chances(spark: SparkSession, g: Gauntlet, pooled: bool = False) -> DataFrame:
    """``chances`` by the purged meta-label model, fitted for every variant and ticker apart; null before the first fold.

    ``pooled`` fits one model a variant over the signals of all tickers by date, for tickers with few signals.
    """
    names = ", ".join(f"f.{n}" for n in FEATURE_NAMES[:-1])
    rows = stored(spark.sql(f"WITH {FEATURES}, {labelled(g, g.variants())}, {features(SPARK)} SELECT l.*, {SPARK.epoch_day('l.d')} AS day, {names}, CASE l.side WHEN 'long' THEN 1E0 ELSE 0E0 END AS dir_long FROM labels l JOIN fm f ON f.ticker = l.ticker AND f.t = l.t"), "signals")
    group = F.concat_ws(":", "variant", *([] if pooled else ["ticker"]))
    p = meta_labels(rows.withColumn("model", group), list(FEATURE_NAMES), "model", *(("day", 21) if pooled else ("t",))).drop("label", "fold")
    return rows.withColumn("model", group).join(p, ["model", "ticker", "t"], "left").select("variant", "ticker", "t", "d", "side", "sigma", "entry", "net", "label", "p")


def run_gates(chances: DataFrame, g: Gauntlet | None = None, trials: int | None = None, report: str = _REPORT) -> DataFrame:
    """``(gate, value, pass, ready)`` of any relation of chances."""
    g = (g or Gauntlet()).check()
    spark, relations = chances.sparkSession, gates(SPARK, g, trials or len(g.grid))
    given = {"chances": stored(chances, "chances")}
    for name in ("cw", "wr", "gb"):  # what several relations read is computed once
        names = list(relations)
        own = {n: relations.pop(n) for n in names[: names.index(name) + 1]}
        given[name] = stored(spark.sql(f"WITH {_given(given)}, {_with(own)} SELECT * FROM {name}", **given), name)
        relations = {n: t for n, t in own.items() if n not in given} | relations
    return spark.sql(f"WITH {_given(given)}, {_with(relations)} {report}", **given)


def _given(relations: dict[str, DataFrame]) -> str:
    return ", ".join(f"{name} AS (SELECT * FROM {{{name}}})" for name in relations)


@query()
def gauntlet_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six gates over the meta-label model's chances; no SQL fits that model, so tests hold it against a plain version."""
    views(spark, sf_dir)
    return run_gates(model_chances(spark, Gauntlet(), pooled=True))


def decisions(d: Dialect, g: Gauntlet, ready: str) -> str:
    """Relation ``decided``, from ``alerts(ticker, t, side, price, sigma, p, n)``: verdict, reason, stop, size of each alert.

    ``n`` counts the labelled signals known to the model; ``ready`` is the gauntlet's verdict. A short is recorded only.
    """
    mult = _multiple(d, f"'{g.sizer}'", "p", f"{g.threshold!r}E0")
    stop = f"price * (1 - {g.k_sl!r}E0 * sigma * sqrt({float(g.max_hold)!r}E0))"
    return f"""dm AS (SELECT *, {stop} AS stop, {mult} AS mult FROM alerts),
dw AS (SELECT *, {g.equity * g.risk!r}E0 / (price - stop) * mult AS want, {g.equity * g.most_position!r}E0 / price AS cap, {g.equity!r}E0 / price AS power FROM dm),
dp AS (SELECT *, CASE WHEN mult > 0 AND price > stop THEN greatest(0E0, least(want, cap, power)) ELSE 0E0 END AS shares, CASE WHEN mult > 0 AND price > stop THEN CASE WHEN least(want, cap) > power THEN 'buying_power' WHEN want > cap THEN 'position_pct' ELSE 'none' END ELSE 'none' END AS capped_by FROM dw),
dr AS (SELECT *, CASE WHEN side = 'short' THEN 'short signal: recorded only' WHEN n < {g.least} THEN 'insufficient labelled history' WHEN p IS NULL THEN 'no chance: warm-up or one class' WHEN p <= {g.threshold!r}E0 THEN 'chance below the threshold' WHEN shares < 1 THEN 'sized to zero shares' END AS reason FROM dp),
decided AS (SELECT ticker, t, side, CASE WHEN reason IS NULL THEN 'TRADE' ELSE 'NO_TRADE' END AS verdict, coalesce(reason, 'chance above the threshold') AS reason, p, price AS s0, CASE WHEN side = 'long' THEN stop END AS stop_price,
  CASE WHEN side = 'long' THEN floor(shares) ELSE 0E0 END AS shares, CASE WHEN side = 'long' THEN mult END AS multiplier, CASE WHEN side = 'long' THEN capped_by ELSE 'none' END AS capped_by, {g.max_hold} AS horizon_days, 'next_session_open' AS entry_rule, {ready} AS gauntlet_pass FROM dr)"""


_DECIDED = "SELECT ticker, t, side, verdict, reason, round(p, 6) AS p, round(s0, 6) AS s0, round(stop_price, 6) AS stop_price, CAST(shares AS BIGINT) AS shares, round(multiplier, 6) AS multiplier, capped_by, horizon_days, entry_rule, gauntlet_pass FROM decided"


def _alerts(d: Dialect) -> str:
    known = "OVER (PARTITION BY variant ORDER BY {0} RANGE BETWEEN UNBOUNDED PRECEDING AND 21 PRECEDING)".format(d.epoch_day("d"))
    return f"""ready AS (SELECT min(CASE WHEN pass THEN 1 ELSE 0 END) = 1 AS ready FROM gate),
alerts AS (SELECT c.ticker, c.t, c.side, b.close AS price, c.sigma, c.p, c.n FROM (SELECT *, count(*) {known} AS n FROM chances WHERE variant = 0) c JOIN bars b ON b.ticker = c.ticker AND b.t = c.t),
{decisions(d, Gauntlet(), "(SELECT ready FROM ready)")} {_DECIDED}"""


@query(oracle(f"{_by_frequency(DUCK, Gauntlet())}, {_with(gates(DUCK, Gauntlet(), len(Gauntlet().grid)))}, {_alerts(DUCK)}"))
def live_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every signal as if it had just arrived: its chance rests on trades that had ended by then."""
    views(spark, sf_dir)
    chances = stored(spark.sql(f"{_by_frequency(SPARK, Gauntlet())} SELECT * FROM chances"), "chances")
    passed = stored(run_gates(chances, report="SELECT * FROM gate"), "gate")
    return spark.sql(f"WITH {BARS}, chances AS (SELECT * FROM {{chances}}), gate AS (SELECT * FROM {{gate}}), {_alerts(SPARK)}", chances=chances, gate=passed)


@query()
def live_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chances of the last fifth of the signals, by models fitted on those that had ended before it and applied as expressions."""
    views(spark, sf_dir)
    g = Gauntlet()
    names = ", ".join(f"f.{n}" for n in FEATURE_NAMES[:-1])
    rows = stored(spark.sql(f"""WITH {FEATURES}, {labelled(g, g.variants()[:1])}, {features(SPARK)}, x AS (SELECT l.ticker, l.t, l.d, l.label, {names}, CASE l.side WHEN 'long' THEN 1E0 ELSE 0E0 END AS dir_long, l.side FROM labels l JOIN fm f ON f.ticker = l.ticker AND f.t = l.t),
c AS (SELECT percentile(unix_date(d), 0.8E0) AS cut FROM x) SELECT x.*, unix_date(d) >= cut AS late, unix_date(d) < cut - 21 AS ended FROM x CROSS JOIN c"""), "signals")
    models = final_models(rows.where("ended"), list(FEATURE_NAMES), "side")
    return apply_models(rows.where("late"), models, list(FEATURE_NAMES), "side").select("ticker", "t", "side", "label", F.round("p", 8).alias("p"))


def run_gauntlet(spark: SparkSession, chances: DataFrame, records: Records, g: Gauntlet | None = None, holdout: bool = False) -> tuple[dict, dict]:
    """Run the gates with trials counted over all runs, store the report, and certify it: ``(report, certificate)``.

    The holdout is read at one run only, ever; without ``holdout`` its gate stays open, and nothing is ready.
    """
    g = (g or Gauntlet()).check()
    if holdout:
        records.open_holdout(settings(g))
    trials = records.add_trials(len(g.grid), settings(g), f"grid of {len(g.grid)}")
    found = {r.gate: {"value": r.value, "pass": r["pass"]} for r in run_gates(chances, g, trials).collect()}
    if not holdout:
        found["6_holdout"] = {"value": None, "pass": None}
    universe = [r.ticker for r in chances.select("ticker").distinct().orderBy("ticker").collect()]
    report = {"config": config_hash(settings(g)), "universe": universe, "trials": trials, "gates": found, "ready": all(v["pass"] is True for v in found.values())}
    return report, records.save_report(report)
