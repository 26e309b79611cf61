"""Meta-labels out of sample: purged expanding folds, logistic regression on standardised features, calibrated by folds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDS, EMBARGO, LEAST, ISOTONIC_FROM = 6, 10, 60, 100


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Newton's method; the last weight is the intercept, which has no penalty."""
    a = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(a.shape[1]), np.r_[np.full(x.shape[1], ridge), 0.0]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        step = np.linalg.lstsq((a.T * (p * (1 - p))) @ a + np.diag(penalty + 1e-10), a.T @ (p - y) + penalty * w, rcond=None)[0]
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of the non-decreasing fit, read between knots by interpolation."""
    at, inverse, count = np.unique(score, return_inverse=True, return_counts=True)
    mean = np.bincount(inverse, y) / count
    pools: list[list[float]] = []  # mean, weight, points
    for m, w in zip(mean, count, strict=True):
        pools.append([m, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            m2, w2, n2 = pools.pop()
            m1, w1, n1 = pools[-1]
            pools[-1] = [(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return at, np.repeat([p[0] for p in pools], [int(p[2]) for p in pools])


def fit(x: np.ndarray, y: np.ndarray, parts: int = 3) -> list[dict]:
    """``parts`` logistic models, each calibrated on the part it has not seen: knots of an isotonic fit, or a sigmoid below 100 rows."""
    part = np.empty(len(y), int)
    for label in (0, 1):  # each part takes a run of each class
        rows = np.flatnonzero(y == label)
        part[rows] = np.arange(len(rows)) * parts // max(1, len(rows))
    found = []
    for k in range(parts):
        own, rest = part != k, part == k
        if len(np.unique(y[own])) < 2 or not rest.any():
            continue
        mean, sd = x[own].mean(axis=0), x[own].std(axis=0)
        sd[sd == 0] = 1
        w = logistic((x[own] - mean) / sd, y[own])
        model = {"mean": mean, "sd": sd, "weight": w[:-1], "intercept": w[-1], "knots": np.zeros(0), "values": np.zeros(0), "slope": 0.0, "shift": 0.0}
        score = (x[rest] - mean) / sd @ w[:-1] + w[-1]
        if len(y) >= ISOTONIC_FROM:
            model["knots"], model["values"] = isotonic(score, y[rest])
        else:
            up, down = (y[rest] == 1).sum(), (y[rest] == 0).sum()
            model["slope"], model["shift"] = logistic(score[:, None], np.where(y[rest] == 1, (up + 1) / (up + 2), 1 / (down + 2)), ridge=0.0)
        found.append(model)
    return found


def chance(models: list[dict], x: np.ndarray) -> np.ndarray:
    """The mean of the models' calibrated chances."""
    out = []
    for m in models:
        score = (x - m["mean"]) / m["sd"] @ m["weight"] + m["intercept"]
        out.append(np.interp(score, m["knots"], m["values"]) if len(m["knots"]) else 1 / (1 + np.exp(-np.clip(score * m["slope"] + m["shift"], -35, 35))))
    return np.mean(out, axis=0)


def calibrated(x: np.ndarray, y: np.ndarray, new: np.ndarray, parts: int = 3) -> np.ndarray:
    models = fit(x, y, parts)
    return chance(models, new) if models else np.full(len(new), y.mean())


def walk_forward(x: np.ndarray, y: np.ndarray, bar: np.ndarray, embargo: int = EMBARGO) -> tuple[np.ndarray, np.ndarray]:
    """Chances out of sample and the fold of each row (null chance, fold -1 outside); rows are in the order of ``bar``."""
    p, fold = np.full(len(y), np.nan), np.full(len(y), -1)
    if len(y) < LEAST + 10:
        return p, fold
    bounds = np.linspace(LEAST, len(y), FOLDS + 1).astype(int)
    for k in range(FOLDS):
        lo, hi = bounds[k], bounds[k + 1]
        known = np.flatnonzero(bar[:lo] <= bar[lo] - embargo) if hi > lo else []
        if len(known) >= LEAST and len(np.unique(y[known])) == 2:
            p[lo:hi], fold[lo:hi] = calibrated(x[known], y[known], x[lo:hi]), k
    return p, fold


def auc(y: np.ndarray, p: np.ndarray) -> float | None:
    """Chance that a positive row ranks above a negative one; ties count half."""
    up = int(y.sum())
    if not 0 < up < len(y):
        return None
    rank = pd.Series(p).rank().to_numpy()
    return float((rank[y == 1].sum() - up * (up + 1) / 2) / (up * (len(y) - up)))


def meta_labels(rows: DataFrame, features: list[str], group: str = "ticker", order: str = "t", embargo: int = EMBARGO) -> DataFrame:
    """``rows(ticker, t, label, features)`` -> ``(ticker, t, label, fold, p)`` out of sample; rows with a null feature are left out.

    One model is fitted for each value of ``group`` (kept in the result), over rows in the order of ``order``, and then of ticker and t;
    ``embargo`` is in units of ``order``.
    """
    more = [group] if group != "ticker" else []
    kind = dict(rows.dtypes)[group]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([order, "ticker", "t"], kind="stable", ignore_index=True)
        y = pdf["label"].to_numpy(int)
        p, fold = walk_forward(pdf[features].to_numpy(float), y, pdf[order].to_numpy(), embargo)
        out = pd.DataFrame({c: pdf[c] for c in more} | {"ticker": pdf["ticker"], "t": pdf["t"], "label": y, "fold": fold, "p": p})
        return out[fold >= 0]

    known = rows.select(*dict.fromkeys([*more, "ticker", "t", order, "label", *features])).dropna()
    return known.groupBy(group).applyInPandas(run, f"{group} {kind}, ticker string, t int, label int, fold int, p double" if more else "ticker string, t int, label int, fold int, p double")


_PART = "struct<mean:array<double>,sd:array<double>,weight:array<double>,intercept:double,knots:array<double>,values:array<double>,slope:double,shift:double>"


class ModelChanged(ValueError):
    """A stored model differs from what was stored."""


def _seal(group: str) -> Column:
    return F.sha2(F.to_json(F.struct(group, "n", "features", "models")), 256)


def final_models(rows: DataFrame, features: list[str], group: str = "ticker") -> DataFrame:
    """``(group, n, features, models, seal)``: a model a group over all its rows, for decisions to come; groups of one class have none.

    ``seal`` is the hash of the row, which ``load_models`` checks.
    """
    kind = dict(rows.dtypes)[group]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", *features], kind="stable", ignore_index=True)
        models = fit(pdf[features].to_numpy(float), pdf["label"].to_numpy(int))
        plain = [{k: v.tolist() if isinstance(v, np.ndarray) else float(v) for k, v in m.items()} for m in models]
        return pd.DataFrame({group: [pdf[group][0]], "n": [len(pdf)], "features": [features], "models": [plain]})[: len(plain)]

    known = rows.select(*dict.fromkeys([group, "t", "label", *features])).dropna()
    out = known.groupBy(group).applyInPandas(run, f"{group} {kind}, n long, features array<string>, models array<{_PART}>")
    return out.withColumn("seal", _seal(group))


def load_models(spark: SparkSession, path: str, group: str = "ticker") -> DataFrame:
    """Models as ``final_models(...).write.parquet(path)`` stored them; ModelChanged if a row does not match its seal."""
    models = spark.read.parquet(path)
    if models.where(~_seal(group).eqNullSafe(F.col("seal"))).limit(1).count():
        raise ModelChanged(f"a model in {path} does not match its seal")
    return models


def apply_models(rows: DataFrame, models: DataFrame, features: list[str], group: str = "ticker") -> DataFrame:
    """``rows`` with the column p, the calibrated chance, by expressions only; null where the group has no model or a feature is null."""
    own = models.select(F.col(group).alias("__group"), F.col("models").alias("__models"))
    x = F.array(*[F.col(f).cast("double") for f in features])
    dot = lambda m: F.aggregate(F.sequence(F.lit(0), F.lit(len(features) - 1)), m["intercept"], lambda a, i: a + (F.get(x, i) - F.get(m["mean"], i)) / F.get(m["sd"], i) * F.get(m["weight"], i))

    def read(m: Column, s: Column) -> Column:
        i, n = F.size(F.filter(m["knots"], lambda k: k <= s)), F.size(m["knots"])
        x0, x1, y0, y1 = F.get(m["knots"], i - 1), F.get(m["knots"], i), F.get(m["values"], i - 1), F.get(m["values"], i)
        between = F.when(i == 0, F.get(m["values"], F.lit(0))).when(i == n, y0).otherwise(y0 + (s - x0) * (y1 - y0) / (x1 - x0))
        return F.when(n > 0, between).otherwise(1 / (1 + F.exp(-F.least(F.lit(35.0), F.greatest(F.lit(-35.0), s * m["slope"] + m["shift"])))))

    p = F.aggregate("__models", F.lit(0.0), lambda a, m: a + read(m, dot(m)), lambda a: a / F.size("__models"))
    return rows.join(own, F.col(group) == F.col("__group"), "left").withColumn("p", p).drop("__group", "__models")
