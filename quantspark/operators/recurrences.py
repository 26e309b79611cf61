"""Running recurrences by ticker: a series' bars are one bounded group, and series are spread over the cluster."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


BLOCK = 128


def _run(x: np.ndarray, seed: float, at: int, alpha: float) -> np.ndarray:
    """Exponential recurrence y += alpha * (x - y) from ``seed`` at index ``at``; undefined before. A block is one product."""
    out = np.full(len(x), np.nan)
    if len(x) <= at:
        return out
    out[at] = seed
    keep = (1 - alpha) ** np.arange(BLOCK + 1)
    age = np.arange(BLOCK)[:, None] - np.arange(BLOCK)[None, :]
    weight = np.where(age >= 0, alpha * keep[np.maximum(age, 0)], 0.0)
    for i in range(at + 1, len(x), BLOCK):
        n = min(BLOCK, len(x) - i)
        own = np.zeros(BLOCK)  # always whole blocks, so that later values change nothing in earlier ones
        own[:n] = x[i : i + n]
        out[i : i + n] = (weight @ own)[:n] + keep[1 : n + 1] * out[i - 1]
    return out


def ema(x: np.ndarray, length: int) -> np.ndarray:
    """Seeded by the mean of the first ``length`` values."""
    return _run(x, float(np.mean(x[:length])), length - 1, 2 / (length + 1))


def rsi(x: np.ndarray, length: int = 14) -> np.ndarray:
    """Wilder's; 100 where nothing fell but something rose, 50 where nothing moved."""
    out = np.full(len(x), np.nan)
    if len(x) <= length:
        return out
    move = np.diff(x)
    up, down = (_run(m, float(np.mean(m[:length])), length - 1, 1 / length) for m in (np.maximum(move, 0), np.maximum(-move, 0)))
    with np.errstate(divide="ignore", invalid="ignore"):
        value = 100 - 100 / (1 + up / down)
    out[1:] = np.where(down == 0, np.where(up > 0, 100.0, 50.0), value)
    out[: length] = np.nan
    return out


def ewma_variance(returns: np.ndarray, lam: float = 0.94, seed: int = 20) -> np.ndarray:
    """Seeded by the population variance of the first returns; the update begins with the return after them."""
    if len(returns) < seed:
        return np.full(len(returns), np.nan)
    return _run(returns**2, float(np.var(returns[:seed])), seed - 1, 1 - lam)


def directional_index(high: np.ndarray, low: np.ndarray, close: np.ndarray, length: int = 14) -> np.ndarray:
    """Wilder's average directional index: averaged moves up and down over the averaged true range, their relative difference averaged again.

    0 where no move was averaged; undefined in the first ``2 * length - 1`` bars.
    """
    out = np.full(len(close), np.nan)
    if len(close) < 2 * length:
        return out
    up, down = np.diff(high), -np.diff(low)
    ranges = np.maximum(high[1:] - low[1:], np.maximum(np.abs(high[1:] - close[:-1]), np.abs(low[1:] - close[:-1])))
    plus, minus, true = (_run(x, float(np.mean(x[:length])), length - 1, 1 / length) for x in (np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0), ranges))
    both = (plus + minus)[length - 1 :]
    known = true[length - 1 :] > 0
    dx = np.where(known & (both > 0), 100 * np.abs(plus - minus)[length - 1 :] / np.where(both > 0, both, 1.0), 0.0)
    out[length:] = _run(dx, float(np.mean(dx[:length])), length - 1, 1 / length)
    return out


def with_directional_index(bars: DataFrame) -> DataFrame:
    """``bars(ticker, t, high, low, close)`` -> ``(ticker, t, adx14)``; null where undefined."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", ignore_index=True)
        pdf["adx14"] = directional_index(*(pdf[c].to_numpy() for c in ("high", "low", "close")))
        return pdf[["ticker", "t", "adx14"]].replace({np.nan: None})

    return bars.select("ticker", "t", "high", "low", "close").groupBy("ticker").applyInPandas(run, "ticker string, t int, adx14 double")


def with_recurrences(bars: DataFrame) -> DataFrame:
    """``bars(ticker, t, close)`` -> adds ema9, ema21, rsi14 and ewma_var; null where undefined."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", ignore_index=True)
        x = pdf["close"].to_numpy()
        pdf["ema9"], pdf["ema21"], pdf["rsi14"] = ema(x, 9), ema(x, 21), rsi(x)
        pdf["ewma_var"] = np.r_[np.nan, ewma_variance(np.diff(np.log(x)))]
        return pdf.replace({np.nan: None})

    return bars.select("ticker", "t", "close").groupBy("ticker").applyInPandas(run, "ticker string, t int, close double, ema9 double, ema21 double, rsi14 double, ewma_var double")
