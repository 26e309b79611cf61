"""GARCH(1,1) by maximum likelihood, an instrument a group: the recursion runs over many candidates at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

FALLBACK = (0.08, 0.90)
LEAST = 30


def log_likelihood(r: np.ndarray, omega: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Gaussian log-likelihoods of the candidates; the first variance is the sample's."""
    v = np.full(len(omega), max(float(np.var(r)), 1e-12))
    out = np.zeros(len(omega))
    for x in r * r:
        out -= 0.5 * (np.log(2 * np.pi * v) + x / v)
        v = np.maximum(omega + alpha * x + beta * v, 1e-12)
    return out


def fit(r: np.ndarray, rounds: int = 12, side: int = 7) -> tuple[float, float, float, float, str]:
    """``(omega, alpha, beta, loglik, method)``: a lattice over (long-run variance, alpha, persistence) that shrinks about its best point.

    Fewer than 30 returns, or none that vary, take alpha 0.08 and beta 0.90 with the sample's variance.
    """
    r = r[np.isfinite(r)]
    r = r - r.mean() if len(r) else r
    var = float(np.var(r, ddof=1)) if len(r) > 1 else 1e-4
    if len(r) < LEAST or var <= 0:
        a, b = FALLBACK
        return max(var * (1 - a - b), 1e-12), a, b, float("nan"), "fallback"
    low, high = np.array([np.log(0.25), 0.0, 0.0]), np.array([np.log(4.0), 0.5, 0.998])
    best, width = np.array([0.0, FALLBACK[0], sum(FALLBACK)]), (high - low) / 2
    for _ in range(rounds):
        axes = [np.unique(np.clip(c + w * np.linspace(-1, 1, side), lo, hi)) for c, w, lo, hi in zip(best, width, low, high, strict=True)]
        scale, alpha, persistence = (x.ravel() for x in np.meshgrid(*axes, indexing="ij"))
        ok = (persistence >= alpha) & (persistence - alpha <= 0.99)
        scale, alpha, persistence = scale[ok], alpha[ok], persistence[ok]
        omega = np.maximum(var * np.exp(scale) * (1 - persistence), 1e-14)
        ll = log_likelihood(r, omega, alpha, persistence - alpha)
        k = int(np.argmax(ll))
        best, width = np.array([scale[k], alpha[k], persistence[k]]), width * 0.55
    return float(omega[k]), float(alpha[k]), float(persistence[k] - alpha[k]), float(ll[k]), "mle"


def garch_parameters(returns: DataFrame) -> DataFrame:
    """``returns(ticker, t, r)`` -> ``(ticker, n, omega, alpha, beta, loglik, method)``; an instrument's history must fit a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.sort_values("t")["r"].to_numpy(float)
        r = r[np.isfinite(r)]
        omega, alpha, beta, ll, how = fit(r)
        return pd.DataFrame([(pdf["ticker"].iloc[0], len(r), omega, alpha, beta, None if np.isnan(ll) else ll, how)], columns=["ticker", "n", "omega", "alpha", "beta", "loglik", "method"])

    return returns.select("ticker", "t", "r").groupBy("ticker").applyInPandas(run, "ticker string, n long, omega double, alpha double, beta double, loglik double, method string")
