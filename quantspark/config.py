"""Configuration of a simulation: presets, checks, and the drift and volatility after mode and stress."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

# Calendar, path modes, levels, percentiles, presets.
DAYS = 252
PATH_MODES = {"Preview": 10_000, "Standard": 100_000, "Serious": 1_000_000}
PATH_RANGES = {"Custom": (1_000, 1_000_000), "Tail-risk (advanced)": (2_000_000, 5_000_000)}
RISK_LEVELS = (95.0, 99.0, 99.9)
PERCENTILES = (1, 5, 10, 25, 50, 75, 90, 95, 99)
JUMP_PRESETS = {"stock": (1.0, -0.02, 0.05), "crypto": (6.0, -0.03, 0.12)}  # a year's jumps, mean, volatility
REGIME_PRESETS = {
    "stock": {"mu": (1.0, 0.3, -4.0), "sigma": (1.0, 1.8, 3.0), "transition": ((0.970, 0.027, 0.003), (0.050, 0.930, 0.020), (0.100, 0.200, 0.700))},
    "crypto": {"mu": (1.0, 0.2, -5.0), "sigma": (1.3, 2.5, 4.0), "transition": ((0.940, 0.050, 0.010), (0.060, 0.900, 0.040), (0.080, 0.250, 0.670))},
}
MODELS = ("gbm", "student_t", "bootstrap", "block_bootstrap", "merton", "regime", "heston", "garch", "kou")
DRIFT_MODES = {"historical": 1.0, "half": 0.5, "zero": 0.0, "manual": None}


@dataclass(frozen=True)
class Simulation:
    """One run. ``check()`` raises ValueError naming the first field out of range."""

    model: str = "gbm"
    s0: float = 100.0
    paths: int = 100_000
    horizon: int = 252
    mu: float = 0.08
    sigma: float = 0.20
    dt: float = 1.0 / DAYS
    seed: int = 0
    cost: float = 0.0
    drift_mode: str = "historical"
    manual_drift: float | None = None
    antithetic: bool = False
    t_df: int = 5
    block_length: int = 20
    jumps: float = 1.0
    jump_mean: float = -0.02
    jump_vol: float = 0.05
    regimes: str = "stock"
    kappa: float = 1.5
    theta: float | None = None
    xi: float = 0.3
    rho: float = -0.7
    v0: float | None = None
    omega: float | None = None
    alpha: float = 0.08
    beta: float = 0.90
    p_up: float = 0.4
    eta_up: float = 25.0
    eta_down: float = 15.0
    ruin: float = 0.50
    crash: float = 0.0
    vol_multiplier: float = 1.0
    haircut: float = 0.0

    #: Range of each number: (lower, included, upper, included).
    _RANGES = {
        "s0": (0, False, None, False), "paths": (1, True, None, False), "horizon": (1, True, None, False), "sigma": (0, True, None, False), "dt": (0, False, None, False), "cost": (0, True, 1, False),
        "t_df": (2, False, None, False), "block_length": (1, True, None, False), "jumps": (0, True, None, False), "kappa": (0, True, None, False), "xi": (0, True, None, False), "rho": (-1, True, 1, True),
        "alpha": (0, True, None, False), "beta": (0, True, None, False), "p_up": (0, True, 1, True), "eta_up": (1, False, None, False), "eta_down": (0, False, None, False), "ruin": (0, False, 1, False),
        "crash": (0, True, 1, False), "vol_multiplier": (0, False, None, False), "haircut": (0, True, 1, True),
    }

    def check(self) -> Simulation:
        for name, choices in (("model", MODELS), ("drift_mode", DRIFT_MODES), ("regimes", REGIME_PRESETS)):
            if getattr(self, name) not in choices:
                raise ValueError(f"{name} must be one of {', '.join(choices)}")
        for name, (low, with_low, high, with_high) in self._RANGES.items():
            v = getattr(self, name)
            if not (v > low or with_low and v == low) or high is not None and not (v < high or with_high and v == high):
                raise ValueError(f"{name} is out of range: {v}")
        if self.alpha + self.beta >= 1:
            raise ValueError("alpha + beta must be below 1")
        if self.t_df != int(self.t_df):
            raise ValueError("t_df must be a whole number")
        return self

    @property
    def drift(self) -> float:
        share = DRIFT_MODES[self.drift_mode]
        base = self.mu * share if share is not None else self.mu if self.manual_drift is None else self.manual_drift
        return base * (1 - self.haircut)

    @property
    def volatility(self) -> float:
        return self.sigma * self.vol_multiplier


def preset(mode: str, paths: int | None = None, jumps: str = "stock", **changes) -> Simulation:
    """A configuration with the mode's path count, or ``paths`` within the range of a mode that has one."""
    if mode in PATH_RANGES:
        low, high = PATH_RANGES[mode]
        if paths is None or not low <= paths <= high:
            raise ValueError(f"{mode} takes {low} to {high} paths")
    elif mode not in PATH_MODES:
        raise ValueError(f"unknown mode: {mode}")
    rate, mean, vol = JUMP_PRESETS[jumps]
    base = Simulation(paths=PATH_MODES.get(mode, paths), jumps=rate, jump_mean=mean, jump_vol=vol, regimes=jumps)
    unknown = set(changes) - {f.name for f in fields(base)}
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return replace(base, **changes).check()
