"""Power, detectable effects and gates: closed forms for planning, on the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tideglass.functions.kernels import NORMAL


def power(prior: float, threshold: float, sd: float) -> float:
    """Chance to pass ``threshold`` when the effect is ``prior``."""
    return NORMAL.cdf((prior - threshold) / sd)


def detectable(z: float, se: float, sd: float) -> float:
    """Effect found with power 0.8 at critical value ``z``."""
    return z * se + NORMAL.inv_cdf(0.8) * sd


def permutation_floor(sizes: np.ndarray) -> float:
    """Mean spread of a rank correlation of noise over weeks of these sizes (those of at least two)."""
    k = np.asarray(sizes, float)
    k = k[k >= 2]
    return float((1 / np.sqrt(k - 1)).mean()) if len(k) else math.nan


def bartlett_factor(x: np.ndarray, lags: int) -> float:
    """Variance inflation of a mean under autocorrelation, Bartlett weights, at least 1."""
    d = np.asarray(x, float) - np.mean(x)
    g0 = (d * d).mean()
    if g0 == 0:
        return 1.0
    return max(1.0, 1 + 2 * sum((1 - k / (lags + 1)) * (d[k:] * d[:-k]).sum() / len(d) / g0 for k in range(1, lags + 1)))


def break_even_fee(edge: float, fills: int, vega_over_spot_bp: float) -> float:
    """Fee per fill in bp at which an edge in volatility points is used up."""
    return edge * vega_over_spot_bp / fills


def gate(conditions: dict[str, Column]) -> Column:
    """True where every condition holds; a condition that is null fails."""
    out = F.lit(True)
    for c in conditions.values():
        out = out & F.coalesce(c, F.lit(False))
    return out


def obrien_fleming(alpha: float, looks: int, points: int = 2001) -> list[float]:
    """Two-sided critical values of equally spaced looks that are c / sqrt(share of the data), for a total error of ``alpha``.

    The chance to have passed no bound yet is carried from look to look on a grid of the sum's density.
    """
    grid = np.linspace(-8 * math.sqrt(looks), 8 * math.sqrt(looks), points)
    step = grid[1] - grid[0]
    kernel = np.exp(-0.5 * (grid[:, None] - grid[None]) ** 2) / math.sqrt(2 * math.pi) * step

    def passed(c: float) -> float:
        inside = np.abs(grid) < c * math.sqrt(looks)
        density = np.exp(-0.5 * grid**2) / math.sqrt(2 * math.pi) * inside
        for _ in range(looks - 1):
            density = (kernel @ density) * inside
        return 1 - density.sum() * step

    lo, hi = 1.0, 6.0
    for _ in range(50):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if passed(mid) > alpha else (lo, mid)
    return [hi * math.sqrt(looks / k) for k in range(1, looks + 1)]
