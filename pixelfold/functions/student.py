"""Critical values of Student's t, for the slope test."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np

TAILS = ("LEFT", "TWO", "RIGHT")
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(48)


def _log_scale(dof: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma((n + 1) / 2) - math.lgamma(n / 2) - 0.5 * math.log(math.pi) for n in dof])


def t_cdf(t, dof) -> np.ndarray:
    """P(T <= t) for t >= 0.

    With t = sqrt(dof)*tan(u) the density is a power of cos(u), which a Gauss
    rule integrates to machine precision.
    """
    t, dof = np.atleast_1d(np.asarray(t, dtype=float)), np.atleast_1d(np.asarray(dof, dtype=float))
    half = np.arctan(t / np.sqrt(dof)) / 2
    u = half[:, None] * (1 + _NODES[None, :])
    area = half * (np.cos(u) ** (dof[:, None] - 1) @ _WEIGHTS)
    return 0.5 + np.exp(_log_scale(dof)) * area


def t_pdf(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    return np.exp(_log_scale(dof) - 0.5 * np.log(dof)) * (1 + t * t / dof) ** (-(dof + 1) / 2)


def t_quantiles(p: float, max_dof: int) -> np.ndarray:
    """Quantiles above the median for dof 1..max_dof, by bisection and Newton steps."""
    dof = np.arange(1, max_dof + 1, dtype=float)
    low = np.zeros(max_dof)
    high = np.full(max_dof, 2.0 * max(1.0, NormalDist().inv_cdf(p)))
    while (short := t_cdf(high, dof) < p).any():
        high = np.where(short, high * 2, high)
    for _ in range(20):
        mid = (low + high) / 2
        below = t_cdf(mid, dof) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    t = (low + high) / 2
    for _ in range(4):
        t = t - (t_cdf(t, dof) - p) / t_pdf(t, dof)
    return t


@lru_cache(maxsize=None)
def critical_values(conf: float, tail: str, max_dof: int) -> tuple[float, ...]:
    """Critical |t| for dof 1..max_dof."""
    if tail not in TAILS:
        raise ValueError(f"tail must be one of {TAILS}")
    p = 1 - (1 - conf) / 2 if tail == "TWO" else conf
    return tuple(round(float(t), 9) for t in t_quantiles(p, max_dof))
