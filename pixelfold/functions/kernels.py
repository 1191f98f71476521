"""Resampling kernels: weight of a source sample at distance ``t`` pixels."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Samples on each side of the target (fixed values); NN takes the nearest one.
HALF_TAPS = {"NN": 0.5, "BL": 1, "CC": 2, "CSP": 2, "LZ": 3}


def _sinc(t: Column) -> Column:
    return F.when(F.abs(t) < 1e-12, F.lit(1.0)).otherwise(F.sin(t * math.pi) / (t * math.pi))


def kernel_weight(method: str, t: Column) -> Column:
    d = F.abs(t)
    if method == "NN":
        return F.lit(1.0)
    if method == "BL":
        return F.greatest(F.lit(0.0), 1 - d)
    if method == "CC":  # cubic convolution with parameter -0.5
        return (
            F.when(d < 1, 1.5 * d * d * d - 2.5 * d * d + 1)
            .when(d < 2, -0.5 * d * d * d + 2.5 * d * d - 4 * d + 2)
            .otherwise(F.lit(0.0))
        )
    if method == "CSP":  # cubic B-spline
        return (
            F.when(d < 1, (3 * d * d * d - 6 * d * d + 4) / 6)
            .when(d < 2, (2 - d) * (2 - d) * (2 - d) / 6)
            .otherwise(F.lit(0.0))
        )
    if method == "LZ":
        return F.when(d < 3, _sinc(t) * _sinc(t / 3)).otherwise(F.lit(0.0))
    raise ValueError(f"unknown kernel {method}")


def gaussian_sigma(fwhm: float) -> float:
    return fwhm / (2 * math.sqrt(2 * math.log(2)))
