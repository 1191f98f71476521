"""Bringing coarse bands to the pixels of fine bands."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelfold.operators import focal
from pixelfold.operators.skew import attach

# Merge methods (fixed values).
METHODS = ("IMPROPHE", "REGRESSION", "STARFM", "NONE")


def solve_normal(matrix, rhs) -> F.Column:
    """Least-squares coefficients of per-row normal equations, solved batch-wise.

    ``matrix`` is a flat k*k array, ``rhs`` a k array.  A singular row gives NULL.
    """
    @F.pandas_udf("array<double>")
    def solve(a: pd.Series, b: pd.Series) -> pd.Series:
        out = [None] * len(a)
        usable = [i for i in range(len(a)) if a[i] is not None and b[i] is not None]
        if usable:
            rhs_ = np.array([np.asarray(b[i], dtype=float) for i in usable])
            k = rhs_.shape[1]
            mats = np.array([np.asarray(a[i], dtype=float) for i in usable]).reshape(-1, k, k)
            finite = np.isfinite(mats).all(axis=(1, 2)) & np.isfinite(rhs_).all(axis=1)
            scale = np.sqrt(np.maximum(np.einsum("nii->ni", np.where(finite[:, None, None], mats, 1.0)), 1e-300))
            scaled = mats / (scale[:, :, None] * scale[:, None, :])
            good = finite.copy()
            good[finite] = np.linalg.matrix_rank(scaled[finite], tol=1e-9) == k
            if good.any():
                x = np.linalg.solve(scaled[good], (rhs_ / scale)[good][:, :, None])[:, :, 0] / scale[good]
                for i, row in zip(np.flatnonzero(good), x):
                    out[usable[i]] = row.tolist()
        return pd.Series(out, dtype=object)

    return solve(matrix, rhs)


def _cell(c):
    return F.floor(F.col(c) / F.lit(2.0)).cast("int")


def _coarse_means(fine: DataFrame, bands, keys) -> DataFrame:
    """Mean of the fine bands in every coarse cell."""
    return fine.groupBy(*keys, _cell("x").alias("cx"), _cell("y").alias("cy")).agg(
        *[F.avg(b).alias(f"m_{b}") for b in bands])


def _with_cells(fine):
    return fine.withColumns({"cx": _cell("x"), "cy": _cell("y")})


def merge_none(fine: DataFrame, coarse: DataFrame, values, keys) -> DataFrame:
    """Every coarse value copied to its four fine pixels."""
    return _with_cells(fine).join(coarse, [*keys, "cx", "cy"], "left").select(*keys, "x", "y", *values)


def _moments(cells: DataFrame, bands, v: str) -> dict[str, F.Column]:
    """Products that the normal equations of one coarse band sum up; NULL where anything is missing."""
    used = reduce(lambda a, b: a & b, [F.col(f"m_{b}").isNotNull() for b in bands]) & F.col(v).isNotNull()
    terms = [F.lit(1.0), *[F.col(f"m_{b}") for b in bands]]
    k = len(terms)
    return {**{f"a_{v}_{i}_{j}": F.when(used, terms[i] * terms[j]) for i in range(k) for j in range(i, k)},
            **{f"b_{v}_{i}": F.when(used, terms[i] * F.col(v)) for i in range(k)}}


def _solved(v: str, k: int, suffix="") -> F.Column:
    matrix = F.array(*[F.col(f"a_{v}_{min(i, j)}_{max(i, j)}{suffix}") for i in range(k) for j in range(k)])
    return solve_normal(matrix, F.array(*[F.col(f"b_{v}_{i}{suffix}") for i in range(k)])).alias(f"_beta_{v}")


def merge_regression(fine: DataFrame, coarse: DataFrame, bands, values, keys, tile: int | None = None, reach: int | None = None,
                     block=focal.BLOCK) -> DataFrame:
    """Multiple regression of each coarse band on the cell means of the fine bands.

    One fit per scene, per square of ``tile`` cells, or for every cell over the
    window of ``reach`` cells around it.  The normal equations are sums: they
    combine before the shuffle, or come from summed-area tables of the blocks.
    Where they have no single solution the merged value is NULL.
    """
    keys = list(keys)
    cells = _coarse_means(fine, bands, keys).join(coarse, [*keys, "cx", "cy"])
    moments = {n: m for v in values for n, m in _moments(cells, bands, v).items()}
    k = len(bands) + 1
    if reach is not None:
        windows = focal.box_means(cells.select(*keys, F.col("cx").alias("x"), F.col("cy").alias("y"), *[m.alias(n) for n, m in moments.items()]),
                                  list(moments), reach, keys, block)
        fits = windows.select(*keys, F.col("x").alias("cx"), F.col("y").alias("cy"), *[_solved(v, k, "_env") for v in values])
        applied = _with_cells(fine).join(fits, [*keys, "cx", "cy"], "left")
    else:
        part = {} if tile is None else {f"_t{c}": F.floor(F.col(f"c{c}") / F.lit(float(tile))).cast("int") for c in "xy"}
        sums = cells.withColumns(part).groupBy(*keys, *part).agg(*[F.sum(m).alias(n) for n, m in moments.items()])
        fits = sums.select(*keys, *part, *[_solved(v, k) for v in values])
        applied = attach(_with_cells(fine).withColumns(part), fits, [*keys, *part], ["x", "y"])

    def predicted(v):
        beta = lambda i: F.get(f"_beta_{v}", F.lit(i))
        return reduce(lambda a, b: a + b, [beta(i) * F.col(b) for i, b in enumerate(bands, start=1)], beta(0))

    return applied.select(*keys, "x", "y", *[predicted(v).alias(v) for v in values])


def merge_weighted(fine: DataFrame, coarse: DataFrame, bands, values, method: str, keys, block) -> DataFrame:
    """Weighted mean of the 3x3 coarse cells around a fine pixel.

    Weights fall with the spectral distance between the fine pixel and the cell
    mean; STARFM also divides by the distance of the cell.  The 3x3 windows are
    gathered once on the coarse cells, then each fine pixel meets one row.
    """
    keys = list(keys)
    cells = _coarse_means(fine, bands, keys).join(coarse, [*keys, "cx", "cy"])
    cells = cells.withColumnsRenamed({"cx": "x", "cy": "y"})
    means = [f"m_{b}" for b in bands]
    renamed = cells.select(*keys, "x", "y", *means, *[F.col(v).alias(f"c_{v}") for v in values])
    gathered = focal.windows3(renamed, [*means, *[f"c_{v}" for v in values]], keys, block)
    gathered = gathered.withColumnsRenamed({"x": "cx", "y": "cy"})
    joined = _with_cells(fine).join(gathered, [*keys, "cx", "cy"], "left")
    weights = {}
    for i in range(9):
        dx, dy = i % 3 - 1, i // 3 - 1
        spectral = reduce(lambda a, b: a + b, [F.abs(F.col(b) - F.col(f"m_{b}_{i}")) for b in bands])
        distance = 1 + (dx * dx + dy * dy) ** 0.5 if method == "STARFM" else 1.0
        weights[f"_w{i}"] = 1 / (spectral + 0.001) / F.lit(distance)
    weighted = joined.withColumns(weights)

    def mean(v):
        usable = [F.col(f"_w{i}").isNotNull() & F.col(f"c_{v}_{i}").isNotNull() for i in range(9)]
        top = [F.when(u, F.col(f"_w{i}") * F.col(f"c_{v}_{i}")).otherwise(0.0) for i, u in enumerate(usable)]
        bottom = [F.when(u, F.col(f"_w{i}")).otherwise(0.0) for i, u in enumerate(usable)]
        return reduce(lambda a, b: a + b, top) / F.nullif(reduce(lambda a, b: a + b, bottom), F.lit(0.0))

    return weighted.select(*keys, "x", "y", *[mean(v).alias(v) for v in values])


def resolution_merge(fine: DataFrame, coarse: DataFrame, bands, method="IMPROPHE", skip=None,
                     keys=("scene_id",), block=focal.BLOCK, values=("value",), tile: int | None = None, reach: int | None = None) -> DataFrame:
    """Coarse bands (``cx, cy`` and ``values``; a cell is 2x2 fine pixels) on the fine pixels.

    Fine pixels where ``skip`` holds (cloud or shadow) take no part and get no row.
    ``tile`` and ``reach`` (in cells) make the regression a local one.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if skip is not None:
        fine = fine.where(~F.coalesce(skip, F.lit(False)))
    fine = fine.select(*keys, "x", "y", *bands)
    coarse = coarse.select(*keys, "cx", "cy", *values)
    if method == "NONE":
        return merge_none(fine, coarse, values, keys)
    if method == "REGRESSION":
        return merge_regression(fine, coarse, bands, values, keys, tile, reach, block)
    return merge_weighted(fine, coarse, bands, values, method, keys, block)
