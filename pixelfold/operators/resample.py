"""Changing the pixel size of a raster."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelfold.functions import kernels

# Aggregating methods (fixed values).
AGGREGATES = ("AVG", "MODE", "MAX", "MIN", "MED", "Q1", "Q3", "SUM", "RMS")


QUARTILES = {"Q1": 0.25, "MED": 0.5, "Q3": 0.75}


def _aggregate(method: str, value: str) -> Column:
    v = F.col(value)
    return {
        "AVG": lambda: F.avg(v),
        "MODE": lambda: F.mode(v, True),
        "MAX": lambda: F.max(v),
        "MIN": lambda: F.min(v),
        "SUM": lambda: F.sum(v),
        "RMS": lambda: F.sqrt(F.avg(v * v)),
    }[method]()


def resample_agg(grid: DataFrame, factor: int, methods, value="value", keys=("scene_id",)) -> DataFrame:
    """Coarse cells of ``factor`` x ``factor`` pixels, one column per method.

    A cell holds at most ``factor`` squared pixels, which bounds the ordered
    statistics; all quartiles share one pass over them.  The mode takes the
    smallest of tied values.
    """
    methods = [methods] if isinstance(methods, str) else list(methods)
    unknown = [m for m in methods if m not in AGGREGATES]
    if unknown:
        raise ValueError(f"unknown aggregation {unknown}")
    cell = lambda c: F.floor(F.col(c) / F.lit(float(factor))).cast("int")
    ordered = [m for m in methods if m in QUARTILES]
    aggs = [_aggregate(m, value).alias(m) for m in methods if m not in QUARTILES]
    if ordered:
        aggs.append(F.percentile(value, F.array(*[F.lit(QUARTILES[m]) for m in ordered])).alias("_q"))
    cells = grid.groupBy(*keys, cell("x").alias("cx"), cell("y").alias("cy")).agg(*aggs)
    final = [F.col("_q")[ordered.index(m)].alias(m) if m in QUARTILES else F.col(m) for m in methods]
    return cells.select(*keys, "cx", "cy", *final)


def _reached(coordinate: str, step: float, half: float) -> Column:
    """Targets whose centre lies less than ``half`` source pixels after or up to ``half`` before a source.

    Target t has its centre at (t + 0.5) * step - 0.5 in source pixels.
    """
    c = F.col(coordinate)
    low = F.ceil((c - half + 0.5) / F.lit(step) - 0.5).cast("int")
    high = (F.ceil((c + half + 0.5) / F.lit(step) - 0.5) - 1).cast("int")
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def scatter_weighted(grid: DataFrame, step: float, half: float, weight, value, keys) -> DataFrame:
    """Weighted mean of the sources in reach of every target centre.

    Each source row expands to the targets it reaches and the weighted sums are
    combined before the one shuffle; there is no join.  A target exists where
    the source pixel under its centre exists.  A list of values keeps their
    names, a single one becomes ``value``.
    """
    reach = max(half, 0.5)
    single = isinstance(value, str)
    values = [value] if single else list(value)
    spread = (
        grid.select(*keys, "x", "y", *values)
        .withColumn("tx", F.explode(_reached("x", step, reach)))
        .withColumn("ty", F.explode(_reached("y", step, reach)))
    )
    centre = lambda t: (F.col(t) + 0.5) * F.lit(step) - 0.5
    spread = spread.withColumns({"_dx": centre("tx") - F.col("x"), "_dy": centre("ty") - F.col("y")})
    # the source pixel under the centre has an offset in [-0.5, 0.5)
    under = (F.col("_dx") >= -0.5) & (F.col("_dx") < 0.5) & (F.col("_dy") >= -0.5) & (F.col("_dy") < 0.5)
    spread = spread.withColumn("_w", weight(F.col("_dx"), F.col("_dy")))
    sums = spread.groupBy(*keys, "tx", "ty").agg(F.max(under).alias("_under"), *[
        a for v in values for a in (
            F.sum(F.col("_w") * F.col(v)).alias(f"_wv_{v}"),
            F.sum(F.when(F.col(v).isNotNull(), F.col("_w"))).alias(f"_w_{v}"))])

    def mean(v):
        return F.col(f"_wv_{v}") / F.when(F.abs(f"_w_{v}") > 1e-9, F.col(f"_w_{v}"))

    means = [mean(value).alias("value")] if single else [mean(v).alias(v) for v in values]
    return sums.where("_under").select(*keys, "tx", "ty", *means)


def nearest_rows(grid: DataFrame, step: float, columns, keys=("scene_id",)) -> DataFrame:
    """``columns`` of the source pixel under every target centre, as they are: numbers, text or anything else.

    Of repeated source pixels one counts.
    """
    centre = lambda t: (F.col(t) + 0.5) * F.lit(float(step)) - 0.5
    spread = (grid.select(*keys, "x", "y", F.struct(*columns).alias("_row"))
              .withColumn("tx", F.explode(_reached("x", float(step), 0.5))).withColumn("ty", F.explode(_reached("y", float(step), 0.5))))
    away = F.abs(centre("tx") - F.col("x")) + F.abs(centre("ty") - F.col("y"))
    return spread.groupBy(*keys, "tx", "ty").agg(F.min_by("_row", away).alias("_row")).select(*keys, "tx", "ty", "_row.*")


def aggregate_rows(grid: DataFrame, factor: int, method: str, values, columns=(), keys=("scene_id",)) -> DataFrame:
    """Every value over cells of ``factor`` x ``factor`` pixels, with ``columns`` of the pixel under the cell's centre.

    All of it is one aggregate.  A cell without a pixel under its centre gives no
    row; of repeated pixels one counts.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(float(factor))).cast("int")
    away = [(cell(c) + 0.5) * factor - 0.5 - F.col(c) for c in ("x", "y")]
    under = reduce(lambda a, b: a & b, [(d >= -0.5) & (d < 0.5) for d in away])
    means = [(F.percentile(v, QUARTILES[method]) if method in QUARTILES else _aggregate(method, v)).cast("double").alias(v) for v in values]
    row = F.min_by(F.struct(F.lit(1).alias("_here"), *columns), F.when(under, 0)).alias("_row")
    cells = grid.groupBy(*keys, cell("x").alias("tx"), cell("y").alias("ty")).agg(row, *means)
    return cells.where("_row is not null").select(*keys, "tx", "ty", *[f"_row.{c}" for c in columns], *values)


def resample_interp(grid: DataFrame, step: float, method="CC", value="value", keys=("scene_id",)) -> DataFrame:
    """Value at target centres by nearest neighbour, bilinear, cubic, spline or Lanczos kernels."""
    if method not in kernels.HALF_TAPS:
        raise ValueError(f"unknown interpolation {method}")

    def weight(dx, dy):
        return kernels.kernel_weight(method, dx) * kernels.kernel_weight(method, dy)

    return scatter_weighted(grid, float(step), kernels.HALF_TAPS[method], weight, value, keys)


def resample(grid: DataFrame, step: float, method="CC", value="value", keys=("scene_id",)) -> DataFrame:
    """Any of the fourteen methods; aggregates need a whole ``step``."""
    if method in AGGREGATES:
        if step != int(step):
            raise ValueError("aggregation needs a whole number of pixels per cell")
        cells = resample_agg(grid, int(step), method, value, keys)
        return cells.select(*keys, F.col("cx").alias("tx"), F.col("cy").alias("ty"), F.col(method).cast("double").alias("value"))
    return resample_interp(grid, step, method, value, keys)


def reduce_psf(grid: DataFrame, factor: int, psf=False, value="value", keys=("scene_id",), support=1.0) -> DataFrame:
    """Coarser raster by nearest pixel, or by a Gaussian low-pass whose FWHM is the new pixel.

    The Gaussian is cut off ``support`` new pixels away from the centre on each axis.
    """
    if not psf:
        return resample_interp(grid, factor, "NN", value, keys)
    sigma = kernels.gaussian_sigma(factor)

    def weight(dx, dy):
        return F.exp(-(dx * dx + dy * dy) / (2 * sigma * sigma))

    return scatter_weighted(grid, float(factor), float(factor) * support, weight, value, keys)
