"""Interpolation of irregular series to a regular grid of dates.

Grid date k is ``first + k*step`` days, up to ``last``.
"""

from __future__ import annotations

from datetime import date as Date
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelfold.functions.dates import day_number

# Interpolation methods (fixed values).
METHODS = ("NONE", "LINEAR", "MOVING", "RBF", "HARMONIC")
EPOCH = Date(1970, 1, 1)


def _day(d) -> int:
    d = Date.fromisoformat(d) if isinstance(d, str) else d
    return (d - EPOCH).days


class DateGrid:
    """The dates of an interpolation; a parameter, not data."""

    def __init__(self, first, last, step=16):
        self.first, self.last, self.step = _day(first), _day(last), int(step)
        if self.step < 1 or self.last < self.first:
            raise ValueError("the grid needs a positive step and an ordered range")
        self.size = (self.last - self.first) // self.step + 1

    def day(self, k: Column) -> Column:
        return F.lit(self.first) + k * self.step

    def at_or_after(self, day: Column) -> Column:
        return F.ceil((day - self.first) / F.lit(float(self.step))).cast("int")

    def at_or_before(self, day: Column) -> Column:
        return F.floor((day - self.first) / F.lit(float(self.step))).cast("int")

    def steps(self, low: Column, high: Column) -> Column:
        """Grid numbers from low to high, cut to the grid; empty if none."""
        low, high = F.greatest(low, F.lit(0)), F.least(high, F.lit(self.size - 1))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    def all(self) -> Column:
        return F.sequence(F.lit(0), F.lit(self.size - 1))


def interp_grid(df: DataFrame, first, last, step=16, key="pixel_id") -> DataFrame:
    """Every grid date for every key."""
    grid = DateGrid(first, last, step)
    return df.select(key).distinct().select(key, F.explode(grid.all()).alias("_k")).select(
        key, F.date_from_unix_date(grid.day(F.col("_k"))).alias("date"))


def _with_gaps(obs: DataFrame, key, date, value) -> DataFrame:
    """Observations as ``_d, _v``; ``_none`` marks those without a value.

    They order after the others, so that a key without any value still has a
    first row and keeps its grid dates.
    """
    return obs.select(key, day_number(date).alias("_d"), F.col(value).alias("_v"), F.col(value).isNull().alias("_none"))


def interp_linear(obs: DataFrame, first, last, step=16, key="pixel_id", date="date", value="value") -> DataFrame:
    """Line between the two bracketing observations; NULL outside them.

    Each observation knows its successor and expands to the grid dates up to
    it, so the grid never has to be joined or merged in: one shuffle, one sort.
    """
    grid = DateGrid(first, last, step)
    order = Window.partitionBy(key).orderBy("_none", "_d")
    base = _with_gaps(obs, key, date, value)
    paired = base.withColumns({
        "_dn": F.lead(F.when(~F.col("_none"), F.col("_d"))).over(order), "_vn": F.lead("_v").over(order),
        "_start": F.row_number().over(order) == 1,
    }).where(~F.col("_none") | F.col("_start"))
    low = F.when(F.col("_start"), 0).otherwise(grid.at_or_after(F.col("_d")))
    high = F.when(F.col("_dn").isNull(), grid.size - 1).otherwise(grid.at_or_after(F.col("_dn")) - 1)
    spread = paired.withColumn("_k", F.explode(grid.steps(low, high))).withColumn("_t", grid.day(F.col("_k")))
    line = F.col("_v") + (F.col("_vn") - F.col("_v")) * ((F.col("_t") - F.col("_d")) / (F.col("_dn") - F.col("_d")))
    result = F.when(F.col("_t") == F.col("_d"), F.col("_v")).when(F.col("_t") > F.col("_d"), line)
    return spread.select(key, F.date_from_unix_date("_t").alias("date"), result.alias("value"))


def _reaching(obs: DataFrame, grid: DateGrid, reach: float, key, date, value, complete: bool) -> DataFrame:
    """Each observation at every grid date at most ``reach`` days away, as ``_k, _gap, _v``.

    With ``complete`` the first observation of a key also visits all other grid
    dates, so that dates nobody reaches still appear; ``_gap`` tells them apart.
    The window that finds it partitions by key, which the aggregation over key
    and date, and later steps by key, reuse without a further shuffle.
    """
    base = _with_gaps(obs, key, date, value)
    steps = grid.steps(grid.at_or_after(F.col("_d") - F.lit(reach)), grid.at_or_before(F.col("_d") + F.lit(reach)))
    if complete:
        first = F.row_number().over(Window.partitionBy(key).orderBy("_none", "_d")) == 1
        base = base.withColumn("_first", first).where(~F.col("_none") | F.col("_first"))
        steps = F.when(F.col("_first"), grid.all()).otherwise(steps)
    else:
        base = base.where(~F.col("_none"))
    return base.withColumn("_k", F.explode(steps)).withColumn("_gap", grid.day(F.col("_k")) - F.col("_d")).drop("_first", "_none")


def interp_moving(obs: DataFrame, first, last, step=16, moving_max=16, key="pixel_id", date="date",
                  value="value", complete=True) -> DataFrame:
    """Mean of the observations at most ``moving_max`` days away.

    Observations expand to the few grid dates they reach.  Without ``complete``
    unreached dates are left out.
    """
    grid = DateGrid(first, last, step)
    near = _reaching(obs, grid, moving_max, key, date, value, complete)
    mean = F.avg(F.when(F.abs("_gap") <= moving_max, F.col("_v")))
    return near.groupBy(key, "_k").agg(mean.alias("value")).select(
        key, F.date_from_unix_date(grid.day(F.col("_k"))).alias("date"), "value")


def rbf_half_width(sigma: float, cutoff: float) -> float:
    """Distance that keeps the share ``cutoff`` of the area under the Gaussian."""
    return round(NormalDist().inv_cdf((1 + cutoff) / 2) * sigma, 9)


def interp_rbf(obs: DataFrame, first, last, step=16, sigmas=(8, 16, 32), cutoff=0.95, key="pixel_id",
               date="date", value="value", complete=True) -> DataFrame:
    """Gaussian kernels of several widths, combined by the data density in each."""
    grid = DateGrid(first, last, step)
    halves = [rbf_half_width(s, cutoff) for s in sigmas]
    near = _reaching(obs, grid, max(halves), key, date, value, complete)
    gap = F.col("_gap")
    sums = []
    for i, (sigma, half) in enumerate(zip(sigmas, halves)):
        weight = F.when(F.abs(gap) <= half, F.exp(-(gap * gap) / F.lit(2.0 * sigma * sigma)))
        sums += [F.sum(weight).alias(f"_w{i}"), F.sum(weight * F.col("_v")).alias(f"_wv{i}"), F.count(weight).alias(f"_n{i}")]
    top, bottom = F.lit(0.0), F.lit(0.0)
    for i, half in enumerate(halves):
        density = F.col(f"_n{i}") / F.lit(2 * half + 1)
        top = top + F.when(F.col(f"_n{i}") > 0, density * F.col(f"_wv{i}") / F.col(f"_w{i}")).otherwise(0.0)
        bottom = bottom + density
    return near.groupBy(key, "_k").agg(*sums).select(
        key, F.date_from_unix_date(grid.day(F.col("_k"))).alias("date"),
        (top / F.nullif(bottom, F.lit(0.0))).alias("value"))


def interpolate(obs: DataFrame, method: str, first=None, last=None, step=16, key="pixel_id", **options) -> DataFrame:
    """Any of the five methods; NONE passes the observations through."""
    from pixelfold.operators import harmonic
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if method == "NONE":
        return obs.select(key, "date", "value")
    if method == "LINEAR":
        return interp_linear(obs, first, last, step, key, **options)
    if method == "MOVING":
        return interp_moving(obs, first, last, step, key=key, **options)
    if method == "RBF":
        return interp_rbf(obs, first, last, step, key=key, **options)
    coef = harmonic.harmonic_fit(obs, origin=first, key=key, **options)
    return harmonic.interp_harmonic(coef, first, last, step, key=key, modes=options.get("modes", 3),
                                    trend=options.get("trend", True))
