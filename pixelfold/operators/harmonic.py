"""Seasonal least-squares model of a series and its near-real-time use."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelfold.functions.dates import day_number
from pixelfold.operators.interpolate import DateGrid, _day
from pixelfold.operators.merge import solve_normal

YEAR = 365.25


def regressors(day: Column, origin, modes: int, trend: bool) -> list[Column]:
    """1, [years since origin], then cosine and sine of every mode."""
    if modes not in (1, 2, 3):
        raise ValueError("modes must be 1, 2 or 3")
    years = (day - _day(origin)) / F.lit(YEAR)
    terms = [F.lit(1.0)]
    if trend:
        terms.append(years)
    for m in range(1, modes + 1):
        angle = years * F.lit(2 * math.pi * m)
        terms += [F.cos(angle), F.sin(angle)]
    return terms


def harmonic_fit(obs: DataFrame, origin, modes=3, trend=True, fit_range=None, key="pixel_id",
                 date="date", value="value") -> DataFrame:
    """Coefficients, RMSE and count per key.

    The normal equations are central moments, combined before the shuffle, so
    neither large values nor good fits cancel; only the small system of each key
    (up to 7 x 7) reaches Python, in Arrow batches.  A series
    with fewer observations than unknowns gets NULL coefficients.
    """
    if fit_range:
        obs = obs.where(F.col(date).between(F.lit(fit_range[0]).cast("date"), F.lit(fit_range[1]).cast("date")))
    base = obs.select(key, day_number(date).alias("_d"), F.col(value).alias("_v"))
    k = 1 + int(trend) + 2 * modes
    terms = regressors(F.col("_d"), origin, modes, trend)
    # a row without a value adds to no moment, but its key stays
    shaped = base.select(key, "_v", *[F.when(F.col("_v").isNotNull(), t).alias(f"_x{i}") for i, t in enumerate(terms)])
    x = [F.col(f"_x{i}") for i in range(k)]
    v = F.col("_v").cast("double")
    moments = shaped.groupBy(key).agg(
        F.count(v).alias("n_obs"), F.avg(v).alias("_mean"), F.var_pop(v).alias("_var"),
        *[F.avg(x[i]).alias(f"_m{i}") for i in range(1, k)],
        *[F.covar_pop(x[i], x[j]).alias(f"_a{i}_{j}") for i in range(1, k) for j in range(i, k)],
        *[F.covar_pop(x[i], v).alias(f"_b{i}") for i in range(1, k)])
    enough = F.col("n_obs") >= k
    matrix = F.array(*[F.col(f"_a{min(i, j)}_{max(i, j)}") for i in range(1, k) for j in range(1, k)])
    rhs = F.array(*[F.col(f"_b{i}") for i in range(1, k)])
    solved = moments.withColumn("_slopes", solve_normal(F.when(enough, matrix), F.when(enough, rhs)))
    level, unexplained = F.col("_mean"), F.col("_var")
    for i in range(1, k):
        slope = F.get("_slopes", F.lit(i - 1))
        level, unexplained = level - slope * F.col(f"_m{i}"), unexplained - slope * F.col(f"_b{i}")
    known = F.col("_slopes").isNotNull()
    rmse = F.when(known, F.sqrt(F.greatest(F.lit(0.0), unexplained)))
    return solved.select(key, "n_obs", F.when(known, F.concat(F.array(level), F.col("_slopes"))).alias("coef"), rmse.alias("rmse"))


def evaluate(day: Column, origin, modes: int, trend: bool) -> Column:
    terms = regressors(day, origin, modes, trend)
    total = F.get("coef", F.lit(0))
    for i, t in enumerate(terms[1:], start=1):
        total = total + F.get("coef", F.lit(i)) * t
    return total


def interp_harmonic(coef: DataFrame, first, last, step=16, origin=None, modes=3, trend=True, key="pixel_id") -> DataFrame:
    """The fitted model at every grid date of every key."""
    grid = DateGrid(first, last, step)
    spread = coef.withColumn("_k", F.explode(grid.all())).withColumn("_t", grid.day(F.col("_k")))
    return spread.select(
        key, F.date_from_unix_date("_t").alias("date"),
        evaluate(F.col("_t"), origin or first, modes, trend).alias("value"))


def nrt_residual(obs: DataFrame, coef: DataFrame, end, origin, modes=3, trend=True, key="pixel_id",
                 date="date", value="value") -> DataFrame:
    """Observation minus extrapolated model, for dates after the end of the fit."""
    if end is None:
        raise ValueError("the residual product needs a fit range with a forecast period after it")
    later = obs.where((F.col(date) > F.lit(end).cast("date")) & F.col(value).isNotNull())
    joined = later.join(coef.select(key, "coef", "rmse"), key)
    expected = evaluate(day_number(date), origin, modes, trend)
    return joined.select(key, date, value, expected.alias("expected"), (F.col(value) - expected).alias("residual"), "rmse")
