"""Spectral-temporal metrics and folded series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelfold.functions import statistics as st

PERIODS = ("Y", "Q", "M", "W", "D")


def step_of(period: str, date="date") -> Column:
    """Year, or the quarter, month, ISO week or day of year that pools all years."""
    steps = {"Y": F.year, "Q": F.quarter, "M": F.month, "W": F.weekofyear, "D": F.dayofyear}
    if period not in steps:
        raise ValueError(f"period must be one of {PERIODS}")
    return steps[period](date)


def stm(series: DataFrame, metrics=st.STM_NAMES, keys=("pixel_id",), value="value") -> DataFrame:
    """Metrics over all dates of a series, in the requested order, in one aggregation."""
    metrics = list(metrics)
    st.check_names(metrics)
    return series.groupBy(*keys).agg(*st.statistic_aggregates(metrics, value)).select(*keys, *st.statistic_columns(metrics))


def fold(series: DataFrame, period: str, stat="AVG", keys=("pixel_id",), value="value") -> DataFrame:
    """Folded series ``keys, step, value``; a list of statistics gives one column each."""
    names = [stat] if isinstance(stat, str) else list(stat)
    st.check_names(names, st.FOLD_NAMES)
    folded = (
        series.where(F.col(value).isNotNull())
        .groupBy(*keys, step_of(period).alias("step"))
        .agg(*st.statistic_aggregates(names, value))
        .select(*keys, "step", *st.statistic_columns(names))
    )
    return folded.withColumn("value", F.col(stat).cast("double")).drop(stat) if isinstance(stat, str) else folded


def fold_all(series: DataFrame, periods=PERIODS, stat="AVG", keys=("pixel_id",), value="value") -> DataFrame:
    """Several folds from one scan, as ``keys, period, step, value``.

    A series has one row per date.  Its rows come together once, by ``keys``, and
    are folded there: a task holds the steps of its own series, at most 442 and
    one a year each, not a group for every row and period of its input.
    """
    st.check_names([stat], st.FOLD_NAMES)
    together = series.where(F.col(value).isNotNull()).select(
        *keys, F.col(value).alias("_v"), *[step_of(p).alias(f"_s{p}") for p in periods]).repartition(*keys)
    steps = F.posexplode(F.array(*[F.col(f"_s{p}") for p in periods])).alias("_p", "step")
    folded = together.select(*keys, "_v", steps).groupBy(*keys, "_p", "step").agg(*st.statistic_aggregates([stat], "_v"))
    period = F.get(F.array(*[F.lit(p) for p in periods]), F.col("_p"))
    value_col = st.statistic_columns([stat])[0].cast("double")
    return folded.select(*keys, period.alias("period"), "step", value_col.alias("value"))
