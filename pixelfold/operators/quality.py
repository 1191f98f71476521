"""Quality flags and noise screening of observations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelfold.functions import qai as q
from pixelfold.functions.dates import day_number


def decode_qai(df: DataFrame, col="qai") -> DataFrame:
    """One boolean column per named condition."""
    return df.withColumns({name: q.has_flag(name, col) for name in q.LAYOUT})


def screen_qai(df: DataFrame, flags=q.DEFAULT_SCREEN, col="qai") -> DataFrame:
    """Drop observations that carry any of the chosen conditions."""
    return df.where(~q.is_screened(flags, col))


def mark_screened(df: DataFrame, flags=q.DEFAULT_SCREEN, col="qai", name="kept") -> DataFrame:
    return df.withColumn(name, ~q.is_screened(flags, col))


def _line(before_day, before, after_day, after, day):
    share = (day - before_day) / (after_day - before_day)
    return before + (after - before) * share


def calm(days: np.ndarray, values: np.ndarray, above: float) -> np.ndarray:
    """Positions left when no residual of a series exceeds ``above`` times its noise.

    Days rise; a missing value is NaN, judges nothing and stays.
    """
    left = np.arange(len(days))
    while len(left) > 2:
        d, v = days[left], values[left]
        share = (d[1:-1] - d[:-2]) / (d[2:] - d[:-2])
        residual = np.abs(v[1:-1] - (v[:-2] + (v[2:] - v[:-2]) * share))
        if np.isnan(residual).all():
            break
        noise = np.sqrt(np.nanmean(residual * residual))
        worst = int(np.nanargmax(residual))  # the earliest on ties
        if not residual[worst] > above * noise:
            break
        left = np.delete(left, worst + 1)
    return left


def noise_filter(df: DataFrame, above: float, key="pixel_id", date="date", value="value") -> DataFrame:
    """Iteratively remove the largest outlier of every series until none is left.

    The residual of a triplet's middle value from the line between its
    neighbours gives the noise (RMSE); each pass drops, per pixel, the largest
    residual above ``above`` times the noise, the earliest on ties.  A series
    has one row per date, which bounds it; each is brought together by one
    shuffle and worked to its own end, so a calm pixel does not wait for others.
    """
    if not above:
        return df

    @F.pandas_udf("array<int>")
    def keep(days: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([calm(np.asarray(d, float), np.asarray(v, float), above).astype("int32") for d, v in zip(days, values)])

    rows = F.array_sort(F.collect_list(F.struct(
        day_number(date).alias("day"), F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))).alias("v"), F.struct("*").alias("row"))))
    series = df.groupBy(F.col(key).alias("_key")).agg(rows.alias("rows"))
    judged = series.withColumn("left", keep(F.col("rows.day"), F.col("rows.v")))
    return judged.select(F.explode(F.transform("left", lambda i: F.get("rows", i)["row"])).alias("row")).select("row.*")


def noise_restore(df: DataFrame, below: float, key="pixel_id", date="date", value="value", kept="kept") -> DataFrame:
    """Bring back screened observations close to the line between kept neighbours.

    ``kept`` marks the screened series; the result keeps all kept rows plus the
    restored ones, flagged in ``restored``.
    """
    if not below:
        return df.where(F.col(kept)).withColumn("restored", F.lit(False))
    order = Window.partitionBy(key).orderBy(date)
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    # looking ahead as a growing frame over the reversed order stays linear
    coming = Window.partitionBy(key).orderBy(F.desc(date)).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(key)
    day = F.col("_day")
    point = F.when(F.col(kept), F.struct(day.alias("d"), F.col(value).alias("v")))
    near = df.withColumn("_day", day_number(date)).withColumns({
        "_p": F.last(point, ignorenulls=True).over(past),
        "_n": F.last(point, ignorenulls=True).over(coming),
    })
    line = _line(F.col("_p.d"), F.col("_p.v"), F.col("_n.d"), F.col("_n.v"), day)
    measured = near.withColumn("_r", F.abs(F.col(value) - line))
    noise = F.sqrt(F.avg(F.when(F.col(kept), F.col("_r") * F.col("_r"))).over(whole))
    back = ~F.col(kept) & (F.col("_r") < F.lit(below) * F.col("_noise"))
    return (
        measured.withColumn("_noise", noise)
        .withColumn("restored", F.coalesce(back, F.lit(False)))
        .where(F.col(kept) | F.col("restored"))
        .select(*df.columns, "restored")
    )
