"""Seasonal metrics from the polar form of a series.

A date's angle is its share of the year; a value is the length of the vector.
All windows are per pixel, or per pixel and phenological year, over a series
with one row per date.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelfold.functions.dates import day_number

TWO_PI = 2 * math.pi
DAYS = 365.0

# Names of the seasonal metrics (fixed values).
METRICS = (
    "DEM", "DLM", "DPS", "DSS", "DMS", "DES", "DEV", "DAV", "DLV", "LTS", "LGS", "LGV",
    "VEM", "VLM", "VPS", "VSS", "VMS", "VES", "VEV", "VAV", "VLV", "VBL", "VGA", "VSA",
    "VPA", "VGM", "VGV", "DPY", "DPV", "IST", "IBL", "IBT", "IGS", "IRR", "IFR", "RAR",
    "RAF", "RMR", "RMF",
)


def angle_of(date) -> Column:
    return (F.dayofyear(date) - 1) * F.lit(TWO_PI / DAYS)


def polar_transform(tsi: DataFrame, date="date", value="value") -> DataFrame:
    """Add the vector of every date as ``pcx`` and ``pcy``."""
    return tsi.withColumns({"pcx": F.col(value) * F.cos(angle_of(date)), "pcy": F.col(value) * F.sin(angle_of(date))})


def _direction(x: Column, y: Column) -> Column:
    """Angle of a vector in [0, 2*pi)."""
    return F.pmod(F.atan2(y, x), F.lit(TWO_PI))


def _day_of_angle(angle: Column) -> Column:
    """Day of year whose angle is nearest."""
    return F.floor(angle / F.lit(TWO_PI / DAYS) + 0.5).cast("int") % 365 + 1


def _opposite_day(x: Column, y: Column) -> Column:
    """Day of year (1..365) in which the direction opposite to a vector falls."""
    angle = F.pmod(F.atan2(y, x) + F.lit(math.pi), F.lit(TWO_PI))
    return F.least(F.lit(365), F.floor(angle / F.lit(TWO_PI / DAYS)).cast("int") + 1)


def _anniversary(year: Column, doy: Column) -> Column:
    """Day number of a day of year."""
    return F.unix_date(F.make_date(year, F.lit(1), F.lit(1))) + doy - 1


def _phenological(tsi: DataFrame, adaptive: bool, key: str, date: str, value: str) -> DataFrame:
    """Series rows with vectors, ``pyear``, ``_start`` and ``_end`` (day numbers)."""
    pixel = Window.partitionBy(key)
    base = polar_transform(tsi.where(F.col(value).isNotNull()).select(key, F.col(date).alias("date"), F.col(value).alias("value")))
    located = base.withColumn("_day", day_number("date")).withColumn(
        "long_start", _opposite_day(F.avg("pcx").over(pixel), F.avg("pcy").over(pixel)))
    year = F.year("date")
    static = located.withColumn(
        "pyear", F.when(F.dayofyear("date") >= F.col("long_start"), year).otherwise(year - 1))
    if not adaptive:
        begin = _anniversary(F.col("pyear"), F.col("long_start"))
        return static.withColumns({"_start": begin, "_end": begin + 365})
    # shift every year's start by the year's own mean vector, at most half a year
    own = Window.partitionBy(key, "pyear")
    own_day = _opposite_day(F.avg("pcx").over(own), F.avg("pcy").over(own))
    shift = F.pmod(own_day - F.col("long_start") + 182, F.lit(365)) - 182
    moved = static.withColumn("_begin", _anniversary(F.col("pyear"), F.col("long_start")) + shift)
    # starts of the neighbouring years, seen from every row of a year
    ordered = Window.partitionBy(key).orderBy("pyear").rangeBetween(1, 1)
    earlier = Window.partitionBy(key).orderBy("pyear").rangeBetween(-1, -1)
    later = Window.partitionBy(key).orderBy("pyear").rangeBetween(2, 2)
    framed = moved.withColumns({
        "_next": F.coalesce(F.first("_begin").over(ordered), F.col("_begin") + 365),
        "_prev": F.coalesce(F.first("_begin").over(earlier), F.col("_begin") - 365),
    }).withColumn("_second", F.coalesce(F.first("_begin").over(later), F.col("_next") + 365))
    before, after = F.col("_day") < F.col("_begin"), F.col("_day") >= F.col("_next")
    return framed.withColumns({
        "_start": F.when(before, F.col("_prev")).when(after, F.col("_next")).otherwise(F.col("_begin")),
        "_end": F.when(before, F.col("_begin")).when(after, F.col("_second")).otherwise(F.col("_next")),
        "pyear": F.when(before, F.col("pyear") - 1).when(after, F.col("pyear") + 1).otherwise(F.col("pyear")),
    }).drop("_begin", "_next", "_prev", "_second")


def pheno_year(tsi: DataFrame, adaptive=False, key="pixel_id", date="date", value="value") -> DataFrame:
    """Start and end date of every phenological year, opposite to the average vector."""
    rows = _phenological(tsi, adaptive, key, date, value)
    return rows.groupBy(key, "pyear").agg(
        F.min("long_start").alias("mean_start"), F.min("_start").alias("_s"), F.max("_end").alias("_e"),
        F.count(F.lit(1)).alias("dates"),
    ).select(key, "pyear", "mean_start", F.date_from_unix_date("_s").alias("start"),
             F.date_from_unix_date("_e").alias("end"), "dates")


def _cumulated(rows: DataFrame, key: str) -> DataFrame:
    year = Window.partitionBy(key, "pyear")
    running = year.orderBy("_day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_share", F.sum("value").over(running) / F.nullif(F.sum("value").over(year), F.lit(0.0)))


def _season_days(rows: DataFrame, key: str, start: float, mid: float, end: float) -> DataFrame:
    """Add the days where the cumulative share reaches the three thresholds."""
    year = Window.partitionBy(key, "pyear")
    first = lambda t: F.min(F.when(F.col("_share") >= t, F.col("_day"))).over(year)
    return _cumulated(rows, key).withColumns({"_dss": first(start), "_dms": first(mid), "_des": first(end)})


def check_thresholds(start, mid, end):
    if not 0 <= start <= mid <= end <= 1:
        raise ValueError("season thresholds must be ordered shares")


def polar_season(tsi: DataFrame, start=0.2, mid=0.5, end=0.8, adaptive=False, key="pixel_id", date="date", value="value") -> DataFrame:
    """Start, mid and end of season of every phenological year."""
    check_thresholds(start, mid, end)
    rows = _season_days(_phenological(tsi, adaptive, key, date, value), key, start, mid, end)
    day = lambda c: F.date_from_unix_date(F.min(c))
    return rows.groupBy(key, "pyear").agg(
        day("_dss").alias("start_of_season"), day("_dms").alias("mid_of_season"), day("_des").alias("end_of_season"),
        F.sum("value").alias("total"))


def polarmetrics(tsi: DataFrame, names=METRICS, start=0.2, mid=0.5, end=0.8, adaptive=False, step=16,
                 key="pixel_id", date="date", value="value") -> DataFrame:
    """Seasonal metrics per key and phenological year.

    Dates count days from 1 January of the phenological year (1 = that day), so
    they may exceed 365.  One windowed pass finds the season; one aggregation
    on the same partitioning gives all metrics.
    """
    unknown = [n for n in names if n not in METRICS]
    if unknown:
        raise ValueError(f"unknown metrics {unknown}")
    check_thresholds(start, mid, end)
    rows = _season_days(_phenological(tsi, adaptive, key, date, value), key, start, mid, end)
    year = Window.partitionBy(key, "pyear")
    in_order = year.orderBy("_day")
    rise = (F.col("value") - F.lag("value").over(in_order)) / (F.col("_day") - F.lag("_day").over(in_order))
    rows = rows.withColumn("_rise", rise).withColumn("_peak", F.max("value").over(year))
    rows = rows.withColumn("_dps", F.min(F.when(F.col("value") == F.col("_peak"), F.col("_day"))).over(year))
    day, v = F.col("_day"), F.col("value")
    spans = {
        "early": day.between(F.col("_dss"), F.col("_dms")),
        "green": day.between(F.col("_dss"), F.col("_des")),
        "late": day.between(F.col("_dms"), F.col("_des")),
    }
    at = lambda where: F.max(F.when(day == F.col(where), v))
    mean = lambda when, c: F.avg(F.when(spans[when], F.col(c)))
    width = float(step)
    total = lambda cond: F.sum(F.when(cond, v).otherwise(0.0)) * width
    sums = rows.groupBy(key, "pyear").agg(
        F.min("long_start").alias("_long"), F.min("_start").alias("_dem"), F.max("_end").alias("_dlm"),
        F.min("_dps").alias("_dps"), F.min("_dss").alias("_dss"), F.min("_dms").alias("_dms"), F.min("_des").alias("_des"),
        F.min_by("value", "_day").alias("VEM"), F.max_by("value", "_day").alias("VLM"),
        F.max("_peak").alias("VPS"), at("_dss").alias("VSS"), at("_dms").alias("VMS"), at("_des").alias("VES"),
        *[mean(w, c).alias(f"_{w}_{c}") for w in spans for c in ("pcx", "pcy")],
        F.avg(F.when(spans["green"], v)).alias("VGM"), F.stddev_samp(F.when(spans["green"], v)).alias("VGV"),
        total(F.lit(True)).alias("IBT"), total(spans["green"]).alias("IGS"),
        total(day.between(F.col("_dss"), F.col("_dps"))).alias("IRR"),
        total(day.between(F.col("_dps"), F.col("_des"))).alias("IFR"),
        F.max("_rise").alias("RMR"), (-F.min("_rise")).alias("RMF"),
    )
    jan1 = F.unix_date(F.make_date(F.col("pyear"), F.lit(1), F.lit(1)))
    timeline = lambda c: F.col(c) - jan1 + 1
    x, y = (lambda w: F.col(f"_{w}_pcx")), (lambda w: F.col(f"_{w}_pcy"))
    doy = lambda w: _day_of_angle(_direction(x(w), y(w)))
    # an angle before the start of the year belongs to its second calendar year
    onward = lambda w: doy(w) + F.when(doy(w) < F.col("DPY"), 365).otherwise(0)
    length = lambda w: F.sqrt(x(w) * x(w) + y(w) * y(w))
    dated = sums.withColumns({
        "DEM": timeline("_dem"), "DLM": timeline("_dlm"), "DPS": timeline("_dps"),
        "DSS": timeline("_dss"), "DMS": timeline("_dms"), "DES": timeline("_des"), "DPY": timeline("_dem"),
        "VEV": length("early"), "VAV": length("green"), "VLV": length("late"),
        "VBL": (F.col("VEM") + F.col("VLM")) / 2,
    })
    full = dated.withColumns({
        "DEV": onward("early"), "DAV": onward("green"), "DLV": onward("late"),
        "LTS": F.col("DLM") - F.col("DEM"), "LGS": F.col("DES") - F.col("DSS"),
        "VSA": F.col("VPS") - F.col("VBL"), "VGA": F.col("VGM") - F.col("VBL"),
        "VPA": F.col("VPS") - (F.col("VSS") + F.col("VES")) / 2,
        "DPV": F.col("DPY") - F.col("_long"),
        "RAR": (F.col("VPS") - F.col("VSS")) / F.nullif(F.col("DPS") - F.col("DSS"), F.lit(0)),
        "RAF": (F.col("VPS") - F.col("VES")) / F.nullif(F.col("DES") - F.col("DPS"), F.lit(0)),
    }).withColumns({"LGV": F.col("DLV") - F.col("DEV"), "IBL": F.col("VBL") * F.col("LTS")})
    full = full.withColumn("IST", F.col("IBT") - F.col("IBL"))
    return full.select(key, "pyear", *names)


def metric_series(metrics: DataFrame, name: str, key="pixel_id") -> DataFrame:
    """One metric as a yearly series ``key, step, value``, for trends and changes."""
    return metrics.where(F.col(name).isNotNull()).select(
        key, F.col("pyear").alias("step"), F.col(name).cast("double").alias("value"))


def metrics_series(metrics: DataFrame, names, key="pixel_id") -> DataFrame:
    """All named metrics as yearly series ``key, metric, step, value``."""
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return metrics.select(key, F.col("pyear").alias("step"), F.explode(pairs).alias("_m")).select(
        key, "_m.metric", "step", "_m.value").where(F.col("value").isNotNull())
