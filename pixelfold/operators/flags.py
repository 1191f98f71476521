"""Conditions of a pixel that its quality word records, and the word itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelfold.functions.indices import normalized, role_columns
from pixelfold.functions.qai import packed
from pixelfold.operators import lines, reflectance
from pixelfold.operators.skew import attach, grouped_percentile

# Limits (fixed values): sun elevation, incidence angles and slope in degrees, aerosol optical depth.
LOW_SUN = 15.0
LOW_LIGHT, POOR_LIGHT = 55.0, 80.0
STEEP = 2.0
HIGH_AEROSOL, FILL_AEROSOL = 0.6, 0.1
# Reflectance of the cirrus band that tells thin high cloud.
CIRRUS_LIMIT = 0.01


def _known(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def water(columns) -> Column:
    """Dark in the near infrared, and not green."""
    b = role_columns(columns)
    ndvi = normalized(b["BNIR"], b["RED"])
    return _known(((ndvi < 0.01) & (b["BNIR"] < 0.11)) | ((ndvi < 0.1) & (b["BNIR"] < 0.05)))


def cirrus(columns) -> Column:
    """Thin high cloud by the cirrus band; never without one."""
    band = next((c for c in ("CIRRUS", "B10") if c in columns), None)
    return F.lit(False) if band is None else _known(F.col(band) > CIRRUS_LIMIT)


def snow(columns) -> Column:
    """Bright in green and near infrared, dark in the short-wave infrared."""
    b = role_columns(columns)
    return _known((normalized(b["GREEN"], b["SWIR1"]) > 0.4) & (b["BNIR"] > 0.11) & (b["GREEN"] > 0.1))


def light(grid: DataFrame, sun=("sun_zenith", "sun_azimuth"), resolution=20.0, key="scene_id", block=256) -> DataFrame:
    """Add slope, aspect, ``cos_i`` and ``shaded`` from ``dem`` and the columns of the sun's angles.

    Pixels without a full window have no slope.
    """
    carry = [c for c in grid.columns if c not in (key, "x", "y")]
    shaped = reflectance.terrain(grid, None, None, resolution, "dem", (key,), block, carry)
    return lines.terrain_shadow(shaped.withColumn("cos_i", reflectance.illumination(*sun)), sun, resolution, key=key)


def aerosol(grid: DataFrame, clear: Column, cell: int, least: int = 20, external: DataFrame | None = None, key="scene_id",
            fill=FILL_AEROSOL, **dark) -> DataFrame:
    """Aerosol optical depth of every ``cell`` x ``cell`` pixels as (key, ax, ay, aod, state).

    Cells with ``least`` clear pixels get an estimate of their own (state
    ``ESTIMATED``); the others the mean of their scene's estimates
    (``INTERPOLATED``), or ``fill`` where the scene has none (``FILLED``).  A
    scene named in ``external`` (key, aod) takes that value everywhere.
    """
    part = [F.floor(F.col(c) / F.lit(float(cell))).cast("int").alias(n) for c, n in (("x", "ax"), ("y", "ay"))]
    blue = role_columns(grid.columns)["BLUE"]
    pixels = grid.select(key, *part, F.when(clear, blue).alias("_blue"))
    cells = pixels.groupBy(key, "ax", "ay").agg(F.count("_blue").alias("_n"))
    low = grouped_percentile(pixels.where(F.col("_blue").isNotNull()), [key, "ax", "ay"], "_blue", 0.01, "_dark")
    own = cells.join(low, [key, "ax", "ay"], "left").select(
        key, "ax", "ay", F.when(F.col("_n") >= least, reflectance.optical_depth(F.col("_dark"), **dark)).alias("_own"))
    scene = own.groupBy(key).agg(F.avg("_own").alias("_scene"))
    known = attach(own, scene, [key], ["ax", "ay"])
    if external is None:
        known = known.withColumn("_given", F.lit(None).cast("double"))
    else:
        known = attach(known, external.select(key, F.col("aod").alias("_given")), [key], ["ax", "ay"])
    state = (F.when(F.col("_given").isNotNull(), "GIVEN").when(F.col("_own").isNotNull(), "ESTIMATED")
             .when(F.col("_scene").isNotNull(), "INTERPOLATED").otherwise("FILLED"))
    return known.select(key, "ax", "ay", F.coalesce("_given", "_own", "_scene", F.lit(float(fill))).alias("aod"), state.alias("state"))


def with_aerosol(grid: DataFrame, cells: DataFrame, cell: int, key="scene_id") -> DataFrame:
    """Add ``aod`` and ``aod_state`` of the cell to every pixel."""
    part = {n: F.floor(F.col(c) / F.lit(float(cell))).cast("int") for c, n in (("x", "ax"), ("y", "ay"))}
    named = cells.withColumnRenamed("state", "aod_state")
    return attach(grid.withColumns(part), named, [key, "ax", "ay"], ["x", "y"]).drop("ax", "ay")


def conditions(columns, bands) -> dict[str, Column]:
    """The named conditions of the quality word that ``columns`` allow to judge.

    Reads the flags ``cloud, cirrus, shadow, snow`` and their ``near_`` forms,
    ``water``, ``sun_zenith``, ``cos_i``, ``shaded``, ``slope``, ``aod`` with
    ``aod_state`` and ``wvp``.  Of the states of one field the first that holds
    counts.
    """
    flag = lambda *names: reduce(lambda a, b: a | b, [_known(F.col(n)) for n in names if n in columns], F.lit(False))
    every = lambda tests: reduce(lambda a, b: a & b, tests)
    some = lambda tests: reduce(lambda a, b: a | b, [_known(t) for t in tests])
    found = {
        "NODATA": every([F.col(b).isNull() for b in bands]),
        "CLOUD_OPAQUE": flag("cloud"), "CLOUD_CIRRUS": flag("cirrus", "near_cirrus"), "CLOUD_BUFFER": flag("near_cloud"),
        "CLOUD_SHADOW": flag("shadow", "near_shadow"), "SNOW": flag("snow", "near_snow"),
        "SUBZERO": some([F.col(b) < 0 for b in bands]), "SATURATION": some([F.col(b) > 1 for b in bands]),
    }
    if "water" in columns:
        found["WATER"] = flag("water") & ~found["CLOUD_OPAQUE"]
    if "aod" in columns:
        found |= {"AOD_FILL": F.col("aod_state") == "FILLED", "AOD_INT": F.col("aod_state") == "INTERPOLATED", "AOD_HIGH": F.col("aod") > HIGH_AEROSOL}
    if "sun_zenith" in columns:
        found["SUN_LOW"] = F.col("sun_zenith") > 90 - LOW_SUN
    if "cos_i" in columns:
        beyond = lambda angle: F.col("cos_i") < F.cos(F.radians(F.lit(angle)))
        found |= {"ILLUMIN_NONE": flag("shaded") | (F.col("cos_i") <= 0), "ILLUMIN_POOR": beyond(POOR_LIGHT), "ILLUMIN_LOW": beyond(LOW_LIGHT)}
    if "slope" in columns:
        found["SLOPED"] = F.col("slope") > STEEP
    if "wvp" in columns:
        found["WVP_NONE"] = F.col("wvp").isNull()
    return found


def quality_word(df: DataFrame, bands, name="qai") -> DataFrame:
    """Add the quality word of all conditions that the columns of ``df`` allow to judge."""
    return df.withColumn(name, packed(conditions(df.columns, list(bands))))
