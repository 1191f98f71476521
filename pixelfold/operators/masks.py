"""Cloud, shadow and snow masks."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelfold.functions.indices import normalized, ratio, role_columns
from pixelfold.operators import flood, focal, lines
from pixelfold.operators.skew import attach, grouped_percentile

# Class codes of raster masks (fixed values).
OPAQUE, CIRRUS, SHADOW, SNOW, NODATA, WATER = range(6)
BUFFER_METRES = {OPAQUE: 300, CIRRUS: 0, SHADOW: 90, SNOW: 30}


def _cloud_share(df: DataFrame, keys, cloud: Column) -> DataFrame:
    return df.groupBy(*keys).agg((F.avg(cloud.cast("double")) * 100).alias("_share"))


def is_cloud(col="class") -> Column:
    return F.coalesce(F.col(col).isin(OPAQUE, CIRRUS), F.lit(False))


def cloud_cover_frame(df: DataFrame, max_percent=99.0, key="scene_id", cloud: Column | None = None) -> DataFrame:
    """Drop whole images whose cloud share exceeds the threshold."""
    cloud = is_cloud() if cloud is None else cloud
    too_cloudy = _cloud_share(df, [key], cloud).where(F.col("_share") > max_percent).select(key)
    return df.join(too_cloudy, key, "left_anti")


def cloud_cover_tile(df: DataFrame, max_percent=99.0, keys=("scene_id", "tile_x", "tile_y"),
                     cloud: Column | None = None) -> DataFrame:
    """Drop chips (image x tile) above the threshold.

    The share is aggregated and joined back; a window would put all of a chip in one task.
    """
    cloud = is_cloud() if cloud is None else cloud
    too_cloudy = _cloud_share(df, keys, cloud).where(F.col("_share") > max_percent).select(*keys)
    return df.join(too_cloudy, list(keys), "left_anti")


def _pixels(metres: float, resolution: float) -> float:
    return metres / resolution


def buffer_mask(grid: DataFrame, classes, radius: float, resolution=20.0, col="class",
                keys=("scene_id",), name="buffered", block=focal.BLOCK) -> DataFrame:
    """Mark pixels within ``radius`` metres of a pixel of the given classes."""
    classes = [classes] if isinstance(classes, int) else list(classes)
    r = _pixels(radius, resolution)
    carry = [c for c in grid.columns if c not in (*keys, "x", "y")]
    found = focal.nearest_squared(grid, F.col(col).isin(classes), math.floor(r), keys, block, carry)
    hit = F.coalesce(F.col("_d2") <= F.lit(r * r + 1e-9), F.lit(False))
    return found.withColumn(name, hit).drop("_d2")


def buffer_masks(grid: DataFrame, buffers: dict[str, float], resolution=20.0, keys=("scene_id",), block=focal.BLOCK) -> DataFrame:
    """Add ``near_<flag>`` for several flag columns, each with its own radius in metres."""
    pixels = {n: _pixels(r, resolution) for n, r in buffers.items()}
    carry = [c for c in grid.columns if c not in (*keys, "x", "y")]
    found = focal.nearest_each(grid, {n: (F.col(n), math.floor(r)) for n, r in pixels.items()}, keys, block, carry)
    hits = {f"near_{n}": F.coalesce(F.col(f"d2_{n}") <= F.lit(r * r + 1e-9), F.lit(False)) for n, r in pixels.items()}
    return found.withColumns(hits).drop(*[f"d2_{n}" for n in pixels])


def buffer_nodata(grid: DataFrame, value="value", keys=("scene_id",), block=focal.BLOCK) -> DataFrame:
    """Nodata grown by one pixel in all eight directions.

    With a list of bands a pixel is nodata where all of them are.
    """
    values = [value] if isinstance(value, str) else list(value)
    carry = [c for c in grid.columns if c not in (*keys, "x", "y")]
    empty = reduce(lambda a, b: a & b, [F.col(v).isNull() for v in values])
    near = focal.nearest_squared(grid, empty, 1, keys, block, carry)
    return near.withColumns({v: F.when(F.col("_d2").isNull(), F.col(v)) for v in values}).drop("_d2")


def distance_to_mask(grid: DataFrame, classes, reach: float, resolution=20.0, col="class",
                     keys=("scene_id",), block=focal.BLOCK) -> DataFrame:
    """Metres to the nearest pixel of the given classes; NULL beyond ``reach`` metres."""
    r = _pixels(reach, resolution)
    found = focal.nearest_squared(grid, F.col(col).isin(list(classes)), math.floor(r), keys, block)
    inside = F.col("_d2") <= F.lit(r * r + 1e-9)
    return found.select(*keys, "x", "y", F.when(inside, F.sqrt(F.col("_d2").cast("double")) * float(resolution)).alias("distance"))


def cloud_features(grid: DataFrame) -> DataFrame:
    """Add ``potential`` (spectral cloud test) and ``probability``."""
    b = role_columns(grid.columns)
    ndvi = F.coalesce(normalized(b["BNIR"], b["RED"]), F.lit(0.0))
    ndsi = F.coalesce(normalized(b["GREEN"], b["SWIR1"]), F.lit(0.0))
    mean = (b["BLUE"] + b["GREEN"] + b["RED"]) / 3
    spread = F.abs(b["BLUE"] - mean) + F.abs(b["GREEN"] - mean) + F.abs(b["RED"] - mean)
    with_white = grid.withColumns({"_ndvi": ndvi, "_ndsi": ndsi, "_white": F.coalesce(ratio(spread, mean), F.lit(1.0))})
    potential = (
        (b["SWIR2"] > 0.03) & (F.col("_ndsi") < 0.8) & (F.col("_ndvi") < 0.8) & (F.col("_white") < 0.7)
        & (b["BLUE"] - 0.5 * b["RED"] - 0.08 > 0) & (ratio(b["BNIR"], b["SWIR1"]) > 0.75)
    )
    probability = 1 - F.greatest(F.abs("_ndvi"), F.abs("_ndsi"), F.col("_white"))
    return with_white.withColumns({
        "potential": F.coalesce(potential, F.lit(False)), "probability": probability,
    }).drop("_ndvi", "_ndsi", "_white")


def classify_clouds(grid: DataFrame, cloud_threshold=0.225, shadow_threshold=0.02,
                    key="scene_id", block=focal.BLOCK, carry=(), sun=None, resolution=20.0, heights=(200, 12000)) -> DataFrame:
    """``cloud`` and ``shadow`` flags per pixel; columns named in ``carry`` are kept.

    Cloud: a potential pixel whose probability exceeds the scene's 82.5th
    percentile over clear pixels by the threshold.  Shadow: near infrared lower
    than its level with all hollows filled (``flood.fill_holes``) by more than
    the threshold and, where the sun's zenith and azimuth are given (numbers or
    columns), with a cloud towards the sun that may stand at one of ``heights``.
    """
    nir = role_columns(grid.columns)["BNIR"]
    pixels = cloud_features(grid).select(key, "x", "y", "potential", "probability", nir.alias("_nir"), *carry)
    clear = pixels.where(~F.col("potential") & F.col("_nir").isNotNull())
    limit = grouped_percentile(clear, [key], "probability", 0.825, "_limit")
    judged = attach(pixels, limit, [key], ["x", "y"])
    cloud = F.col("potential") & (F.col("probability") > F.coalesce(F.col("_limit"), F.lit(0.0)) + cloud_threshold)
    flagged = judged.withColumn("cloud", cloud).drop("_limit")
    level = flood.fill_holes(pixels, "_nir", (key,), block, "_level")
    sunk = flagged.join(level, [key, "x", "y"], "left")
    shadow = ~F.col("cloud") & F.coalesce(F.col("_level") - F.col("_nir") > shadow_threshold, F.lit(False))
    if sun is not None:
        sunk = lines.under_clouds(sunk, "cloud", sun, resolution, heights, key, "_under")
        shadow = shadow & F.col("_under")
    return sunk.select(key, "x", "y", *carry, "probability", "cloud", shadow.alias("shadow"))


def erase_clouds(df: DataFrame, bands, cloud: Column | None = None) -> DataFrame:
    """Reflectance becomes nodata under confident clouds; ``qai`` keeps its mark."""
    from pixelfold.functions.qai import has_flag
    cloud = has_flag("CLOUD_OPAQUE") if cloud is None else cloud
    return df.withColumns({b: F.when(~F.coalesce(cloud, F.lit(False)), F.col(b)) for b in bands})


def _median_of(values) -> Column:
    """Median of the non-NULL ones among a few columns."""
    near = F.array_sort(F.array_compact(F.array(*values)))
    low = F.get(near, F.floor((F.size(near) - 1) / F.lit(2.0)).cast("int"))
    return (low + F.get(near, F.floor(F.size(near) / F.lit(2.0)).cast("int"))) / 2


def impulse_noise(grid: DataFrame, limit: float, value="value", keys=("scene_id",), block=focal.BLOCK, carry=()) -> DataFrame:
    """Replace 8-bit values that differ from their 3x3 median by more than ``limit``.

    Values outside 0..255 are not 8-bit input and pass through unchanged.  One
    value becomes ``value`` with a ``replaced`` mark; a list keeps its names.
    Columns in ``carry`` are kept.
    """
    values = [value] if isinstance(value, str) else list(value)
    around = focal.windows3(grid, values, keys, block, carry)
    around = around.withColumns({f"_med_{v}": _median_of([F.col(f"{v}_{i}") for i in range(9)]) for v in values})

    def noisy(v):
        return F.coalesce(F.col(f"{v}_4").between(0, 255) & (F.abs(F.col(f"{v}_4") - F.col(f"_med_{v}")) > limit), F.lit(False))

    def clean(v):
        return F.when(noisy(v), F.col(f"_med_{v}")).otherwise(F.col(f"{v}_4").cast("double"))

    if isinstance(value, str):
        return around.select(*keys, "x", "y", *carry, clean(value).alias("value"), noisy(value).alias("replaced"))
    return around.select(*keys, "x", "y", *carry, *[clean(v).alias(v) for v in values])
