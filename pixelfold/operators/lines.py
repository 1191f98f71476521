"""Straight lines of pixels towards the sun.

A digital line takes one pixel from every column (or row, whichever the sun's
direction crosses faster), so every pixel lies on exactly one line of its
scene.  What stands between a pixel and the sun is then a window over its
line, and no window is longer than the side of a scene.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelfold.operators.skew import attach

# Tangents below this stand for a sun in the zenith.
LEAST_TANGENT = 1e-6


def scene_sun(grid: DataFrame, zenith="sun_zenith", azimuth="sun_azimuth", key="scene_id") -> DataFrame:
    """One row a scene: its mean zenith and azimuth in degrees, as ``_zenith, _azimuth``; NULL without any angle."""
    a = F.radians(azimuth)
    return grid.groupBy(key).agg(
        F.avg(zenith).alias("_zenith"), F.degrees(F.atan2(F.avg(F.sin(a)), F.avg(F.cos(a)))).alias("_azimuth"))


def with_sun(grid: DataFrame, sun, key="scene_id") -> DataFrame:
    """Add ``_zenith, _azimuth``: two numbers for all scenes, or the scenes' means of two columns."""
    zenith, azimuth = sun
    if not isinstance(zenith, str):
        return grid.withColumns({"_zenith": F.lit(float(zenith)), "_azimuth": F.lit(float(azimuth))})
    return attach(grid, scene_sun(grid, zenith, azimuth, key), [key], ["x", "y"])


def sun_lines(grid: DataFrame, resolution=20.0) -> DataFrame:
    """Add ``_line`` and ``_ahead``, metres along the line towards the sun; needs ``_azimuth`` (clockwise from north).

    ``y`` grows southwards.
    """
    a = F.radians("_azimuth")
    east, south = F.sin(a), -F.cos(a)
    wide = F.abs(east) >= F.abs(south)

    def on(major: str, minor: str, along: Column, across: Column) -> tuple[Column, Column]:
        tilt = across / along
        line = F.col(minor) - F.floor(tilt * F.col(major) + 0.5)
        return line, F.col(major) * F.signum(along) * F.sqrt(1 + tilt * tilt) * float(resolution)

    # the slower axis never divides: its tilt is not looked at
    by_x = on("x", "y", F.when(wide, east), south)
    by_y = on("y", "x", F.when(~wide, south), east)
    return grid.withColumns({"_line": F.coalesce(by_x[0], by_y[0]).cast("long"), "_ahead": F.coalesce(by_x[1], by_y[1])})


def terrain_shadow(grid: DataFrame, sun=("sun_zenith", "sun_azimuth"), resolution=20.0, dem="dem", key="scene_id", name="shaded") -> DataFrame:
    """Mark pixels that higher ground hides from the sun.

    Ground ahead hides a pixel if it rises above the ray to the sun, that is, if
    its height less the ray's rise is larger than the pixel's: one running maximum
    from the sunny end of every line.  Pixels without height neither hide nor are
    hidden; scenes without sun angles have no shade.
    """
    placed = sun_lines(with_sun(grid, sun, key), resolution)
    rise = 1 / F.greatest(F.tan(F.radians("_zenith")), F.lit(LEAST_TANGENT))
    reduced = placed.withColumn("_reduced", F.col(dem) - F.col("_ahead") * rise)
    ahead = Window.partitionBy(key, "_line").orderBy(F.desc("_ahead")).rowsBetween(Window.unboundedPreceding, -1)
    hidden = F.max("_reduced").over(ahead) > F.col("_reduced")
    marked = reduced.withColumn(name, F.coalesce(hidden, F.lit(False)))
    return marked.select(*grid.columns, name)


def under_clouds(grid: DataFrame, cloud="cloud", sun=("sun_zenith", "sun_azimuth"), resolution=20.0, heights=(200, 12000),
                 key="scene_id", name="under") -> DataFrame:
    """Mark pixels with a cloud towards the sun, so far away that it throws its shadow there from one of the ``heights`` in metres."""
    placed = sun_lines(with_sun(grid, sun, key), resolution)
    # on a line, the height at which something ahead would shade the pixel
    raised = placed.withColumn("_height", F.col("_ahead") / F.greatest(F.tan(F.radians("_zenith")), F.lit(LEAST_TANGENT)))
    low, high = (float(h) for h in heights)
    above = F.expr(f"max({cloud}) OVER (PARTITION BY {key}, _line ORDER BY _height RANGE BETWEEN {low}D FOLLOWING AND {high}D FOLLOWING)")
    return raised.withColumn(name, F.coalesce(above, F.lit(False))).select(*grid.columns, name)
