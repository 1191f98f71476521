"""Radar backscatter calibration and the as-of lookup under it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelfold.operators.skew import attach

COEFFICIENTS = ("sigma0-ellipsoid",)


def lut_blocks(lut: DataFrame, by, on: str, values, block: float) -> DataFrame:
    """Lookup segments gathered per key and block of the axis.

    Nodes of one position are merged (smallest value), so a key has at most as
    many nodes as the axis has positions.  A segment runs to the next node and
    is listed in every block it touches.
    """
    by = list(by)
    nodes = lut.groupBy(*by, F.col(on).cast("double").alias("_x0")).agg(*[F.min(v).cast("double").alias(f"_{v}0") for v in values])
    order = Window.partitionBy(*by).orderBy("_x0")
    following = {"_x1": F.lead("_x0").over(order)}
    following.update({f"_{v}1": F.lead(f"_{v}0").over(order) for v in values})
    segments = nodes.withColumns(following)
    cell = lambda c: F.floor(F.col(c) / F.lit(float(block)))
    listed = segments.withColumn("_block", F.explode(F.sequence(cell("_x0"), F.coalesce(cell("_x1"), cell("_x0")))))
    fields = ["_x0", "_x1", *[f"_{v}{i}" for v in values for i in (0, 1)]]
    return listed.groupBy(*by, "_block").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_segments"))


def lut_asof(df: DataFrame, lut: DataFrame, on: str, by, values, block=64.0, salts=1) -> DataFrame:
    """Linear interpolation between the nodes before and after ``on``, per ``by`` key.

    Every row meets the one segment list of its block, so rows are neither
    multiplied nor sorted, and a key that holds many rows is joined by as many
    tasks as it has blocks.  Where a single block is hot, ``salts`` above 1 joins
    it by more, at the cost of as many copies of the lists.  Outside the nodes the
    result is NULL.
    """
    by, values = list(by), list(values)
    blocks = lut_blocks(lut, by, on, values, block)
    x = F.col(on).cast("double")
    placed = df.withColumn("_block", F.floor(x / F.lit(float(block))))
    joined = attach(placed, blocks, [*by, "_block"], [c for c in df.columns if c not in by], salts=salts)
    holds = lambda s: (s["_x0"] <= x) & ((x < s["_x1"]) | (s["_x0"] == x))
    found = joined.withColumn("_s", F.get(F.filter("_segments", holds), F.lit(0)))
    out = {}
    for v in values:
        start, end = F.col(f"_s._{v}0"), F.col(f"_s._{v}1")
        share = (x - F.col("_s._x0")) / (F.col("_s._x1") - F.col("_s._x0"))
        out[v] = F.when(x == F.col("_s._x0"), start).otherwise(start + (end - start) * share)
    return found.withColumns(out).drop("_block", "_segments", "_s")


def sar_backscatter(dn: DataFrame, lut: DataFrame, coefficient="sigma0-ellipsoid", on="line_pixel", by=("polarisation",),
                    noise_removal=True, mask=False, contributing_area=False, local_incidence_angle=False,
                    ellipsoid_incidence_angle=False, elevation: DataFrame | None = None, options=None) -> DataFrame:
    """Radar brightness on the ellipsoid: (DN^2 - noise) / A^2.

    ``lut`` has calibration nodes ``a``, ``noise`` and ``incidence`` along the
    pixel axis.  ``elevation`` (``slope, aspect``, one row per pixel named by the columns
    in ``options['elevation_key']``, else one per ``by`` key) serves the angle bands.  ``options`` may set
    ``block`` and ``floor``, the value that replaces a negative noise-free power.
    """
    if coefficient not in COEFFICIENTS:
        raise ValueError(f"coefficient must be one of {COEFFICIENTS}")
    options = options or {}
    looked = lut_asof(dn, lut, on, by, ["a", "noise", "incidence"], options.get("block", 64.0))
    power = F.col("dn") * F.col("dn")
    if noise_removal:
        free = power - F.col("noise")
        power = F.when(free.isNotNull(), F.greatest(free, F.lit(float(options.get("floor", 0.0)))))
    gain = F.col("a") * F.col("a")
    columns = [*dn.columns, (power / F.nullif(gain, F.lit(0.0))).alias("sigma0")]
    local = F.col("incidence")
    if elevation is not None:
        if "elevation_key" in options:
            # a raster of its own: as many keys as pixels, so copies of it for a hot key would only cost
            key = list(options["elevation_key"])
            looked = looked.join(elevation.select(*key, "slope", "aspect").hint("merge"), key, "left")
        else:
            looked = attach(looked, elevation.select(*by, "slope", "aspect"), list(by), [on])
        look = F.radians(F.col("incidence"))
        tilt, facing = F.radians("slope"), F.radians(F.col("aspect") - float(options.get("look_azimuth", 90.0)))
        cosine = F.cos(look) * F.cos(tilt) + F.sin(look) * F.sin(tilt) * F.cos(facing)
        # greatest and least pass over NULL
        local = F.when(cosine.isNotNull(), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))
    if mask:
        columns.append(F.when(F.col("a").isNull(), 2).when(F.col("dn") == 0, 1).otherwise(0).alias("mask"))
    if contributing_area:
        columns.append((1 / F.nullif(F.sin(F.radians(local)), F.lit(0.0))).alias("contributing_area"))
    if local_incidence_angle:
        columns.append(local.alias("local_incidence_angle"))
    if ellipsoid_incidence_angle:
        columns.append(F.col("incidence").alias("ellipsoid_incidence_angle"))
    return looked.select(*columns)
