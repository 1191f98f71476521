"""Terrain, atmosphere, surface anisotropy and by-products of the correction chain."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelfold.functions.indices import role_columns
from pixelfold.operators import focal
from pixelfold.operators.skew import attach, grouped_percentile


def _angle(angle) -> Column:
    return F.radians(F.col(angle) if isinstance(angle, str) else F.lit(float(angle)))


def illumination(sun_zenith, sun_azimuth, slope="slope", aspect="aspect") -> Column:
    """Cosine of the sun's incidence on a slope; angles in degrees, as numbers or column names."""
    zenith, tilt = _angle(sun_zenith), F.radians(slope)
    return F.cos(zenith) * F.cos(tilt) + F.sin(zenith) * F.sin(tilt) * F.cos(_angle(sun_azimuth) - F.radians(aspect))


def terrain(grid: DataFrame, sun_zenith=None, sun_azimuth=None, resolution=20.0, dem="dem",
            keys=("scene_id",), block=focal.BLOCK, carry=()) -> DataFrame:
    """Slope and aspect in degrees from 3x3 windows, and the cosine of illumination for a given sun.

    ``y`` grows southwards.  Pixels without a full window get NULL.  Columns in
    ``carry`` are kept.
    """
    n = [F.col(f"n{i}") for i in range(9)]
    east = ((n[2] + 2 * n[5] + n[8]) - (n[0] + 2 * n[3] + n[6])) / (8 * resolution)
    south = ((n[6] + 2 * n[7] + n[8]) - (n[0] + 2 * n[1] + n[2])) / (8 * resolution)
    graded = focal.window3(grid, dem, keys, block, carry).withColumns({"_e": east, "_s": south})
    slope = F.degrees(F.atan(F.sqrt(F.col("_e") * F.col("_e") + F.col("_s") * F.col("_s"))))
    # direction of steepest descent, clockwise from north
    aspect = F.degrees(F.pmod(F.atan2(-F.col("_e"), F.col("_s")), F.lit(2 * math.pi)))
    shaped = graded.select(*keys, "x", "y", *carry, slope.alias("slope"), aspect.alias("aspect"))
    if sun_zenith is None:
        return shaped
    return shaped.withColumn("cos_i", illumination(sun_zenith, sun_azimuth))


def topo_correct(grid: DataFrame, bands, sun_zenith, cos_i="cos_i", keys=("scene_id",)) -> DataFrame:
    """C-correction of every band, with one regression on illumination per scene and band.

    ``grid`` carries the illumination.  A scene without a usable slope, and a
    pixel without illumination, keep their value.
    """
    keys, bands = list(keys), list(bands)
    fit = grid.groupBy(*keys).agg(*[
        (F.regr_intercept(b, cos_i) / F.nullif(F.regr_slope(b, cos_i), F.lit(0.0))).alias(f"_c_{b}") for b in bands])
    fitted = attach(grid, fit, keys, ["x", "y"])
    cos_sun = F.cos(_angle(sun_zenith))
    out = {}
    for b in bands:
        c = F.col(f"_c_{b}")
        out[b] = F.coalesce(F.col(b) * (cos_sun + c) / F.nullif(F.col(cos_i) + c, F.lit(0.0)), F.col(b))
    return fitted.withColumns(out).select(*grid.columns)


COEFFICIENTS = ("tg", "rho_path", "t_total", "albedo")
# Axes of a table of coefficients, and the most nodes an axis may have.
AXES = ("aod", "sun_zenith", "view_zenith")
MOST_NODES = 256


def _placed(value: Column, nodes: list[float]) -> tuple[Column, Column]:
    """Number of the interval of an axis and how far into it a value lies, from 0 to 1; values beyond the ends count as the ends."""
    if len(nodes) == 1:
        return F.lit(0), F.lit(0.0)
    at = reduce(lambda a, b: a + b, [(value >= n).cast("int") for n in nodes[1:-1]], F.lit(0))
    low, high = (F.get(F.lit(nodes[i:len(nodes) - 1 + i]), at) for i in (0, 1))
    return at, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))


def coefficient_cells(lut: DataFrame, bands, axes: dict[str, list[float]]) -> DataFrame:
    """One row per cell of the table's axes: ``_c_<axis>`` and per band the coefficients at its eight corners.

    ``_n_<band>`` is an array of the corners, an array of ``COEFFICIENTS`` each; a
    corner's number has bit i set if it is the upper end of axis i.
    """
    corners = lut.where(F.col("band").isin(list(bands)))
    number = F.lit(0)
    for i, (axis, nodes) in enumerate(axes.items()):
        at = (F.array_position(F.lit(nodes), F.col(axis)) - 1).cast("int")
        # a node is the lower end of its own cell and the upper end of the one before; a single node is both
        ends = ([F.struct(F.lit(0).alias("cell"), F.lit(b).alias("bit")) for b in (0, 1)] if len(nodes) == 1 else
                [F.when(at < len(nodes) - 1, F.struct(at.alias("cell"), F.lit(0).alias("bit"))),
                 F.when(at > 0, F.struct((at - 1).alias("cell"), F.lit(1).alias("bit")))])
        corners = corners.withColumn(f"_e_{axis}", F.explode(F.array_compact(F.array(*ends))))
        number = number + F.col(f"_e_{axis}.bit") * (1 << i)
    held = F.struct(number.alias("corner"), F.array(*[F.col(c).cast("double") for c in COEFFICIENTS]).alias("at"))
    cells = corners.groupBy(*[F.col(f"_e_{a}.cell").alias(f"_c_{a}") for a in axes]).agg(*[
        F.array_sort(F.collect_set(F.when(F.col("band") == b, held))).alias(f"_n_{b}") for b in bands])
    full = 1 << len(axes)
    return cells.select(*[f"_c_{a}" for a in axes], *[
        F.when(F.size(f"_n_{b}") == full, F.col(f"_n_{b}.at")).when(
            F.size(f"_n_{b}") > 0, F.raise_error(F.lit(f"the coefficients of {b} do not fill their axes once"))).alias(f"_n_{b}") for b in bands])


def _interpolated(grid: DataFrame, lut: DataFrame, bands) -> DataFrame:
    """Add ``_<coefficient>_<band>``, linear in every axis between the nodes of the table."""
    found = lut.agg(*[F.sort_array(F.collect_set(F.col(a).cast("double"))).alias(a) for a in AXES]).first()
    axes = {a: list(found[a]) for a in AXES}
    if any(not 0 < len(nodes) <= MOST_NODES for nodes in axes.values()):
        raise ValueError(f"every axis of the coefficients needs 1 to {MOST_NODES} nodes")
    placed = grid
    for a, nodes in axes.items():
        at, share = _placed(F.col(a), nodes)
        placed = placed.withColumns({f"_c_{a}": at, f"_s_{a}": share})
    joined = placed.join(coefficient_cells(lut, bands, axes), [f"_c_{a}" for a in axes], "left")
    weights = [reduce(lambda x, y: x * y, [F.col(f"_s_{a}") if k >> i & 1 else 1 - F.col(f"_s_{a}") for i, a in enumerate(axes)])
               for k in range(1 << len(axes))]
    joined = joined.withColumns({f"_w{k}": w for k, w in enumerate(weights)})
    return joined.withColumns({
        f"_{c}_{b}": reduce(lambda x, y: x + y, [F.col(f"_w{k}") * F.get(F.get(F.col(f"_n_{b}"), F.lit(k)), F.lit(j)) for k in range(len(weights))])
        for b in bands for j, c in enumerate(COEFFICIENTS)})


def atmo_correct(grid: DataFrame, lut: DataFrame, bands, do_atmo=True, multi=True, key="scene_id") -> DataFrame:
    """Top to bottom of atmosphere; off, reflectance passes through.

    ``lut``: ``band, scattering ('multi'|'single'), tg, rho_path, t_total, albedo``,
    with either ``scene_id``, one row per scene and band, or the ``AXES`` ``aod,
    sun_zenith, view_zenith``: a grid of nodes, between which coefficients are
    interpolated for the aerosol and the angles of every pixel.  Values beyond the
    nodes take those at the ends.
    """
    if not do_atmo:
        return grid
    bands = list(bands)
    wanted = lut.where((F.col("scattering") == ("multi" if multi else "single")) & F.col("band").isin(bands))
    joined = _interpolated(grid, wanted, bands) if "aod" in lut.columns else _by_scene(grid, wanted, bands, key)
    out = {}
    for b in bands:
        surface = F.col(b) / F.col(f"_tg_{b}") - F.col(f"_rho_path_{b}")
        out[b] = surface / (F.col(f"_t_total_{b}") + F.col(f"_albedo_{b}") * surface)
    return joined.withColumns(out).select(*grid.columns)


def _by_scene(grid: DataFrame, wanted: DataFrame, bands, key: str) -> DataFrame:
    wide = wanted.groupBy(key).agg(*[
        F.max(F.when(F.col("band") == b, F.col(n))).alias(f"_{n}_{b}") for b in bands for n in COEFFICIENTS])
    return attach(grid, wide, [key], ["x", "y"])


def optical_depth(darkest: Column, gain=5.0, dark=0.02) -> Column:
    """Aerosol optical depth from the reflectance of dark objects."""
    return F.greatest(F.lit(0.0), (darkest - dark) * gain)


def estimate_aod(grid: DataFrame, external: DataFrame | None = None, band="BLUE", key="scene_id",
                 gain=5.0, dark=0.02) -> DataFrame:
    """Aerosol optical depth per scene.

    The 1st percentile of the blue band stands for dark objects; its excess
    over ``dark`` maps linearly to optical depth.  Supplied values win.
    """
    low = grouped_percentile(grid, [key], band, 0.01, "_dark")
    internal = low.select(key, optical_depth(F.col("_dark"), gain, dark).alias("_internal"))
    if external is None:
        return internal.withColumnRenamed("_internal", "aod").withColumn("source", F.lit("internal"))
    return internal.join(external.select(key, F.col("aod").alias("_external")), key, "left").select(
        key, F.coalesce("_external", "_internal").alias("aod"),
        F.when(F.col("_external").isNotNull(), "external").otherwise("internal").alias("source"))


def adjacency_correct(grid: DataFrame, bands, reach: int, strength: float, keys=("scene_id",),
                      block=focal.BLOCK, carry=()) -> DataFrame:
    """Remove light scattered in from the surroundings: value + q * (value - mean of the square).

    Columns named in ``carry`` are kept.
    """
    around = focal.box_means(grid, bands, reach, keys, block, [*carry, *bands])
    return around.select(*keys, "x", "y", *[c for c in carry if c not in bands], *[
        (F.col(b) + F.lit(strength) * (F.col(b) - F.col(f"{b}_env"))).alias(b) for b in bands])


# Kernel weights per band role: isotropic, geometric, volumetric (fixed values).
BRDF_WEIGHTS = {
    "BLUE": (0.0774, 0.0079, 0.0372),
    "GREEN": (0.1306, 0.0178, 0.0580),
    "RED": (0.1690, 0.0227, 0.0574),
    "RE1": (0.2085, 0.0256, 0.0845),
    "RE2": (0.2316, 0.0273, 0.1003),
    "RE3": (0.2599, 0.0294, 0.1197),
    "BNIR": (0.3093, 0.0330, 0.1535),
    "NIR": (0.3093, 0.0330, 0.1535),
    "SWIR1": (0.3430, 0.0453, 0.1154),
    "SWIR2": (0.2658, 0.0387, 0.0639),
}


def _clip(col: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), col))


def ross_thick(sun: Column, view: Column, rel: Column) -> Column:
    """Volumetric kernel; angles in radians."""
    cosine = _clip(F.cos(sun) * F.cos(view) + F.sin(sun) * F.sin(view) * F.cos(rel))
    phase = F.acos(cosine)
    return ((math.pi / 2 - phase) * cosine + F.sin(phase)) / (F.cos(sun) + F.cos(view)) - math.pi / 4


def li_sparse(sun: Column, view: Column, rel: Column) -> Column:
    """Reciprocal geometric kernel for spherical crowns (b/r = 1) at relative height 2."""
    cosine = _clip(F.cos(sun) * F.cos(view) + F.sin(sun) * F.sin(view) * F.cos(rel))
    tan_s, tan_v = F.tan(sun), F.tan(view)
    sec = 1 / F.cos(sun) + 1 / F.cos(view)
    dist2 = F.greatest(F.lit(0.0), tan_s * tan_s + tan_v * tan_v - 2 * tan_s * tan_v * F.cos(rel))
    cross = tan_s * tan_v * F.sin(rel)
    cos_t = _clip(2 * F.sqrt(dist2 + cross * cross) / sec)
    t = F.acos(cos_t)
    overlap = (t - F.sin(t) * cos_t) * sec / math.pi
    return overlap - sec + 0.5 * (1 + cosine) / (F.cos(sun) * F.cos(view))


def brdf_adjust(df: DataFrame, bands=None, sun="sun_zenith", view="view_zenith", rel="rel_azimuth") -> DataFrame:
    """Nadir-view reflectance: value * model(sun, nadir) / model(sun, view); angles in degrees."""
    bands = [b for b in (bands or BRDF_WEIGHTS) if b in df.columns]
    s, v, r = F.radians(sun), F.radians(view), F.radians(rel)
    nadir = F.lit(0.0)
    shaped = df.withColumns({
        "_vol": ross_thick(s, v, r), "_geo": li_sparse(s, v, r),
        "_vol0": ross_thick(s, nadir, nadir), "_geo0": li_sparse(s, nadir, nadir),
    })
    out = {}
    for b in bands:
        iso, geo, vol = BRDF_WEIGHTS[b]
        top = F.lit(iso) + F.lit(geo) * F.col("_geo0") + F.lit(vol) * F.col("_vol0")
        bottom = F.lit(iso) + F.lit(geo) * F.col("_geo") + F.lit(vol) * F.col("_vol")
        out[b] = F.col(b) * top / F.nullif(bottom, F.lit(0.0))
    return shaped.withColumns(out).select(*df.columns)


def hot(df: DataFrame, name="hot") -> DataFrame:
    """Haze optimised transformation."""
    b = role_columns(df.columns)
    return df.withColumn(name, b["BLUE"] - 0.5 * b["RED"] - 0.08)


# Overlay colours by priority (fixed values): flag column -> colour.
OVERLAY = (("cloud", "pink"), ("cirrus", "red"), ("shadow", "cyan"), ("snow", "yellow"),
           ("saturated", "orange"), ("subzero", "green"))


def overview(grid: DataFrame, factor: int, flags: dict[str, Column], keys=("scene_id",)) -> DataFrame:
    """Coarse RGB (0..255) with the colour of the first overlay flag found in the cell."""
    b = role_columns(grid.columns)
    cell = lambda c: F.floor(F.col(c) / F.lit(float(factor))).cast("int")
    byte = lambda c: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.avg(c) * 255 + 0.5))).cast("int")
    present = [(name, colour) for name, colour in OVERLAY if name in flags]
    cells = grid.groupBy(*keys, cell("x").alias("cx"), cell("y").alias("cy")).agg(
        byte(b["RED"]).alias("r"), byte(b["GREEN"]).alias("g"), byte(b["BLUE"]).alias("b"),
        *[F.max(F.coalesce(flags[name], F.lit(False))).alias(f"_{name}") for name, _ in present])
    colour = F.lit("none")
    for name, shade in reversed(present):
        colour = F.when(F.col(f"_{name}"), shade).otherwise(colour)
    return cells.select(*keys, "cx", "cy", "r", "g", "b", colour.alias("overlay"))


# Optional products (fixed values).
PRODUCTS = ("DST", "AOD", "WVP", "VZN", "HOT", "OVV")


def emit_products(df: DataFrame, wanted: dict[str, str], ids=("scene_id", "x", "y")) -> DataFrame:
    """Long table (product, value) of the requested products; ``wanted`` maps a product to its column."""
    unknown = [p for p in wanted if p not in PRODUCTS]
    if unknown:
        raise ValueError(f"unknown products {unknown}")
    ordered = [p for p in PRODUCTS if p in wanted]
    renamed = df.select(*ids, *[F.col(wanted[p]).cast("double").alias(p) for p in ordered])
    return renamed.unpivot(list(ids), ordered, "product", "value").where(F.col("value").isNotNull())
