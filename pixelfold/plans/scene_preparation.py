"""From calibrated scenes to gridded, corrected and flagged reflectance."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelfold.functions.projections import GRIDS, project
from pixelfold.operators import flags, gridding, masks, merge, reflectance, resample, select
from pixelfold.operators.skew import attach
from pixelfold.plans.parameters import SceneParameters, read_parameters
from pixelfold.plans.series_analysis import band_columns
from pixelfold.session import scratch_path

KEY = ["scene_id", "x", "y"]
# What flags and corrections need on the way; not part of the reflectance product.
HELPERS = ("cloud", "cirrus", "shadow", "snow", "water", "slope", "aspect", "cos_i", "shaded", "aod", "aod_state")


def rings_of(aoi) -> list:
    """All rings of a GeoJSON polygon or multi-polygon feature, given as text or dict; inner rings are holes."""
    feature = json.loads(aoi) if isinstance(aoi, str) else aoi
    geometry = feature.get("geometry", feature)
    if geometry.get("type") == "Polygon":
        return list(geometry["coordinates"])
    if geometry.get("type") == "MultiPolygon":
        return [ring for polygon in geometry["coordinates"] for ring in polygon]
    raise ValueError("the area of interest must be a polygon")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later steps use their input several times; a written table keeps that to
    one computation and outlives lost executors.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def flag_masks(grid: DataFrame, p: SceneParameters, external_aod: DataFrame | None = None, aerosol_cell=256,
               aerosol_least=20) -> DataFrame:
    """Add the flags ``cloud, cirrus, shadow, snow, water``, what light and aerosol need, and the quality word.

    ``grid`` may carry ``class`` from an earlier step for cirrus and snow; without
    it the cirrus band tells cirrus and a spectral test snow.  Sun angles limit
    shadows to places that a cloud can shade and give, with ``dem``, the states of
    illumination; aerosol is looked at when the atmosphere is corrected.
    """
    sunny = {"sun_zenith", "sun_azimuth"} <= set(grid.columns)
    bands = band_columns(grid.columns)
    if sunny and "dem" in grid.columns:
        # read several times from here on, as are the classes below
        grid = stage(flags.light(grid, resolution=float(p.resolution)), "lit")
    carry = [c for c in grid.columns if c not in KEY]
    flagged = masks.classify_clouds(
        grid, p.cloud_threshold, p.shadow_threshold, carry=carry, sun=("sun_zenith", "sun_azimuth") if sunny else None,
        resolution=float(p.resolution)).drop("probability")
    if "class" in carry:
        cirrus, snow = F.col("class") == masks.CIRRUS, F.col("class") == masks.SNOW
    else:
        cirrus, snow = flags.cirrus(carry), flags.snow(carry) & ~F.col("cloud")
    flagged = flagged.withColumns({
        "cirrus": F.coalesce(cirrus, F.lit(False)), "snow": F.coalesce(snow, F.lit(False)), "water": flags.water(carry)})
    if p.do_atmo:
        flagged = stage(flagged, "classified")
        clear = ~(F.col("cloud") | F.col("cirrus") | F.col("shadow"))
        cells = flags.aerosol(flagged, clear if p.do_aod else F.lit(False), aerosol_cell, aerosol_least,
                              None if p.do_aod else external_aod)
        flagged = flags.with_aerosol(flagged, cells, aerosol_cell)
    buffers = {"cloud": p.cloud_buffer, "cirrus": p.cirrus_buffer, "shadow": p.shadow_buffer, "snow": p.snow_buffer}
    near = masks.buffer_masks(flagged, buffers, p.resolution)
    return flags.quality_word(near, bands).drop(*[f"near_{n}" for n in buffers])


def correct(grid: DataFrame, p: SceneParameters, lut=None, bands=(), reach=3, strength=0.1) -> DataFrame:
    """Atmosphere, terrain, adjacency and anisotropy, as switched on."""
    if p.do_atmo and lut is not None:
        grid = reflectance.atmo_correct(grid, lut, bands, True, p.do_multi_scattering)
    if p.do_topo and "dem" in grid.columns:
        if "cos_i" not in grid.columns:
            carry = [c for c in grid.columns if c not in KEY]
            grid = reflectance.terrain(grid, resolution=float(p.resolution), carry=carry).withColumn("cos_i", reflectance.illumination("sun_zenith", "sun_azimuth"))
        grid = reflectance.topo_correct(grid, bands, "sun_zenith")
    if p.do_atmo and p.do_adjacency:
        carry = [c for c in grid.columns if c not in (*KEY, *bands)]
        grid = reflectance.adjacency_correct(grid, bands, reach, strength, carry=carry)
    if p.do_brdf:
        grid = reflectance.brdf_adjust(grid, bands)
    return grid


def regrid(grid: DataFrame, step: float, method: str, bands) -> DataFrame:
    """All bands at ``step`` source pixels per target pixel; the other columns come from the nearest pixel."""
    if step == 1:
        return grid
    others = [c for c in grid.columns if c not in (*KEY, *bands)]
    if method in resample.AGGREGATES:
        if step != int(step):
            raise ValueError("aggregation needs a whole number of pixels per cell")
        joined = resample.aggregate_rows(grid, int(step), method, list(bands), others)
    else:
        near = resample.nearest_rows(grid, step, others, ["scene_id"])
        joined = near.join(resample.resample_interp(grid, step, method, list(bands)), ["scene_id", "tx", "ty"], "left")
    joined = joined.withColumnsRenamed({"tx": "x", "ty": "y"})
    types = dict(grid.dtypes)
    return joined.select([F.col(c).cast(types[c]).alias(c) for c in grid.columns])


def own_projection(name: str) -> tuple[str, float, float] | None:
    """Kind and centre (lon, lat) of a projection named ``LAEA <lat> <lon>`` or ``AEQD <lat> <lon>``."""
    words = name.split()
    kind = {"LAEA": "equal_area", "AEQD": "equidistant"}.get(words[0].upper())
    return (kind, float(words[2]), float(words[1])) if kind and len(words) == 3 else None


def place(df: DataFrame, p: SceneParameters, origin_xy, zones: DataFrame | None = None) -> DataFrame:
    """Zone and tile of every pixel.

    The two continental grids bring their own origin and tile size.  An
    azimuthal projection around a centre of its own (``own_projection``) counts
    tiles from ``origin_lon, origin_lat``.  Any other name means that ``px, py``
    are given in it, with ``origin_xy`` the projected origin.
    """
    if p.projection in GRIDS:
        return gridding.project_grid(df, p.projection, zones=zones)
    centred = own_projection(p.projection)
    if centred is not None:
        kind, lon0, lat0 = centred
        at = lambda lon, lat: project(lon, lat, F.lit(lon0), F.lit(lat0), kind)
        (px, py), (x0, y0) = at(F.col("lon"), F.col("lat")), at(F.lit(float(p.origin_lon)), F.lit(float(p.origin_lat)))
        # counted from the projected origin
        df, origin_xy = df.withColumns({"px": px - x0, "py": py - y0}), (0.0, 0.0)
    tiled = gridding.assign_tiles(df, p.tile_size, *origin_xy)
    return gridding.assign_blocks(
        tiled, p.block_size, None, p.tile_size, p.resolution, *origin_xy).withColumn("zone", F.lit(p.projection))


def prepare_scenes(grid: DataFrame, lut: DataFrame | None = None, coarse: DataFrame | None = None,
                   external_aod: DataFrame | None = None, eight_bit=(), input_resolution=None, origin_xy=(0.0, 0.0),
                   dst_reach=600, impulse_limit=32.0, adjacency_reach=3, adjacency_strength=0.1, overview_factor=10, aerosol_cell=256,
                   zones: DataFrame | None = None,
                   **parameters) -> dict[str, DataFrame]:
    """Products of the preparation: ``BOA`` (or ``TOA``) with ``qai``, and the optional ones.

    ``grid``: ``scene_id, x, y, lon, lat``, band roles, ``dem``, ``sun_zenith,
    sun_azimuth, view_zenith, rel_azimuth``; optional ``class`` and ``wvp``.
    Rasters are resampled first when ``input_resolution`` differs from ``resolution``.
    Distances reach ``dst_reach`` metres; the other limits (8-bit impulse, adjacency in
    pixels and strength, overview factor) are parameters too.
    A ``lut`` over aerosol and angles is interpolated for every pixel (see
    ``reflectance.atmo_correct``); aerosol is estimated in cells of ``aerosol_cell`` pixels.
    ``coarse`` holds further bands on cells of 2x2 pixels (``scene_id, cx, cy``).
    The flagged scenes are written to the shared folder when this is called;
    everything after that is lazy.
    """
    p = read_parameters(SceneParameters, parameters)
    if p.aoi is not None:
        grid = select.filter_aoi(grid, *rings_of(p.aoi))
    if eight_bit and p.impulse_noise:
        carry = [c for c in grid.columns if c not in (*KEY, *eight_bit)]
        grid = masks.impulse_noise(grid, float(impulse_limit), list(eight_bit), carry=carry)
    if input_resolution:
        grid = regrid(grid, p.resolution / input_resolution, p.resampling, band_columns(grid.columns))
    flagged = stage(flag_masks(grid, p, external_aod, aerosol_cell), "flagged")
    flagged = masks.cloud_cover_frame(flagged, p.max_cloud_cover_frame, cloud=F.col("cloud") | F.col("cirrus"))
    if coarse is not None:
        roles = [c for c in coarse.columns if c not in ("scene_id", "cx", "cy")]
        merged = merge.resolution_merge(
            flagged, coarse, band_columns(flagged.columns)[:3], p.res_merge, F.col("cloud") | F.col("shadow"), values=roles,
            tile=max(1, p.tile_size // (2 * p.resolution)))
        flagged = stage(flagged.join(merged, KEY, "left"), "merged")
    bands = band_columns(flagged.columns)
    hazy = reflectance.hot(flagged)
    corrected = correct(flagged, p, lut, bands, adjacency_reach, adjacency_strength)
    if p.erase_clouds:
        corrected = masks.erase_clouds(corrected, bands)
    if p.buffer_nodata:
        corrected = masks.buffer_nodata(corrected, bands)
    tiled = place(corrected, p, origin_xy, zones)
    tiled = masks.cloud_cover_tile(tiled, p.max_cloud_cover_tile, ("scene_id", "zone", "tile_x", "tile_y"), F.col("cloud") | F.col("cirrus"))
    # without coefficients nothing was corrected
    out = {"BOA" if p.do_atmo and lut is not None else "TOA": tiled.drop(*HELPERS)}
    coded = flagged.withColumn("class", F.when(F.col("cloud"), masks.OPAQUE).when(F.col("shadow"), masks.SHADOW).when(F.col("snow"), masks.SNOW))
    if p.output_dst:
        out["DST"] = masks.distance_to_mask(coded.select(*KEY, "class"), (masks.OPAQUE, masks.SHADOW, masks.SNOW), dst_reach, p.resolution)
    if p.output_aod:
        if "aod" in flagged.columns:
            out["AOD"] = flagged.select(*KEY, "aod", F.lower("aod_state").alias("source"))
        else:
            aod = reflectance.estimate_aod(flagged, None if p.do_aod else external_aod)
            out["AOD"] = attach(flagged.select(*KEY), aod, ["scene_id"], ["x", "y"])
    if p.output_wvp and "wvp" in flagged.columns:
        out["WVP"] = flagged.select(*KEY, "wvp")
    if p.output_vzn:
        out["VZN"] = flagged.select(*KEY, "view_zenith")
    if p.output_hot:
        out["HOT"] = hazy.select(*KEY, "hot")
    if p.output_ovv:
        any_band = lambda test: reduce(lambda a, b: a | b, [F.coalesce(test(F.col(b)), F.lit(False)) for b in bands])
        out["OVV"] = reflectance.overview(flagged, overview_factor, {
            "cloud": F.col("cloud"), "cirrus": F.col("cirrus"), "shadow": F.col("shadow"), "snow": F.col("snow"),
            "saturated": any_band(lambda b: b > 1), "subzero": any_band(lambda b: b < 0)})
    return out
