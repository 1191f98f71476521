"""Tiles, blocks and continental grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelfold.functions import projections as prj
from pixelfold.operators import area
from pixelfold.operators.skew import attach


def _floor(col):
    return F.floor(col).cast("int")


def tile_name(x="tile_x", y="tile_y"):
    return F.when(F.col(x).isNotNull(), F.format_string("X%04d_Y%04d", F.col(x), F.col(y)))


def assign_tiles(df: DataFrame, size=30000.0, x0=0.0, y0=0.0, x="px", y="py") -> DataFrame:
    """Tile numbers of projected coordinates, counted from the upper-left origin."""
    return df.withColumns({
        "tile_x": _floor((F.col(x) - x0) / F.lit(float(size))),
        "tile_y": _floor((F.lit(y0) - F.col(y)) / F.lit(float(size))),
    }).withColumn("tile", tile_name())


def check_sizes(tile, chunk=None, resolution=None):
    """A tile must be a whole number of chunks and both a whole number of pixels."""
    for width, height in ([chunk] if chunk else []):
        if not width or not height or tile % width or tile % height:
            raise ValueError("tile size must be divisible by the chunk size, which may not be 0")
        if resolution and (width % resolution or height % resolution):
            raise ValueError("chunk size must be divisible by the resolution")
    if resolution and tile % resolution:
        raise ValueError("tile size must be divisible by the resolution")


def assign_blocks(df: DataFrame, block=3000, chunk=None, tile=30000, resolution=20,
                  x0=0.0, y0=0.0, x="px", y="py") -> DataFrame:
    """Stripe number inside the tile and chunk numbers; the chunk defaults to the tile."""
    chunk = chunk or (tile, tile)
    check_sizes(tile, chunk, resolution)
    inside_x = F.pmod(F.col(x) - x0, F.lit(float(tile)))
    inside_y = F.pmod(F.lit(y0) - F.col(y), F.lit(float(tile)))
    return df.withColumns({
        "block": _floor(inside_y / float(block)),
        "chunk_x": _floor(inside_x / float(chunk[0])),
        "chunk_y": _floor(inside_y / float(chunk[1])),
    })


def project_grid(df: DataFrame, grid="GLANCE7", lon="lon", lat="lat", zones: DataFrame | None = None) -> DataFrame:
    """Continental zone, projected metres and tile of every lon/lat point; NULL outside all zones.

    ``zones`` is a table of the zones' polygons: ``zone, rank, lat0, lon0, ring,
    seq, lon, lat``, a row a corner; where zones overlap the smallest rank
    counts.  Without it the built-in boxes are a column expression and the plan
    stays a projection.  Tiles count from the zone's projection centre.
    """
    if zones is not None:
        return _project_zones(df, grid, lon, lat, zones)
    if grid not in prj.GRIDS:
        raise ValueError(f"grid must be one of {sorted(prj.GRIDS)}")
    zones, size, kind = prj.GRIDS[grid]

    def of_zone(position):
        return F.get(F.array(*[F.lit(z[position]) for z in zones]), F.col("_zone"))

    numbered = df.withColumn("_zone", prj.zone_number(F.col(lon), F.col(lat), zones))
    centred = numbered.withColumns({"zone": of_zone(0), "_lat0": of_zone(1), "_lon0": of_zone(2)})
    px, py = prj.project(F.col(lon), F.col(lat), F.col("_lon0"), F.col("_lat0"), kind)
    placed = centred.withColumns({"px": px, "py": py}).drop("_zone", "_lat0", "_lon0")
    return assign_tiles(placed, size)


def _project_zones(df: DataFrame, grid: str, lon: str, lat: str, zones: DataFrame) -> DataFrame:
    _, size, kind = prj.GRIDS[grid]
    found = area.find_zone(df, area.corner_edges(zones, ["zone", "rank"]), lon=lon, lat=lat)
    centres = zones.groupBy("zone").agg(F.first("lat0").alias("_lat0"), F.first("lon0").alias("_lon0"))
    centred = attach(found, centres, ["zone"], [lon, lat])
    px, py = prj.project(F.col(lon), F.col(lat), F.col("_lon0"), F.col("_lat0"), kind)
    placed = centred.withColumns({"px": px, "py": py}).drop("_lat0", "_lon0")
    return assign_tiles(placed.select(*df.columns, "zone", "px", "py"), size)
