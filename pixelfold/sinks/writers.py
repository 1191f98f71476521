"""Writing products and describing what was written."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMATS = ("parquet", "orc")


def cube_name(name: str | None = None) -> str:
    return name or f"cube-{datetime.now(timezone.utc):%Y%m%dT%H%M%SZ}"


def _spread_bits(c: Column) -> Column:
    """The lower 31 bits of a number with a gap after each."""
    v = F.col(c).cast("long").bitwiseAND(F.lit((1 << 31) - 1)) if isinstance(c, str) else c
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def morton(x="x", y="y") -> Column:
    """Place of a pixel on a curve that keeps neighbours together; negative coordinates follow the others."""
    return _spread_bits(x).bitwiseOR(F.shiftleft(_spread_bits(y), 1))


def write_cube(df: DataFrame, base: str, name: str | None = None, tiles=("tile_x", "tile_y"),
               order=("pixel_id", "date"), mode="error", fmt="parquet", rows_per_file=5_000_000,
               cluster: tuple[str, str] | None = None, group_rows: int | None = None) -> str:
    """Write a product partitioned by tile below ``base`` and return its path.

    The rebalance hint gathers a tile's rows and splits a tile that is too
    large for one task, so a hot tile becomes several files.  With ``cluster``
    the rows of a file follow the Morton curve of these two columns, and groups of
    at most ``group_rows`` rows hold compact areas, so a scan for a small box
    skips the other groups by their smallest and largest coordinates.
    """
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    path = f"{base.rstrip('/')}/{cube_name(name)}"
    present = [c for c in order if c in df.columns]
    shaped = df.hint("rebalance", *tiles)
    along = [] if cluster is None else [morton(*cluster)]
    shaped = shaped.sortWithinPartitions(*tiles, *along, *present)
    writer = shaped.write.mode(mode).option("maxRecordsPerFile", rows_per_file)
    if group_rows:
        writer = writer.option("parquet.block.row.count.limit", group_rows)
    writer.partitionBy(*tiles).format(fmt).save(path)
    return path


def stac_result(written: DataFrame, base: str, name: str, tiles=("tile_x", "tile_y"), direct_s3=False,
                date="date", x="x", y="y") -> DataFrame:
    """One result item per written tile: box, interval, row count and address.

    ``document`` holds the item as JSON.  The address is public, or the
    ``s3://`` form when asked for.
    """
    root = base.rstrip("/")
    if direct_s3 and not root.startswith("s3://"):
        root = "s3://" + root.split("://")[-1].lstrip("/")
    href = F.format_string(f"{root}/{name}/tile_x=%d/tile_y=%d", *[F.col(t) for t in tiles])
    items = written.groupBy(*tiles).agg(
        F.min(x).alias("west"), F.min(y).alias("south"), F.max(x).alias("east"), F.max(y).alias("north"),
        F.min(date).cast("string").alias("start"), F.max(date).cast("string").alias("end"), F.count(F.lit(1)).alias("items"),
    ).select(
        F.format_string(f"{name}-X%04d_Y%04d", *[F.col(t) for t in tiles]).alias("id"),
        "west", "south", "east", "north", "start", "end", "items", href.alias("href"))
    document = F.to_json(F.struct(
        F.lit("Feature").alias("type"), F.col("id"), F.array("west", "south", "east", "north").alias("bbox"),
        F.struct("start", "end", F.col("items").alias("rows")).alias("properties"),
        F.struct(F.struct("href").alias("data")).alias("assets")))
    return items.withColumn("document", document)
