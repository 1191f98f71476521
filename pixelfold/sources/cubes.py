"""Reading observation cubes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelfold.operators import select


def scan_obs(spark: SparkSession, path: str, bands=None, extent=None, properties=None,
             rename=None, date_col="date") -> DataFrame:
    """Observations of a Parquet cube, limited to bands, dates and properties.

    ``extent`` may hold ``temporal`` = (start, end) and ``spatial`` = (west,
    south, east, north) over ``x, y``.  All limits are plain predicates on file
    columns, so they reach the scan; ``rename`` maps file columns to names.
    """
    df = spark.read.parquet(path)
    extent = extent or {}
    if "temporal" in extent:
        df = select.filter_temporal(df, *extent["temporal"], col=date_col)
    if "spatial" in extent:
        west, south, east, north = extent["spatial"]
        df = df.where(F.col("x").between(west, east) & F.col("y").between(south, north))
    if properties:
        df = select.filter_properties(df, properties)
    if bands:
        df = df.select(*bands)
    for old, new in (rename or {}).items():
        df = df.withColumnRenamed(old, new)
    return nan_to_null(df)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Nodata is NULL: Spark orders NaN above every number, which would spoil max and mean."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df
