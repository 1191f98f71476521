"""Layer catalog: JSON documents that describe collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG_SCHEMA = """
    id string, title string, description string, license string,
    extent struct<
        spatial: struct<bbox: array<array<double>>>,
        temporal: struct<`interval`: array<array<string>>>>,
    `cube:dimensions` struct<bands: struct<`values`: array<string>>>,
    summaries struct<`eo:bands`: array<struct<
        name: string, common_name: string, center_wavelength: double, gsd: double>>>,
    data_source struct<type: string, opensearch_collection_id: string, opensearch_endpoint: string>
"""


def load_catalog(spark: SparkSession, path: str, lines=False) -> DataFrame:
    """Collections of the JSON files at ``path``: arrays or single objects, or one object a line."""
    return collection_rows(spark.read.schema(CATALOG_SCHEMA).json(path, multiLine=not lines))


def parse_catalog(documents: DataFrame, col="document") -> DataFrame:
    """Collections of a column that holds one JSON document per row."""
    return collection_rows(documents.select(F.from_json(col, CATALOG_SCHEMA).alias("d")).select("d.*"))


def collection_rows(raw: DataFrame) -> DataFrame:
    box = F.col("extent.spatial.bbox")[0]
    span = F.col("extent.temporal.interval")[0]
    return raw.select(
        "id", "title", "license",
        box[0].alias("west"), box[1].alias("south"), box[2].alias("east"), box[3].alias("north"),
        F.try_to_timestamp(span[0]).alias("start"), F.try_to_timestamp(span[1]).alias("end"),
        F.col("data_source.opensearch_endpoint").alias("endpoint"),
        F.col("data_source.opensearch_collection_id").alias("remote_id"),
        F.col("`cube:dimensions`.bands.values").alias("band_names"),
        F.col("summaries.`eo:bands`").alias("bands"),
    )


def short_band_name(col):
    return F.regexp_replace(col, "^B0", "B")


def catalog_bands(catalog: DataFrame) -> DataFrame:
    """One row per collection and band.

    Wavelengths come in two units: values below 3 are micrometres and are
    brought to the 0.1 micrometre of the others.
    """
    wavelength = F.col("b.center_wavelength")
    return catalog.select("id", F.explode("bands").alias("b")).select(
        "id", short_band_name(F.col("b.name")).alias("band"), F.col("b.common_name").alias("common_name"),
        F.when(wavelength < 3, wavelength * 10).otherwise(wavelength).alias("center_wavelength"),
        F.col("b.gsd").alias("gsd"),
    )


FACETS = ("year", "month", "day", "platform", "instrument")


def catalog_facets(scenes: DataFrame) -> DataFrame:
    """Summaries of a set of items, per collection.

    One row per facet value with its count; ``kind`` is ``const`` for a facet
    with a single value, else ``oneOf``.  Date and cloud cover give a ``range``
    row.  All facets are counted in one pass with grouping sets; the second
    aggregation only sees facet values.
    """
    base = scenes.select(
        "collection",
        F.date_format("datetime", "yyyy").alias("year"), F.date_format("datetime", "MM").alias("month"),
        F.date_format("datetime", "dd").alias("day"), "platform", "instrument",
    )
    sets = [[F.col("collection"), F.col(f)] for f in FACETS]
    counted = base.groupingSets(sets, F.col("collection"), *[F.col(f) for f in FACETS]).agg(
        F.count(F.lit(1)).alias("items"), F.grouping_id().alias("_gid"))
    last = len(FACETS) - 1
    facet = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    for i, f in enumerate(FACETS):
        in_set = F.shiftright(F.col("_gid"), last - i).bitwiseAND(F.lit(1)) == 0
        facet = F.when(in_set, f).otherwise(facet)
        value = F.when(in_set, F.col(f)).otherwise(value)
    listed = counted.select("collection", facet.alias("facet"), value.alias("value"), "items").where("value is not null")
    single = listed.groupBy("collection", "facet").agg(F.count(F.lit(1)).alias("_values"))
    values = listed.join(single, ["collection", "facet"]).select(
        "collection", "facet", "value", "items",
        F.when(F.col("_values") == 1, "const").otherwise("oneOf").alias("kind"),
        F.lit(None).cast("string").alias("minimum"), F.lit(None).cast("string").alias("maximum"),
    )
    ranged = scenes.groupBy("collection").agg(
        F.count(F.lit(1)).alias("items"),
        F.date_format(F.min("datetime"), "yyyy-MM-dd").alias("d0"), F.date_format(F.max("datetime"), "yyyy-MM-dd").alias("d1"),
        F.min("cloud_cover").cast("int").cast("string").alias("c0"), F.max("cloud_cover").cast("int").cast("string").alias("c1"),
    )
    ranges = ranged.select("collection", "items", F.inline(F.array(
        F.struct(F.lit("datetime").alias("facet"), F.col("d0").alias("minimum"), F.col("d1").alias("maximum")),
        F.struct(F.lit("cloud_cover").alias("facet"), F.col("c0").alias("minimum"), F.col("c1").alias("maximum")),
    ))).select(
        "collection", "facet", F.lit(None).cast("string").alias("value"), "items",
        F.lit("range").alias("kind"), "minimum", "maximum",
    )
    return values.unionByName(ranges)
