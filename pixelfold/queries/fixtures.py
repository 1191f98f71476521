"""The given tables read as observations, rasters and scenes; SQL twins below."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BANDS = ("BLUE", "GREEN", "RED", "RE1", "RE2", "RE3", "BNIR", "NIR", "SWIR1", "SWIR2")
FIRST, LAST, STEP = "1995-01-01", "2001-12-31", 16


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def obs_raw(spark, sf) -> DataFrame:
    """One acquisition per line item."""
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("pixel_id"),
        (F.col("l_suppkey") % 8).alias("tile_x"), (F.expr("l_suppkey div 8") % 8).alias("tile_y"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.when(F.col("l_returnflag") == "A", "SEN2A").when(F.col("l_returnflag") == "N", "SEN2B").otherwise("SEN2C").alias("sensor"),
        F.when(F.col("l_linestatus") == "F", "BOA").otherwise("IMP").alias("product"),
        ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 32768).alias("qai"),
        (F.col("l_extendedprice") / 100000).alias("value"))


def _cents():
    """Mean of the prices as an exact quotient of integer cents."""
    return F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).cast("double") / F.count(F.lit(1)) / 10000000


def obs(spark, sf) -> DataFrame:
    """One value per pixel and date; the aggregation combines before the shuffle."""
    return table(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").alias("pixel_id"), F.col("l_shipdate").cast("date").alias("date")
    ).agg(_cents().alias("value"), F.bit_or((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 32768).alias("qai"))


def tsi(spark, sf) -> DataFrame:
    """The linearly interpolated series."""
    from pixelfold.operators.interpolate import interp_linear
    return interp_linear(obs(spark, sf), FIRST, LAST, STEP)


def grid(spark, sf) -> DataFrame:
    """Rasters of 25 x 10 pixels with ten bands, a class and a height."""
    band = lambda i: (F.col("embedding")[i].cast("double") + 1) / 2
    return table(spark, sf, "embeddings").select(
        F.expr("vec_id div 250").alias("scene_id"), (F.col("vec_id") % 25).cast("int").alias("x"),
        F.expr("(vec_id % 250) div 25").cast("int").alias("y"),
        *[band(i).alias(b) for i, b in enumerate(BANDS)],
        F.col("label").alias("class"), (band(11) * 1000).alias("dem"))


def grid_big(spark, sf) -> DataFrame:
    """A large sparse raster: one pixel per (status, part, supplier)."""
    return table(spark, sf, "lineitem").groupBy(
        F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("scene_id"),
        F.col("l_partkey").cast("int").alias("x"), F.col("l_suppkey").cast("int").alias("y"),
    ).agg(F.min("l_linenumber").alias("class"), _cents().alias("value"), F.max("l_quantity").alias("byte"))


def scenes(spark, sf) -> DataFrame:
    c = F.col
    return table(spark, sf, "orders").select(
        c("o_orderkey").alias("item_id"), c("o_orderpriority").alias("collection"), c("o_orderdate").alias("datetime"),
        F.when(c("o_orderstatus") == "F", "sentinel-2a").when(c("o_orderstatus") == "O", "sentinel-2b").otherwise("sentinel-2c").alias("platform"),
        F.lit("msi").alias("instrument"), (F.round(c("o_totalprice") * 100).cast("bigint") % 101).alias("cloud_cover"),
        (c("o_custkey") % 360 - 180).cast("double").alias("west"), (c("o_orderkey") % 140 - 60).cast("double").alias("south"),
        (c("o_custkey") % 360 - 179).cast("double").alias("east"), (c("o_orderkey") % 140 - 59).cast("double").alias("north"),
        (c("o_custkey") % 10).alias("tile"))


def stream_obs(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", F.col("user_id").alias("pixel_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("sensor"), "value", F.get_json_object("props", "$.k").cast("int").alias("qai"))


def points(spark, sf) -> DataFrame:
    """Longitude and latitude per order."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("item_id"),
        ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % 3600 / 10 - 180).alias("lon"),
        (F.col("o_orderkey") % 1700 / 10 - 85).alias("lat"))


SQL = {
    "obs_raw": """
SELECT l_orderkey, l_linenumber, l_suppkey AS pixel_id, l_suppkey % 8 AS tile_x, (l_suppkey // 8) % 8 AS tile_y,
       cast(l_shipdate AS date) AS date,
       CASE l_returnflag WHEN 'A' THEN 'SEN2A' WHEN 'N' THEN 'SEN2B' ELSE 'SEN2C' END AS sensor,
       CASE l_linestatus WHEN 'F' THEN 'BOA' ELSE 'IMP' END AS product,
       (l_orderkey*7 + l_linenumber*13) % 32768 AS qai, l_extendedprice/100000 AS value
FROM lineitem""",
    "obs": """
SELECT l_suppkey AS pixel_id, cast(l_shipdate AS date) AS date,
       cast(sum(cast(round(l_extendedprice*100) AS bigint)) AS double)/count(*)/10000000 AS value,
       bit_or((l_orderkey*7 + l_linenumber*13) % 32768) AS qai
FROM lineitem GROUP BY ALL""",
    "dates": f"""
SELECT cast('{FIRST}' AS date) + cast(k*{STEP} AS integer) AS date
FROM range(0, (date '{LAST}' - date '{FIRST}')//{STEP} + 1) t(k)""",
    "pixels": "SELECT DISTINCT pixel_id FROM obs",
    "tsi": """
SELECT p.pixel_id, g.date,
       CASE WHEN a.date = g.date THEN a.value
            ELSE a.value + (b.value - a.value) * (cast(g.date - a.date AS double) / (b.date - a.date)) END AS value
FROM pixels p CROSS JOIN dates g
ASOF LEFT JOIN obs a ON a.pixel_id = p.pixel_id AND a.date <= g.date
ASOF LEFT JOIN obs b ON b.pixel_id = p.pixel_id AND b.date >= g.date""",
    "grid": "SELECT vec_id//250 AS scene_id, vec_id % 25 AS x, (vec_id % 250)//25 AS y, "
            + ", ".join(f"(cast(embedding[{i + 1}] AS double)+1)/2 AS {b}" for i, b in enumerate(BANDS))
            + ", label AS class, (cast(embedding[12] AS double)+1)/2*1000 AS dem FROM embeddings",
    "grid_big": """
SELECT CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS scene_id, l_partkey AS x, l_suppkey AS y,
       min(l_linenumber) AS class, cast(sum(cast(round(l_extendedprice*100) AS bigint)) AS double)/count(*)/10000000 AS value,
       max(l_quantity) AS byte
FROM lineitem GROUP BY 1, 2, 3""",
    "scenes": """
SELECT o_orderkey AS item_id, o_orderpriority AS collection, o_orderdate AS datetime,
       CASE o_orderstatus WHEN 'F' THEN 'sentinel-2a' WHEN 'O' THEN 'sentinel-2b' ELSE 'sentinel-2c' END AS platform,
       'msi' AS instrument, cast(round(o_totalprice*100) AS bigint) % 101 AS cloud_cover,
       cast(o_custkey % 360 - 180 AS double) AS west, cast(o_orderkey % 140 - 60 AS double) AS south,
       cast(o_custkey % 360 - 179 AS double) AS east, cast(o_orderkey % 140 - 59 AS double) AS north, o_custkey % 10 AS tile
FROM orders""",
    "stream_obs": """
SELECT event_id, user_id AS pixel_id, ts, event_type AS sensor, value,
       cast(json_extract_string(props,'$.k') AS int) AS qai FROM events""",
    "points": """
SELECT o_orderkey AS item_id, ((o_custkey*7 + o_orderkey) % 3600)/10 - 180 AS lon,
       (o_orderkey % 1700)/10 - 85 AS lat FROM orders""",
}
NEEDS = {"pixels": ("obs",), "tsi": ("obs", "pixels", "dates")}


def ctes(*names: str, **more: str) -> str:
    """``WITH`` clause of the named fixtures, what they need, and further queries."""
    ordered: list[str] = []

    def add(name):
        for n in NEEDS.get(name, ()):
            add(n)
        if name not in ordered:
            ordered.append(name)

    for n in names:
        add(n)
    parts = [f"{n} AS ({SQL[n].strip()})" for n in ordered] + [f"{n} AS ({q.strip()})" for n, q in more.items()]
    return "WITH " + ",\n".join(parts) + "\n"
