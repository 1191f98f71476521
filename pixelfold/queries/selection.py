"""Queries over sources, catalog and selection operators."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import functions as F

from pixelfold.operators import area, user_fn
from pixelfold.operators import select as op
from pixelfold.queries import fixtures as fx
from pixelfold.queries.base import d, query, r, t
from pixelfold.queries.fixtures import ctes
from pixelfold.session import scratch_path
from pixelfold.sinks.collections import read_items, read_root, write_collection
from pixelfold.sources import catalog as cat
from pixelfold.sources.cubes import scan_obs

RING = ((-120.0, -40.0), (-20.0, -60.0), (60.0, -10.0), (150.0, 20.0), (30.0, 70.0), (0.0, 10.0), (-90.0, 55.0))
DATES = ("2023-06-01", "2023-06-04", "2023-06-07")


@query("scan_obs", f"""
SELECT l_suppkey AS pixel_id, {d('l_shipdate')} AS date, {r('l_extendedprice')} AS value FROM lineitem
WHERE l_shipdate >= '1996-01-01' AND l_shipdate < '1999-01-01'
  AND l_returnflag IN ('A', 'N') AND l_discount BETWEEN 0.02 AND 0.08""")
def _scan(spark, sf):
    return scan_obs(
        spark, f"{sf}/lineitem.parquet", bands=["l_suppkey", "l_shipdate", "l_extendedprice"],
        extent={"temporal": ("1996-01-01", "1999-01-01")},
        properties={"l_returnflag": ["A", "N"], "l_discount": (0.02, 0.08)}, date_col="l_shipdate",
        rename={"l_suppkey": "pixel_id", "l_shipdate": "date", "l_extendedprice": "value"},
    ).withColumn("date", F.col("date").cast("date"))


def catalog_documents(spark, sf):
    """One JSON document per collection, summarised from the scenes."""
    scenes = fx.scenes(spark, sf)
    bands = scenes.groupBy("collection", "tile").agg(F.count(F.lit(1)).alias("n")).groupBy("collection").agg(
        F.array_sort(F.collect_list(F.struct(
            F.concat(F.lit("B0"), F.col("tile")).alias("name"),
            F.when(F.col("tile") < 5, F.concat(F.lit("role"), F.col("tile"))).alias("common_name"),
            (F.col("tile") + 1.25).alias("center_wavelength"),
            (F.col("tile") % 3 * 10 + 10).cast("double").alias("gsd")))).alias("bands"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    facts = op.collection_extent(scenes, ["collection"]).join(bands, "collection")
    return facts.select(F.to_json(F.struct(
        F.col("collection").alias("id"), F.concat(F.lit("Scenes "), F.col("collection")).alias("title"),
        F.lit("proprietary").alias("license"),
        F.struct(
            F.struct(F.array(F.array("west", "south", "east", "north")).alias("bbox")).alias("spatial"),
            F.struct(F.array(F.array(stamp("start"), stamp("end"))).alias("interval")).alias("temporal")).alias("extent"),
        F.struct(F.struct(F.transform("bands", lambda b: b["name"]).alias("values")).alias("bands")).alias("cube:dimensions"),
        F.struct(F.col("bands").alias("eo:bands")).alias("summaries"),
        F.struct(F.lit("file").alias("type"), F.col("collection").alias("opensearch_collection_id"),
                 F.lit("https://example.org/search").alias("opensearch_endpoint")).alias("data_source"),
    )).alias("document"))


@query("load_catalog", ctes("scenes") + f"""
SELECT collection AS id, 'Scenes ' || collection AS title, 'proprietary' AS license,
       min(west) AS west, min(south) AS south, max(east) AS east, max(north) AS north,
       {t('min(datetime)')} AS "start", {t('max(datetime)')} AS "end",
       'https://example.org/search' AS endpoint, collection AS remote_id, count(DISTINCT tile) AS n_bands
FROM scenes GROUP BY collection""")
def _catalog(spark, sf):
    """Written as JSON files, one collection each, and read from them."""
    path = scratch_path(spark, "catalog")
    catalog_documents(spark, sf).repartition(8).write.text(path)
    parsed = cat.load_catalog(spark, path, lines=True)
    return parsed.withColumn("n_bands", F.size("band_names")).drop("bands", "band_names")


@query("catalog_bands", ctes("scenes") + """
SELECT DISTINCT collection AS id, 'B' || tile AS band, CASE WHEN tile < 5 THEN 'role' || tile END AS common_name,
       CASE WHEN tile + 1.25 < 3 THEN (tile + 1.25) * 10 ELSE tile + 1.25 END::double AS center_wavelength,
       (tile % 3 * 10 + 10)::double AS gsd
FROM scenes""")
def _bands(spark, sf):
    return cat.catalog_bands(cat.parse_catalog(catalog_documents(spark, sf)))


_FACET_SQL = " UNION ALL ".join(
    f"SELECT collection, '{name}' AS facet, {expr} AS value, count(*) AS items FROM scenes GROUP BY ALL"
    for name, expr in (
        ("year", "strftime(datetime, '%Y')"), ("month", "strftime(datetime, '%m')"), ("day", "strftime(datetime, '%d')"),
        ("platform", "platform"), ("instrument", "instrument")))


@query("catalog_facets", ctes("scenes", facets=_FACET_SQL) + f"""
SELECT collection, facet, value, items,
       CASE WHEN count(*) OVER (PARTITION BY collection, facet) = 1 THEN 'const' ELSE 'oneOf' END AS kind,
       NULL::varchar AS minimum, NULL::varchar AS maximum
FROM facets
UNION ALL
SELECT collection, 'datetime', NULL, count(*), 'range', {d('min(datetime)')}, {d('max(datetime)')} FROM scenes GROUP BY collection
UNION ALL
SELECT collection, 'cloud_cover', NULL, count(*), 'range', min(cloud_cover)::varchar, max(cloud_cover)::varchar
FROM scenes GROUP BY collection""")
def _facets(spark, sf):
    return cat.catalog_facets(fx.scenes(spark, sf))


@query("collection_extent", ctes("scenes") + f"""
SELECT collection, min(west) AS west, min(south) AS south, max(east) AS east, max(north) AS north,
       {t('min(datetime)')} AS "start", {t('max(datetime)')} AS "end", count(*) AS items
FROM scenes GROUP BY collection""")
def _extent(spark, sf):
    return op.collection_extent(fx.scenes(spark, sf), ["collection"])


@query("filter_temporal", ctes("scenes") + f"""
SELECT item_id, {t('datetime')} AS datetime FROM scenes
WHERE datetime >= '1996-03-01' AND datetime < '1998-09-15'""")
def _temporal(spark, sf):
    return op.filter_temporal(fx.scenes(spark, sf), "1996-03-01", "1998-09-15", "datetime").select("item_id", "datetime")


def temporal_text(spark, sf):
    """Order dates written in every accepted notation, and some that are not."""
    when = F.col("o_orderdate").cast("timestamp")
    seconds = (F.round(F.col("o_totalprice") * 100).cast("bigint") % 86400)
    clock = F.format_string("%02d:%02d:%02d", F.expr("s div 3600"), F.expr("s div 60 % 60"), F.col("s") % 60)
    n = F.col("o_orderkey") % 7
    text = (
        F.when(n == 0, F.concat(F.date_format(when, "yyyy-MM-dd"), F.lit("T"), clock, F.lit("Z")))
        .when(n == 1, F.concat(F.date_format(when, "yyyy-MM-dd"), F.lit("T"), clock, F.lit("+02:00")))
        .when(n == 2, F.date_format(when, "yyyy-MM-dd")).when(n == 3, F.date_format(when, "yyyy"))
        .when(n == 4, clock).when(n == 5, F.lit("not a date"))
    )
    return fx.table(spark, sf, "orders").withColumn("s", seconds).select(F.col("o_orderkey").alias("item_id"), text.alias("text"))


@query("parse_temporal", """
WITH base AS (
  SELECT o_orderkey, o_orderkey % 7 AS n, cast(o_orderdate AS date) AS day, cast(round(o_totalprice*100) AS bigint) % 86400 AS s
  FROM orders),
clock AS (SELECT *, printf('%02d:%02d:%02d', s//3600, s//60%60, s%60) AS c, strftime(day, '%Y-%m-%d') AS dt FROM base),
words AS (
  SELECT o_orderkey AS item_id,
    CASE n WHEN 0 THEN dt || 'T' || c || 'Z' WHEN 1 THEN dt || 'T' || c || '+02:00' WHEN 2 THEN dt
           WHEN 3 THEN strftime(day, '%Y') WHEN 4 THEN c WHEN 5 THEN 'not a date' END AS text FROM clock),
kinds AS (
  SELECT item_id, text,
    CASE WHEN text IS NULL THEN 'open'
         WHEN regexp_full_match(text, '\\d{4}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\d(Z|[+-]\\d\\d:\\d\\d)') THEN 'date-time'
         WHEN regexp_full_match(text, '\\d{4}-\\d\\d-\\d\\d') THEN 'date'
         WHEN regexp_full_match(text, '\\d{4}') THEN 'year'
         WHEN regexp_full_match(text, '\\d\\d:\\d\\d:\\d\\d') THEN 'time' ELSE 'invalid' END AS kind FROM words)
SELECT item_id, kind,
  CASE kind
    WHEN 'date-time' THEN epoch(strptime(text[1:19], '%Y-%m-%dT%H:%M:%S'))::bigint
         - CASE WHEN text LIKE '%Z' THEN 0 ELSE text[20:22]::bigint * 3600 END
    WHEN 'date' THEN epoch(strptime(text, '%Y-%m-%d'))::bigint
    WHEN 'year' THEN epoch(make_date(text::int, 1, 1))::bigint END AS epoch,
  CASE kind WHEN 'time' THEN text[1:2]::int * 3600 + text[4:5]::int * 60 + text[7:8]::int END AS day_second
FROM kinds""")
def _parse(spark, sf):
    parsed = op.parse_temporal(temporal_text(spark, sf), "text")
    return parsed.select("item_id", "kind", F.unix_seconds("instant").alias("epoch"), "day_second")


@query("filter_date_range", ctes("obs") + f"""
SELECT pixel_id, {d('date')} AS date, {r('value')} AS value FROM obs WHERE date BETWEEN '1997-02-01' AND '1999-11-30'""")
def _range(spark, sf):
    return op.filter_date_range(fx.obs(spark, sf), "1997-02-01", "1999-11-30").select("pixel_id", "date", "value")


@query("filter_doy_range", ctes("obs") + f"""
SELECT pixel_id, {d('date')} AS date, {r('value')} AS value FROM obs
WHERE dayofyear(date) >= 274 OR dayofyear(date) <= 90""")
def _doy(spark, sf):
    return op.filter_doy_range(fx.obs(spark, sf), 274, 90).select("pixel_id", "date", "value")


@query("filter_bbox", ctes("scenes") + """
SELECT item_id, west, south, east, north FROM scenes
WHERE NOT (west > 20 OR east < -30 OR south > 45.5 OR north < 10)""")
def _bbox(spark, sf):
    return op.filter_bbox(fx.scenes(spark, sf), -30.0, 10.0, 20.0, 45.5).select("item_id", "west", "south", "east", "north")


_EDGES = ", ".join(
    f"({a[0]}::double, {a[1]}::double, {b[0]}::double, {b[1]}::double)"
    for a, b in zip(RING, RING[1:] + RING[:1]))


@query("filter_aoi", ctes("points", edges=f"SELECT * FROM (VALUES {_EDGES}) e(x1, y1, x2, y2)") + f"""
SELECT item_id, {r('lon')} AS lon, {r('lat')} AS lat FROM points p JOIN edges e
  ON (e.y1 > p.lat) <> (e.y2 > p.lat) AND p.lon < (e.x2 - e.x1) * (p.lat - e.y1) / nullif(e.y2 - e.y1, 0) + e.x1
GROUP BY ALL HAVING count(*) % 2 = 1""")
def _aoi(spark, sf):
    return op.filter_aoi(fx.points(spark, sf), RING)


# Two wavy islands with a lake each: ring, middle, radius, waves; 10,000 corners altogether.
_COAST = ((0, -60.0, 10.0, 55.0, 9, 3000), (1, -60.0, 10.0, 21.0, 5, 2000), (2, 80.0, -20.0, 48.0, 13, 3500), (3, 90.0, -15.0, 12.0, 4, 1500))
_COAST_SQL = " UNION ALL ".join(
    f"SELECT {ring} AS ring, k, {n} AS n, {x}::double + {r0}::double*(1 + 0.2::double*sin({w}*2*pi()*k/{n}))*cos(2*pi()*k/{n}) AS x, "
    f"{y}::double + {r0}::double*(1 + 0.2::double*sin({w}*2*pi()*k/{n}))*sin(2*pi()*k/{n}) AS y FROM range({n}) t(k)"
    for ring, x, y, r0, w, n in _COAST)


@query("filter_area", ctes("points", coast=_COAST_SQL, edges="""
SELECT a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM coast a JOIN coast b ON a.ring = b.ring AND b.k = (a.k + 1) % a.n""") + f"""
SELECT item_id, {r('lon')} AS lon, {r('lat')} AS lat FROM points p JOIN edges e
  ON (e.y1 > p.lat) <> (e.y2 > p.lat) AND p.lon < (e.x2 - e.x1) * (p.lat - e.y1) / nullif(e.y2 - e.y1, 0) + e.x1
GROUP BY ALL HAVING count(*) % 2 = 1""")
def _area(spark, sf):
    """Points in an area of 10,000 corners, looked up by cell."""
    rings = spark.createDataFrame(_COAST, "ring int, x double, y double, r double, w int, n int")
    turn = 2 * math.pi * F.col("k") / F.col("n")
    out = F.col("r") * (1 + F.lit(0.2) * F.sin(F.col("w") * turn))
    corners = rings.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(
        "ring", "k", (F.col("x") + out * F.cos(turn)).alias("lon"), (F.col("y") + out * F.sin(turn)).alias("lat"))
    return area.filter_area(fx.points(spark, sf), area.corner_edges(corners, order="k"))


@query("filter_tile_range", ctes("obs_raw") + """
SELECT l_orderkey, l_linenumber, tile_x, tile_y FROM obs_raw WHERE tile_x BETWEEN 2 AND 5 AND tile_y BETWEEN 1 AND 4""")
def _tiles(spark, sf):
    return op.filter_tile_range(fx.obs_raw(spark, sf), (2, 5), (1, 4)).select("l_orderkey", "l_linenumber", "tile_x", "tile_y")


@query("filter_tile_allowlist", ctes("obs_raw") + """
SELECT l_orderkey, l_linenumber, tile_x, tile_y FROM obs_raw
WHERE tile_x BETWEEN 1 AND 6 AND (tile_x, tile_y) IN (SELECT (s_suppkey % 8, s_suppkey // 8 % 8) FROM supplier WHERE s_acctbal > 6000)""")
def _allow(spark, sf):
    tiles = fx.table(spark, sf, "supplier").where("s_acctbal > 6000").select(
        (F.col("s_suppkey") % 8).alias("tile_x"), (F.expr("s_suppkey div 8") % 8).alias("tile_y"))
    return op.filter_tile_allowlist(fx.obs_raw(spark, sf), tiles, x_range=(1, 6)).select(
        "l_orderkey", "l_linenumber", "tile_x", "tile_y")


def banded(spark, sf):
    """Long observations whose band numbers differ by sensor."""
    shift = F.when(F.col("sensor") == "SEN2A", 0).when(F.col("sensor") == "SEN2B", 2).otherwise(4)
    return fx.obs_raw(spark, sf).withColumn("band", F.concat(F.lit("B"), F.col("l_linenumber") + shift))


_BANDED = """
SELECT *, 'B' || (l_linenumber + CASE sensor WHEN 'SEN2A' THEN 0 WHEN 'SEN2B' THEN 2 ELSE 4 END) AS band FROM obs_raw"""


@query("filter_sensors", ctes("obs_raw", banded=_BANDED) + f"""
SELECT l_orderkey, l_linenumber, sensor, band, {r('value')} AS value FROM banded
WHERE sensor IN ('SEN2A', 'SEN2B') AND band IN (
  SELECT band FROM banded WHERE sensor = 'SEN2A' INTERSECT SELECT band FROM banded WHERE sensor = 'SEN2B')""")
def _sensors(spark, sf):
    long = banded(spark, sf)
    chosen = op.filter_sensors(long, ["SEN2A", "SEN2B"], long.select("sensor", "band"))
    return chosen.select("l_orderkey", "l_linenumber", "sensor", "band", "value")


@query("target_sensor", ctes("obs_raw") + f"""
SELECT l_orderkey, l_linenumber, 'SEN2L' AS sensor, {r('value')} AS "B4", {r('value*2')} AS "B8"
FROM obs_raw""")
def _target(spark, sf):
    raw = fx.obs_raw(spark, sf).select("l_orderkey", "l_linenumber", "sensor", F.col("value").alias("B4"), (F.col("value") * 2).alias("B8"))
    first = raw.where("sensor = 'SEN2A'").withColumn("B5", F.col("B4") * 3)
    rest = [raw.where("sensor = 'SEN2B'"), raw.where("sensor not in ('SEN2A', 'SEN2B')")]
    return op.target_sensor([first, *rest], "SEN2L", ["B4", "B8"])


@query("join_quality", ctes("obs_raw") + f"""
SELECT m.l_orderkey, m.l_linenumber, m.pixel_id, {d('m.date')} AS date, m.sensor, {r('m.value')} AS value, q.qai
FROM obs_raw m LEFT JOIN (
  SELECT pixel_id, date, sensor, bit_or(qai) AS qai FROM obs_raw WHERE product = 'IMP' GROUP BY ALL) q
  USING (pixel_id, date, sensor)
WHERE m.product = 'BOA'""")
def _quality(spark, sf):
    joined = op.join_quality(fx.obs_raw(spark, sf), "BOA", "IMP")
    return joined.select("l_orderkey", "l_linenumber", "pixel_id", "date", "sensor", "value", "qai")


@query("prefer_improphe", ctes("obs_raw") + f"""
SELECT m.l_orderkey, m.l_linenumber, {r('coalesce(e.value, m.value)')} AS value, e.value IS NOT NULL AS enhanced
FROM obs_raw m LEFT JOIN (
  SELECT pixel_id, date, sensor, max(value) AS value FROM obs_raw WHERE product = 'IMP' GROUP BY ALL) e
  USING (pixel_id, date, sensor)
WHERE m.product = 'BOA'""")
def _improphe(spark, sf):
    raw = fx.obs_raw(spark, sf)
    merged = op.prefer_improphe(raw.where("product = 'BOA'"), raw.where("product = 'IMP'"), True)
    return merged.select("l_orderkey", "l_linenumber", "value", "enhanced")


@query("filter_properties", """
SELECT event_id, event_type FROM events
WHERE event_type IN ('click', 'view', 'error') AND json_extract_string(props, '$.k')::double BETWEEN 20 AND 75 AND value >= 5""")
def _properties(spark, sf):
    items = fx.table(spark, sf, "events").withColumnRenamed("props", "properties")
    kept = op.filter_properties(items, {"event_type": ["click", "view", "error"], "k": (20, 75), "value": (5.0, None)})
    return kept.select("event_id", "event_type")


@query("scatter_dates", ctes("scenes") + """
SELECT item_id, collection, request_date FROM scenes, (VALUES """ + ", ".join(f"('{x}')" for x in DATES) + ") v(request_date)")
def _scatter(spark, sf):
    return op.scatter_dates(fx.scenes(spark, sf), DATES).select("item_id", "collection", "request_date")


@query("merge_collections", ctes("scenes", parts="""
SELECT 0 AS part, item_id, collection, cloud_cover FROM scenes WHERE collection IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
UNION ALL SELECT 1, item_id, collection, cloud_cover + 1 FROM scenes WHERE cloud_cover <= 60
UNION ALL SELECT 2, item_id, collection, cloud_cover + 2 FROM scenes""") + """
SELECT item_id, collection, cloud_cover FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY part) AS n FROM parts) WHERE n = 1""")
def _merge(spark, sf):
    scenes = fx.scenes(spark, sf)
    pick = lambda df, k: df.select("item_id", "collection", (F.col("cloud_cover") + k).alias("cloud_cover"))
    return op.merge_collections(
        pick(scenes.where(F.col("collection").isin("1-URGENT", "2-HIGH", "3-MEDIUM")), 0),
        pick(scenes.where("cloud_cover <= 60"), 1), pick(scenes, 2))


@query("list_assets", ctes("scenes") + """
SELECT item_id, name, 's3://archive/' || collection || '/' || item_id || '/' || name AS href
FROM scenes, (VALUES ('data.tif'), ('meta.json'), ('quality.tif')) v(name)
WHERE name <> 'quality.tif' OR cloud_cover > 10""")
def _assets(spark, sf):
    href = lambda n: F.concat_ws("/", F.lit("s3://archive"), "collection", F.col("item_id").cast("string"), F.lit(n))
    names = ("data.tif", "meta.json")
    always = F.create_map(*[x for n in names for x in (F.lit(n), href(n))])
    more = F.when(F.col("cloud_cover") > 10, F.map_concat(always, F.create_map(F.lit("quality.tif"), href("quality.tif")))).otherwise(always)
    return op.list_assets(fx.scenes(spark, sf).withColumn("assets", more))


@query("list_folder", ctes("scenes") + """
SELECT 'collection=' || collection AS folder, count(DISTINCT item_id % 3) AS files, count(DISTINCT item_id % 3) AS filled FROM scenes GROUP BY 1""")
def _folder(spark, sf):
    """Files of written folders, listed without reading them."""
    path = scratch_path(spark, "listing")
    scenes = fx.scenes(spark, sf).withColumn("part", F.col("item_id") % 3).select("collection", "part", "item_id", "datetime")
    # one file for every rest in every collection
    scenes.repartition(64, "part", "collection").write.partitionBy("collection", "part").parquet(path)
    files = op.list_folder(spark, f"{path}/*/*", "*.parquet")
    return files.groupBy(F.get(F.split("path", "/"), F.size(F.split("path", "/")) - 3).alias("folder")).agg(
        F.count_distinct("path").alias("files"), F.count_if(F.col("length") > 0).alias("filled"))


@query("gather_result", ctes("scenes", wanted=f"""
SELECT item_id, k, collection, datetime, west, south, east, north, cloud_cover FROM scenes, range(3) t(k)
WHERE datetime >= '1996-01-01' AND datetime < '1999-01-01'""", kept="""
SELECT item_id * 10 + k AS item_id, west + k AS west, south, east + k AS east, north, datetime, collection FROM wanted WHERE cloud_cover * (k + 1) <= 120""") + f"""
SELECT 'gathered' AS id, count(*) AS item_count, min(west) AS west, min(south) AS south, max(east) AS east, max(north) AS north,
  {t('min(datetime)')} AS "start", {t('max(datetime)')} AS "end", true AS has_files, 'collection.json' AS root, false AS fallback,
  count(*) AS read_back, sum(item_id)::bigint AS ids FROM kept""")
def _gather(spark, sf):
    """Scatter by date, a user function on every unit, gather, and a collection whose root is written by the commit."""
    def judge(frame, context):
        seen = frame.assign(k=frame["request_date"].map(context["place"]))
        seen = seen[seen["cloud_cover"] * (seen["k"] + 1) <= context["limit"]]
        return seen.assign(item_id=seen["item_id"] * 10 + seen["k"], west=seen["west"] + seen["k"], east=seen["east"] + seen["k"])[
            ["item_id", "collection", "datetime", "west", "south", "east", "north"]]

    scenes = op.filter_temporal(fx.scenes(spark, sf), "1996-01-01", "1999-01-01", "datetime")
    units = op.scatter_dates(scenes, DATES).select("item_id", "collection", "datetime", "west", "south", "east", "north", "cloud_cover", "request_date")
    place = {dt.date.fromisoformat(day): k for k, day in enumerate(DATES)}
    judged = user_fn.apply_user_fn(
        units, ["request_date"], judge, "item_id long, collection string, datetime timestamp_ntz, west double, south double, east double, north double",
        {"place": place, "limit": 120}, parts=16)
    # sub-collections overlap; a repeated item is kept once
    merged = op.merge_collections(judged.where("item_id % 10 < 2"), judged)
    path = scratch_path(spark, "gathered")
    root = write_collection(merged, path, "gathered")
    found = op.pick_root(op.list_folder(spark, path).select(F.lit(1).alias("result_set"), "path"))
    name = F.lit("gathered").alias("id")
    items = read_items(spark, root).agg(F.count(F.lit(1)).alias("read_back"), F.sum("item_id").alias("ids")).select(name, "*")
    leaf = found.select(name, F.element_at(F.split("root", "/"), -1).alias("root"), "fallback")
    whole = read_root(spark, root).withColumn("has_files", F.col("files") > 0).drop("files")
    return whole.join(leaf, "id").join(items, "id")


@query("pick_root", """
WITH results AS (
  SELECT l_orderkey AS result_set, 'run/' || l_orderkey || '/' || CASE l_linenumber % 5 WHEN 0 THEN 'collection.json'
    WHEN 1 THEN 'catalog.json' WHEN 2 THEN 'item-' || l_partkey || '.json' ELSE 'band-' || l_partkey || '.tif' END AS path FROM lineitem),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY result_set ORDER BY
    CASE WHEN path LIKE '%/collection.json' THEN 0 WHEN path LIKE '%/catalog.json' THEN 1 ELSE 2 END, length(path), path) AS n
  FROM results WHERE path LIKE '%.json')
SELECT s.result_set, coalesce(p.path, 'collection.json') AS root, p.path IS NULL AS fallback
FROM (SELECT DISTINCT result_set FROM results) s LEFT JOIN ranked p ON p.result_set = s.result_set AND p.n = 1""")
def _root(spark, sf):
    n = F.col("l_linenumber") % 5
    part = F.col("l_partkey").cast("string")
    leaf = (F.when(n == 0, "collection.json").when(n == 1, "catalog.json")
            .when(n == 2, F.concat(F.lit("item-"), part, F.lit(".json"))).otherwise(F.concat(F.lit("band-"), part, F.lit(".tif"))))
    results = fx.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("result_set"), F.concat_ws("/", F.lit("run"), F.col("l_orderkey").cast("string"), leaf).alias("path"))
    return op.pick_root(results)


@query("check_nonempty", "SELECT count(*) AS n_rows, CASE WHEN count(*) > 0 THEN 'ok' ELSE 'warning' END AS status FROM lineitem")
def _nonempty(spark, sf):
    return op.check_nonempty(fx.obs_raw(spark, sf), fail=True)
