import datetime as dt

import pytest
from pyspark.sql import functions as F

from pixelfold.operators import select
from pixelfold.sources import catalog, cubes, logs


def dates(spark, *texts):
    return spark.createDataFrame([(dt.date.fromisoformat(t),) for t in texts], "date date")


def listed(df, col="date"):
    return sorted(str(r[0]) for r in df.select(col).collect())


def test_filter_temporal_is_open_at_null_and_excludes_the_end(spark):
    df = dates(spark, "2015-01-01", "2015-06-01", "2016-01-01")
    assert listed(select.filter_temporal(df, "2015-01-01", "2016-01-01")) == ["2015-01-01", "2015-06-01"]
    assert listed(select.filter_temporal(df, None, "2015-06-01")) == ["2015-01-01"]
    assert listed(select.filter_temporal(df, "2015-06-01", None)) == ["2015-06-01", "2016-01-01"]
    assert select.filter_temporal(df, None, None).count() == 3


def test_date_range_includes_both_ends_also_on_timestamps(spark):
    df = dates(spark, "2015-01-01", "2015-06-01", "2016-01-01")
    assert select.filter_date_range(df, "2015-01-01", "2016-01-01").count() == 3
    stamped = df.select((F.col("date").cast("timestamp") + F.expr("interval 23 hours")).alias("date"))
    assert select.filter_date_range(stamped, "2015-01-01", "2016-01-01").count() == 3


def test_doy_range_wraps_the_year(spark):
    df = dates(spark, "2015-12-31", "2016-01-01", "2016-03-30", "2016-03-31", "2016-07-01", "2016-10-01")
    # 2016 is a leap year: 30 March is day 90, 1 October day 275
    assert listed(select.filter_doy_range(df, 274, 90)) == ["2015-12-31", "2016-01-01", "2016-03-30", "2016-10-01"]
    assert listed(select.filter_doy_range(df, 91, 273)) == ["2016-03-31", "2016-07-01"]
    with pytest.raises(ValueError):
        select.filter_doy_range(df, 0, 90)


@pytest.mark.parametrize("text, kind, instant", [
    ("2015-01-01T00:00:00Z", "date-time", "2015-01-01 00:00:00"),
    ("2015-01-01T02:00:00.5+02:00", "date-time", "2015-01-01 00:00:00.5"),
    ("2015-01-01", "date", "2015-01-01 00:00:00"), ("2015", "year", "2015-01-01 00:00:00"),
    ("23:59:00", "time", None), (None, "open", None), ("yesterday", "invalid", None), ("2015-13-45", "date", None)])
def test_parse_temporal(spark, text, kind, instant):
    row = select.parse_temporal(spark.createDataFrame([(text,)], "t string"), "t").select(
        "kind", F.col("instant").cast("string"), "day_second").first()
    assert row[0] == kind and row[1] == instant
    assert row[2] == (86340 if kind == "time" else None)


def test_aoi(spark):
    ring = [(10.5, 44.0), (10.5, 45.0), (11.5, 45.0), (11.5, 44.0), (10.5, 44.0)]
    df = spark.createDataFrame([(11.0, 44.5), (10.4, 44.5), (11.0, 45.1), (11.49, 44.01)], "lon double, lat double")
    assert sorted(tuple(r) for r in select.filter_aoi(df, ring).collect()) == [(11.0, 44.5), (11.49, 44.01)]


def test_merge_keeps_one_copy_however_many_there_are(spark):
    a = spark.range(1000).select(F.lit(7).alias("item_id"), F.lit("a").alias("v"), F.create_map(F.lit("k"), F.lit(1)).alias("properties"))
    b = spark.createDataFrame([(7, "b", {"k": 2}), (8, "b", {"k": 3})], "item_id int, v string, properties map<string,int>")
    assert sorted((r.item_id, r.v) for r in select.merge_collections(a, b).collect()) == [(7, "a"), (8, "b")]


def test_pick_root_prefers_the_requested_name(spark):
    rows = [("r", "x/catalog.json"), ("r", "x/mine.json"), ("s", "deep/er/a.json"), ("s", "b.json"), ("t", "a.tif")]
    df = spark.createDataFrame(rows, "result_set string, path string")
    found = {r.result_set: (r.root, r.fallback) for r in select.pick_root(df, "mine.json").collect()}
    assert found == {"r": ("x/mine.json", False), "s": ("b.json", False), "t": ("mine.json", True)}


def test_check_nonempty(spark):
    empty = spark.range(0)
    assert select.check_nonempty(empty).first().status == "warning"
    with pytest.raises(Exception, match="no rows were read"):
        select.check_nonempty(empty, fail=True).collect()


def test_join_quality_without_product(spark):
    df = spark.createDataFrame([(1, dt.date(2000, 1, 1), "A", "BOA", 4, 0.5)], "pixel_id int, date date, sensor string, product string, qai int, value double")
    assert select.join_quality(df, "BOA", None).first().qai is None
    assert select.join_quality(df, "BOA", "QAI").first().qai is None


def test_properties_from_map_and_json(spark):
    df = spark.createDataFrame([(1, {"eo:cloud_cover": "12.5"}), (2, {"eo:cloud_cover": "99"})], "i int, properties map<string,string>")
    assert [r.i for r in select.filter_properties(df, {"eo:cloud_cover": (0, 50)}).collect()] == [1]
    text = spark.createDataFrame([(1, '{"k": 3}'), (2, '{"k": 9}')], "i int, properties string")
    assert [r.i for r in select.filter_properties(text, {"k": (5, None)}).collect()] == [2]


def test_catalog_from_files(spark, tmp_path):
    document = """[{"id": "S2", "title": "t", "license": "proprietary",
      "extent": {"spatial": {"bbox": [[-7.9, 36.0, -4.0, 38.8]]}, "temporal": {"interval": [["2020-12-27T11:20:33.000000Z", null]]}},
      "cube:dimensions": {"bands": {"values": ["B01", "B8A", "B10"]}},
      "summaries": {"eo:bands": [{"name": "B01", "common_name": "coastal", "center_wavelength": 4.439, "gsd": 60},
                                 {"name": "B8A", "center_wavelength": 8.648, "gsd": 20}, {"name": "B10", "center_wavelength": 1.3735, "gsd": 60}]},
      "data_source": {"type": "file", "opensearch_endpoint": "https://example.org"}}]"""
    (tmp_path / "catalog.json").write_text(document)
    loaded = catalog.load_catalog(spark, str(tmp_path / "catalog.json"))
    row = loaded.first()
    assert (row.id, row.west, row.north, row.end, row.endpoint) == ("S2", -7.9, 38.8, None, "https://example.org")
    bands = {r.band: (r.common_name, round(r.center_wavelength, 4)) for r in catalog.catalog_bands(loaded).collect()}
    assert bands == {"B1": ("coastal", 4.439), "B8A": (None, 8.648), "B10": (None, 13.735)}


def test_facets_of_twenty_items(spark):
    """Days 30:4, 29:6, 27:10 and platforms 14 / 6 over one collection."""
    rows, n = [], 0
    for day, count in ((30, 4), (29, 6), (27, 10)):
        for _ in range(count):
            rows.append((n, "S2", dt.datetime(2020, 12, day, 11, 0), "sentinel-2b" if n < 14 else "sentinel-2a", "msi", n * 5))
            n += 1
    df = spark.createDataFrame(rows, "item_id int, collection string, datetime timestamp, platform string, instrument string, cloud_cover int")
    facets = {(r.facet, r.value): (r["items"], r.kind) for r in catalog.catalog_facets(df).collect()}
    assert facets[("day", "30")] == (4, "oneOf") and facets[("day", "29")] == (6, "oneOf") and facets[("day", "27")] == (10, "oneOf")
    assert facets[("platform", "sentinel-2b")] == (14, "oneOf") and facets[("platform", "sentinel-2a")] == (6, "oneOf")
    assert facets[("year", "2020")] == (20, "const") and facets[("instrument", "msi")] == (20, "const")


def test_scan_turns_nan_into_null(spark, tmp_path):
    path = str(tmp_path / "cube")
    spark.createDataFrame([(1, float("nan")), (2, 1.0)], "pixel_id int, v double").write.parquet(path)
    assert [r.v for r in cubes.scan_obs(spark, path).orderBy("pixel_id").collect()] == [None, 1.0]


def test_log_layouts(spark):
    lines = ['{"message":"m","levelname":"info","name":"n","filename":"f","job_id":"j","user_id":"u"}',
             '{"timestamp":"2024-01-01T00:00:00Z","levelname":"WARNING","message":"w"}', "broken {"]
    df = logs.parse_logs(spark.createDataFrame([(x,) for x in lines], "line string"))
    rows = {r.layout: r for r in df.collect()}
    assert rows["job"].job_id == "j" and rows["job"].levelname == "INFO" and rows["job"].bad_line is None
    assert str(rows["timestamped"].logged_at) == "2024-01-01 00:00:00"
    assert rows["other"].bad_line == "broken {"


def test_sensor_filter_keeps_copies_and_shared_bands(spark):
    rows = [(s, b, 1.0) for s in ("SEN2A", "SEN2B", "SEN2C") for b in ("B2", "B3") for _ in range(50)] + [("SEN2A", "B9", 2.0), (None, "B2", 3.0)]
    df = spark.createDataFrame(rows, "sensor string, band string, value double")
    known = spark.createDataFrame([("SEN2A", "B2"), ("SEN2B", "B2"), ("SEN2A", "B9"), ("SEN2A", "B2")], "sensor string, band string")
    got = select.filter_sensors(df, ["SEN2A", "SEN2B"], known)
    assert got.columns == df.columns
    assert {(r.sensor, r.band, r["count"]) for r in got.groupBy("sensor", "band").count().collect()} == {("SEN2A", "B2", 50), ("SEN2B", "B2", 50)}
