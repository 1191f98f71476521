"""Collections with a root written by the commit, folder listings, gathers of hot keys, and rows that pass through a coarser grid."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from pixelfold.operators import resample, select, user_fn
from pixelfold.plans.scene_preparation import regrid
from pixelfold.plans.series_analysis import degrade
from pixelfold.sinks import collections as col

ITEM = "item_id long, west double, south double, east double, north double, datetime timestamp_ntz"


def items(spark, rows, parts=3):
    up = lambda v: None if v is None else float(v + 1)
    full = [(i, w, None if s is None else float(s), up(w), up(s), None if d is None else dt.datetime(2020, 1, d)) for i, w, s, d in rows]
    return spark.createDataFrame(full, ITEM).repartition(parts)


def root_of(path):
    with open(f"{path}/{col.ROOT}") as f:
        return json.load(f)


def test_root_carries_extent_and_count(spark, tmp_path):
    path = str(tmp_path / "c")
    root = col.write_collection(items(spark, [(k, k * 2.0, -k, 1 + k) for k in range(9)]), path, "mine")
    document = root_of(path)
    assert document["item_count"] == 9 and document["id"] == "mine"
    assert document["extent"]["spatial"]["bbox"] == [[0.0, -8.0, 17.0, 1.0]]
    assert document["extent"]["temporal"]["interval"] == [["2020-01-01T00:00:00", "2020-01-09T00:00:00"]]
    assert sorted(r.item_id for r in col.read_items(spark, root).collect()) == list(range(9))
    row = col.read_root(spark, root).first()
    assert (row.item_count, row.west, row.files) == (9, 0.0, len(document["links"]))
    assert not [f for f in os.listdir(path) if f.startswith(".") and not f.endswith(".crc")]


def test_append_and_overwrite(spark, tmp_path):
    path = str(tmp_path / "c")
    col.write_collection(items(spark, [(1, 5.0, 5.0, 9)]), path)
    root = col.write_collection(items(spark, [(2, -5.0, 7.0, 3), (3, None, None, None)]), path)
    document = root_of(path)
    assert document["item_count"] == 3 and document["extent"]["spatial"]["bbox"] == [[-5.0, 5.0, 6.0, 8.0]]
    assert document["extent"]["temporal"]["interval"] == [["2020-01-03T00:00:00", "2020-01-09T00:00:00"]]
    assert sorted(r.item_id for r in col.read_items(spark, root).collect()) == [1, 2, 3]
    col.write_collection(items(spark, [(7, 0.0, 0.0, 1)]), path, mode="overwrite")
    assert [r.item_id for r in col.read_items(spark, root).collect()] == [7] and root_of(path)["item_count"] == 1
    assert len(os.listdir(f"{path}/items")) == 1


def test_empty_and_null_collections(spark, tmp_path):
    root = col.write_collection(items(spark, [(1, 0.0, 0.0, 1)]).where("false"), str(tmp_path / "e"))
    row = col.read_root(spark, root).first()
    assert (row.item_count, row.west, row.start, row.files) == (0, None, None, 0)
    root = col.write_collection(items(spark, [(1, None, None, None)]), str(tmp_path / "n"))
    row = col.read_root(spark, root).first()
    assert (row.item_count, row.west, row.start) == (1, None, None)


def test_failed_job_leaves_no_root(spark, tmp_path):
    path = str(tmp_path / "c")
    bad = items(spark, [(k, 0.0, 0.0, 1) for k in range(20)], 4).withColumn(
        "item_id", F.when(F.col("item_id") == 13, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("item_id")))
    with pytest.raises(Exception, match="stop"):
        col.write_collection(bad, path)
    assert not os.path.exists(f"{path}/{col.ROOT}")
    with pytest.raises(Exception, match="columns"):
        col.write_collection(spark.range(3), path)


def test_listing_is_shallow_and_reads_no_content(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.json", "b.tif", "sub/c.json"):
        (tmp_path / name).write_text("x" * len(name))
    listed = select.list_folder(spark, str(tmp_path))
    assert sorted((r.name, r.length) for r in listed.collect()) == [("a.json", 6), ("b.tif", 5)]
    assert [r.name for r in select.list_folder(spark, str(tmp_path), "*.json").collect()] == ["a.json"]
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    assert select.pick_root(listed.withColumn("result_set", F.lit(1))).first().root.endswith("a.json")


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_gather_of_a_hot_key(spark, partitions):
    """A third of all rows on one key, null keys, ids beyond 2^53; results do not depend on the partitions."""
    big = 2 ** 60 + 1
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(big)).when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 1000).alias("k"),
        (F.col("id") % 5).cast("string").alias("g"), F.col("id").cast("double").alias("v")).repartition(partitions)
    want = {(r.k, r.g): r.s for r in df.groupBy("k", "g").agg(F.sum("v").alias("s")).collect()}
    got = user_fn.agg_user_fn(df, ["k", "g"], lambda s: float(s.sum()), "v", parts=(4, 2), held_keys=500)
    assert {(r.k, r.g): r.result for r in got.collect()} == want and (big, "0") in want and (None, "0") in want


def test_hot_key_leaves_a_task_as_one_value(spark):
    df = spark.range(200_000).select(F.lit(1).alias("k"), F.lit(1.0).alias("_v")).coalesce(2)
    merged = df.mapInArrow(user_fn._merged_batches(["k"], lambda s: float(s.sum()), 10), df.schema)
    assert [r._v for r in merged.collect()] == [100_000.0] * 2
    assert user_fn.agg_user_fn(df.where("false"), ["k"], lambda s: float(s.sum()), "_v").count() == 0


def test_rows_pass_unchanged_to_a_coarser_grid(spark):
    big = 2 ** 60 + 7
    rows = [(1, x, y, 0.1 * x + y, big + 10 * x + y, f"t{x}{y}", None if x == 1 else 1.5) for x in range(6) for y in range(6)]
    df = spark.createDataFrame(rows, "scene_id long, x int, y int, RED double, code long, note string, wvp double")
    near = {(r.tx, r.ty): (r.code, r.note) for r in resample.nearest_rows(df, 3, ["code", "note"]).collect()}
    assert near == {(a, b): (big + 10 * (3 * a + 1) + 3 * b + 1, f"t{3 * a + 1}{3 * b + 1}") for a in range(2) for b in range(2)}
    for method in ("BL", "AVG"):
        out = regrid(df, 2, method, ["RED"])
        assert dict(out.dtypes) == dict(df.dtypes)
        assert all(r.code >= big and r.note.startswith("t") for r in out.collect())
    fine = resample.nearest_rows(df, 0.5, ["code"])
    assert fine.count() == 144 and fine.select("code").distinct().count() == 36


def test_degraded_series_keep_long_ids(spark):
    big = 2 ** 60 + 3
    rows = [(0, 0, dt.date(2020, 1, 1), "SEN2A", x, y, 5, big + x * 4 + y, 0.5) for x in range(4) for y in range(4)]
    df = spark.createDataFrame(rows, "tile_x int, tile_y int, date date, sensor string, x int, y int, qai int, pixel_id long, RED double")
    got = degrade(df, ["RED"], 2, False)
    assert {r.pixel_id for r in got.collect()} <= {r[7] for r in rows} and got.count() == 4
    assert {r.qai for r in degrade(df, ["RED"], 2, True).collect()} == {5}


def test_calls_of_a_gather_grow_with_the_keys_not_the_rows(spark, tmp_path):
    """Rare keys are not merged before the shuffle, where nearly every row would be a call."""
    calls = spark.sparkContext.accumulator(0)

    def total(values):
        calls.add(1)
        return float(values.sum())

    df = spark.range(60_000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 9).cast("double").alias("v")).repartition(4)
    want = {r.k: r.s for r in df.groupBy("k").agg(F.sum("v").alias("s")).collect()}
    got = {r.k: r.result for r in user_fn.agg_user_fn(df, ["k"], total, "v", parts=(4, 2)).collect()}
    assert got == want
    # 15 rows a key and task; seven pieces a key
    assert calls.value <= 12 * 1000


def test_row_function_by_the_batch(spark):
    """Rows without results are dropped, nulls reach the function, one row may have very many results."""
    df = spark.createDataFrame([(1, 2, "a"), (2, None, "b"), (3, 0, None), (2 ** 60 + 1, 25_001, "d")], "id long, n int, note string")

    def counted(n, note):
        for i in range(1 if n is None else n):
            yield i, None if i else note

    out = user_fn.expand_user_fn(df, counted, "i int, said string", ["n", "note"])
    rows = out.collect()
    assert out.columns == ["id", "n", "note", "i", "said"] and len(rows) == 2 + 1 + 25_001
    assert [(r.id, r.n, r.i, r.said) for r in rows if r.id < 9] == [(1, 2, 0, "a"), (1, 2, 1, None), (2, None, 0, "b")]
    assert {r.id for r in rows} == {1, 2, 2 ** 60 + 1}
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
