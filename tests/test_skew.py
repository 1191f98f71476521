"""A third or more of the rows under one key must neither change results nor gather in one task."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pixelfold.operators import masks, sar, series, user_fn
from pixelfold.operators.skew import _octave_cell, attach, grouped_percentile


@pytest.fixture(scope="module")
def hot(spark):
    rng = random.Random(9)
    rows = [(0 if rng.random() < 0.4 else rng.randrange(1, 30), rng.choice([0.0, rng.gauss(0, 1), rng.random() * 1e6])) for _ in range(20000)]
    return spark.createDataFrame(rows, "scene_id int, v double")


@pytest.mark.parametrize("p, buckets", [(0.825, 1 << 20), (0.01, 4), (0.5, 2), (1.0, 8), (0.0, 8)])
def test_percentile_of_hot_groups_is_exact(hot, p, buckets):
    got = {r.scene_id: r.q for r in grouped_percentile(hot, ["scene_id"], "v", p, "q", buckets).collect()}
    for scene, values in hot.toPandas().groupby("scene_id")["v"]:
        assert got.pop(scene) == pytest.approx(float(np.quantile(values, p)), rel=1e-9, abs=1e-12)
    assert not got


@pytest.mark.parametrize("p", [0.1, 0.5, 0.825])
def test_percentile_with_outliers_of_two_scales(spark, p):
    rng = random.Random(4)
    values = [rng.random() for _ in range(20000)] + [-rng.random() * 1e-9 for _ in range(300)] + [1e30, 1e15, -1e25, 5e-324, 0.0, -0.0]
    df = spark.createDataFrame([(1, v) for v in values], "k int, v double")
    assert grouped_percentile(df, ["k"], "v", p, "q").first().q == pytest.approx(float(np.quantile(values, p)), rel=1e-12)
    # what the first counting leaves to the later ones is a small part of the group, outliers or not
    cells = df.groupBy(_octave_cell(F.col("v"))).count()
    assert cells.agg(F.max("count")).first()[0] < 100


def test_cells_keep_the_order_of_values(spark):
    rng = random.Random(5)
    values = sorted([0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, float("inf"), float("-inf"),
                     *(rng.choice([-1, 1]) * 2.0 ** rng.uniform(-1070, 1020) for _ in range(3000)),
                     *(x for e in range(-1074, 1023, 7) for x in (2.0 ** e, np.nextafter(2.0 ** e, 0)))])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    cells = [r.c for r in df.select("i", _octave_cell(F.col("v")).alias("c")).orderBy("i").collect()]
    assert cells == sorted(cells)


def test_percentile_of_small_and_constant_groups(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 1.0), (2, 2.0), (3, 7.0), (3, 7.0), (4, None)], "k int, v double")
    got = {r.k: r.q for r in grouped_percentile(df, ["k"], "v", 0.5, "q").collect()}
    assert got == {1: 5.0, 2: 1.5, 3: 7.0}


def test_attach_spreads_a_hot_key_and_keeps_all_rows(hot, spark):
    facts = spark.createDataFrame([(0, "hot"), (1, "one")], "scene_id int, name string")
    joined = attach(hot, facts, ["scene_id"], ["v"])
    assert joined.count() == 20000 and joined.columns == ["scene_id", "v", "name"]
    assert joined.where("name = 'hot'").count() == hot.where("scene_id = 0").count()
    copies = spark.range(8000, numPartitions=8).select(F.lit(0).alias("scene_id"), F.lit(1.0).alias("v"))
    salts = copies.withColumn("s", F.pmod(F.hash(F.spark_partition_id(), "v"), F.lit(32))).groupBy("s").count()
    assert salts.count() > 3  # copies of one row spread as well


def test_parts_of_a_hot_key_are_bounded(spark):
    df = spark.range(30000).select(F.when(F.col("id") < 20000, 0).otherwise(F.col("id") % 100).alias("k"), F.col("id").alias("v"))
    parts = user_fn.scatter_parts(df, ["k"], parts=20).groupBy("k", "part").count()
    assert parts.agg(F.max("count")).first()[0] < 1400 and parts.agg(F.sum("count")).first()[0] == 30000
    assert user_fn.scatter_parts(df, ["k"]).groupBy("k", "part").count().where("k = 0").first()["count"] == 20100


def test_user_function_and_gather_see_every_row(spark):
    df = spark.range(30000).select(F.when(F.col("id") < 20000, 0).otherwise(F.col("id") % 100).alias("k"), F.col("id").alias("v"))

    def partial(frame: pd.DataFrame, context: dict) -> pd.DataFrame:
        assert len(frame) < context["limit"]
        return pd.DataFrame({"k": [frame["k"].iloc[0]], "total": [frame["v"].sum()]})

    parts = user_fn.apply_user_fn(df, ["k"], partial, "k long, total long", {"limit": 1400}, parts=20)
    total = {r.k: r.t for r in parts.groupBy("k").agg(F.sum("total").alias("t")).collect()}
    want = {r.k: r.t for r in df.groupBy("k").agg(F.sum("v").alias("t")).collect()}
    assert total == want
    # the result of a unit does not depend on how many rows other keys have
    whole = user_fn.apply_user_fn(df, ["k"], partial, "k long, total long", {"limit": 10 ** 9}, parts=1)
    assert {r.k: r.total for r in whole.collect()} == want and whole.count() == len(want)
    top = user_fn.agg_user_fn(df, ["k"], lambda s: float(s.max()), "v", parts=(16, 4))
    assert {r.k: r.result for r in top.collect()} == {r.k: r.t for r in df.groupBy("k").agg(F.max("v").cast("double").alias("t")).collect()}


def test_null_keys_are_kept(spark):
    df = spark.createDataFrame([(None, 1.0), (1, 2.0), (1, 3.0)], "k int, v double")
    assert user_fn.scatter_parts(df, ["k"], 1).count() == 3


def test_hot_pixel_becomes_one_row_per_day(spark):
    raw = spark.range(100000).select(F.lit(1).alias("pixel_id"), F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 50).cast("int")).alias("date"),
                                     (F.col("id") % 7).cast("double").alias("value"))
    daily = series.daily_series(raw)
    assert daily.count() == 50
    plan = daily._jdf.queryExecution().executedPlan().toString()
    assert plan.index("functions=[avg") < plan.index("Exchange") < plan.index("partial_avg")  # combined before the shuffle


def test_hot_lookup_key(spark):
    rng = random.Random(1)
    nodes = sorted(rng.sample(range(1000), 40))
    lut = spark.createDataFrame([("a", x, float(x * x)) for x in nodes], "p string, x int, v double")
    positions = [500 if rng.random() < 0.5 else rng.randrange(1000) for _ in range(5000)]
    df = spark.createDataFrame([("a", x, i) for i, x in enumerate(positions)], "p string, x int, i int")
    got = {r.i: r.v for r in sar.lut_asof(df, lut, "x", ["p"], ["v"], block=64).collect()}
    assert len(got) == 5000
    for i, x in enumerate(positions):
        want = float(np.interp(x, nodes, [n * n for n in nodes])) if nodes[0] <= x <= nodes[-1] else None
        assert got[i] == (pytest.approx(want) if want is not None else None)


def test_cloudy_share_of_a_hot_scene(spark):
    scene = F.when(F.col("id") < 5000, 0).otherwise(F.col("id") % 10 + 1)
    df = spark.range(9000).select(scene.alias("scene_id"), F.when(scene == 0, F.col("id") % 10).otherwise(F.col("id") % 3).cast("int").alias("class"))
    clear = masks.cloud_cover_frame(df, 50.0)
    assert clear.count() == 5000 and [r.scene_id for r in clear.select("scene_id").distinct().collect()] == [0]
