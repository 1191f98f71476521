import math
import random

import pytest
from pyspark.sql import functions as F

from pixelfold.functions.kernels import kernel_weight
from pixelfold.operators import focal, gridding, masks, merge, reflectance, resample, sar


def raster(spark, width, height, value=lambda x, y: 0, scene=0, kind="int"):
    rows = [(scene, x, y, value(x, y)) for x in range(width) for y in range(height)]
    return spark.createDataFrame(rows, f"scene_id int, x int, y int, class {kind}")


def as_map(df, col):
    return {(r.x, r.y): r[col] for r in df.collect()}


@pytest.mark.parametrize("block", [4, 256])
def test_distance_and_buffer_of_one_dot(spark, block):
    dot = raster(spark, 9, 9, lambda x, y: 1 if (x, y) == (4, 4) else 0)
    distance = as_map(masks.distance_to_mask(dot, [1], 60, 20, block=block), "distance")
    for (x, y), d in distance.items():
        true = math.hypot(x - 4, y - 4) * 20
        assert d == pytest.approx(true) if true <= 60 else d is None
    near = as_map(masks.buffer_mask(dot, 1, 40, 20, block=block), "buffered")
    assert sum(near.values()) == 13 and near[(6, 4)] and not near[(6, 5)]
    assert sum(as_map(masks.buffer_mask(dot, 1, 0, 20, block=block), "buffered").values()) == 1


def test_blocks_lose_no_neighbour_on_a_sparse_raster(spark):
    rng = random.Random(5)
    cells = {(rng.randrange(-40, 40), rng.randrange(-40, 40)): rng.randrange(3) for _ in range(900)}
    df = spark.createDataFrame([(0, x, y, c) for (x, y), c in cells.items()], "scene_id int, x int, y int, class int")
    got = as_map(masks.distance_to_mask(df, [1], 7, 1, block=8), "distance")
    for (x, y) in cells:
        best = min((math.hypot(x - a, y - b) for (a, b), c in cells.items() if c == 1), default=math.inf)
        assert got[(x, y)] == (pytest.approx(best) if best <= 7 else None)


def test_focal_steps_share_one_shuffle(spark):
    dot = raster(spark, 9, 9)
    plan = masks.distance_to_mask(dot, [1], 60)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    plan = reflectance.terrain(dot, 30, 90, dem="class")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_several_buffers_match_single_ones(spark):
    rng = random.Random(2)
    df = raster(spark, 20, 20, lambda x, y: rng.randrange(12)).select(
        "scene_id", "x", "y", (F.col("class") == 1).alias("cloud"), (F.col("class") == 2).alias("shadow"), "class")
    both = masks.buffer_masks(df, {"cloud": 50, "shadow": 20}, 10, block=8)
    for name, code, radius in (("cloud", 1, 50), ("shadow", 2, 20)):
        alone = masks.buffer_mask(df.select("scene_id", "x", "y", "class"), code, radius, 10)
        assert as_map(both, f"near_{name}") == as_map(alone, "buffered")


def test_buffer_nodata_grows_by_one_pixel(spark):
    df = raster(spark, 5, 5, lambda x, y: None if (x, y) == (2, 2) else 1)
    grown = as_map(masks.buffer_nodata(df.withColumnRenamed("class", "value")), "value")
    assert sorted(k for k, v in grown.items() if v is None) == [(x, y) for x in (1, 2, 3) for y in (1, 2, 3)]


def test_terrain_of_a_plane(spark):
    # rising 20 m per pixel of 20 m towards the east: 45 degrees, facing west
    plane = raster(spark, 5, 5, lambda x, y: 20.0 * x, kind="double")
    row = reflectance.terrain(plane, 0, 0, 20, "class").where("x = 2 and y = 2").first()
    assert row.slope == pytest.approx(45) and row.aspect == pytest.approx(270) and row.cos_i == pytest.approx(math.cos(math.pi / 4))
    # rising towards the north (smaller y): faces south
    plane = raster(spark, 5, 5, lambda x, y: -20.0 * y, kind="double")
    assert reflectance.terrain(plane, 0, 0, 20, "class").where("x = 2 and y = 2").first().aspect == pytest.approx(180)
    assert reflectance.terrain(plane, 0, 0, 20, "class").where("x = 0").first().slope is None


@pytest.mark.parametrize("method, reach", [("BL", 1), ("CC", 2), ("CSP", 2), ("LZ", 3)])
def test_kernels_sum_to_one_at_samples(spark, method, reach):
    t = spark.createDataFrame([(0.3 + i,) for i in range(-reach, reach)], "t double")
    total = t.agg(F.sum(kernel_weight(method, F.col("t")))).first()[0]
    assert total == pytest.approx(1.0, abs=0.02)


@pytest.mark.parametrize("method", ["NN", "BL", "CC", "CSP", "LZ"])
def test_interpolation_keeps_a_constant_and_the_grid(spark, method):
    flat = raster(spark, 8, 8, lambda x, y: 3.0, kind="double")
    out = resample.resample_interp(flat, 0.5, method, "class").collect()
    assert len(out) == 256 and all(r.value == pytest.approx(3.0) for r in out)
    same = as_map(resample.resample_interp(raster(spark, 6, 6, lambda x, y: float(x * y), kind="double"), 1, "CC", "class")
                  .withColumnsRenamed({"tx": "x", "ty": "y"}), "value")
    assert same[(3, 4)] == pytest.approx(12)


def test_aggregates_by_hand(spark):
    df = spark.createDataFrame([(0, 0, 0, 1), (0, 0, 1, 2), (0, 1, 0, 2), (0, 1, 1, 7)], "scene_id int, x int, y int, value int")
    row = resample.resample_agg(df, 2, resample.AGGREGATES).first()
    assert (row.AVG, row.MODE, row.MAX, row.MIN, row.MED, row.Q1, row.Q3, row.SUM) == (3.0, 2, 7, 1, 2.0, 1.75, 3.25, 12)
    assert row.RMS == pytest.approx(math.sqrt(58 / 4))


def test_sizes_must_divide(spark):
    with pytest.raises(ValueError):
        gridding.check_sizes(100000, None, 30)
    with pytest.raises(ValueError):
        gridding.check_sizes(30000, (0, 30000), 20)
    gridding.check_sizes(30000, (3000, 15000), 20)


@pytest.mark.parametrize("grid", ["GLANCE7", "EQUI7"])
def test_zones_of_known_places(spark, grid):
    places = {
        "Muscat": (58.4, 23.6, "AS"), "Riyadh": (46.7, 24.7, "AS"), "Jeddah": (39.2, 21.5, "AS"), "Sanaa": (44.2, 15.4, "AS"),
        "Jerusalem": (35.2, 31.8, "AS"), "Delhi": (77.2, 28.6, "AS"), "Cairo": (31.2, 30.0, "AF"), "Port Sudan": (37.2, 19.6, "AF"),
        "Asmara": (38.9, 15.3, "AF"), "Djibouti": (43.1, 11.6, "AF"), "Antananarivo": (47.5, -18.9, "AF"), "Arctic": (20.0, 86.0, "EU"),
        "Berlin": (13.4, 52.5, "EU"), "Lima": (-77.0, -12.0, "SA"), "Nuuk": (-51.7, 64.2, "NA"), "Darwin": (130.8, -12.5, "OC")}
    df = spark.createDataFrame([(n, lon, lat) for n, (lon, lat, _) in places.items()], "name string, lon double, lat double")
    assert {r["name"]: r.zone for r in gridding.project_grid(df, grid).collect()} == {n: z for n, (_, _, z) in places.items()}


def test_projection_centre_is_the_origin(spark):
    for name, lon, lat, zone in (("GLANCE7", 20.0, 55.0, "EU"), ("EQUI7", -97.5, 52.0, "NA")):
        row = gridding.project_grid(spark.createDataFrame([(lon, lat)], "lon double, lat double"), name).first()
        assert row.zone == zone and abs(row.px) < 1e-6 and abs(row.py) < 1e-6


def test_equidistant_keeps_distance_from_the_centre(spark):
    row = gridding.project_grid(spark.createDataFrame([(24.0, 54.0)], "lon double, lat double"), "EQUI7").first()
    assert row.px == pytest.approx(0, abs=1e-6) and row.py == pytest.approx(6370997.0 * math.pi / 180)


def test_lookup_by_hand(spark):
    lut = spark.createDataFrame([("VV", 0, 100.0, 0.0, 30.0), ("VV", 100, 200.0, 10.0, 40.0)], "polarisation string, line_pixel int, a double, noise double, incidence double")
    dn = spark.createDataFrame([("VV", 50, 300.0), ("VV", 100, 20.0), ("VV", 101, 5.0), ("VH", 50, 5.0)], "polarisation string, line_pixel int, dn double")
    rows = {(r.polarisation, r.line_pixel): r for r in sar.sar_backscatter(dn, lut, mask=True, ellipsoid_incidence_angle=True).collect()}
    assert rows[("VV", 50)].sigma0 == pytest.approx((300 ** 2 - 5) / 150 ** 2) and rows[("VV", 50)].ellipsoid_incidence_angle == 35
    assert rows[("VV", 100)].sigma0 == pytest.approx((400 - 10) / 200 ** 2)
    assert rows[("VV", 101)].sigma0 is None and rows[("VV", 101)]["mask"] == 2 and rows[("VH", 50)].sigma0 is None
    with pytest.raises(ValueError):
        sar.sar_backscatter(dn, lut, coefficient="gamma0")


def test_local_angle_on_a_slope(spark):
    lut = spark.createDataFrame([("VV", 0, 1.0, 0.0, 30.0), ("VV", 10, 1.0, 0.0, 30.0)], "polarisation string, line_pixel int, a double, noise double, incidence double")
    dn = spark.createDataFrame([("VV", 5, 1.0)], "polarisation string, line_pixel int, dn double")
    slope = spark.createDataFrame([("VV", 10.0, 90.0)], "polarisation string, slope double, aspect double")
    row = sar.sar_backscatter(dn, lut, elevation=slope, local_incidence_angle=True, contributing_area=True).first()
    assert row.local_incidence_angle == pytest.approx(20) and row.contributing_area == pytest.approx(1 / math.sin(math.radians(20)))
    raster = spark.createDataFrame([(5, 10.0, 90.0), (6, 0.0, 0.0)], "line_pixel int, slope double, aspect double")
    more = dn.unionByName(spark.createDataFrame([("VV", 6, 1.0), ("VV", 7, 1.0)], dn.schema))
    found = sar.sar_backscatter(more, lut, elevation=raster, local_incidence_angle=True, options={"elevation_key": ["line_pixel"]})
    angles = {r.line_pixel: r.local_incidence_angle for r in found.collect()}
    assert angles == {5: pytest.approx(20), 6: pytest.approx(30), 7: None}


def test_merge_none_copies_and_regression_recovers_a_plane(spark):
    fine = spark.createDataFrame([(0, x, y, float(x * x + y), float(x - y * y)) for x in range(8) for y in range(8)], "scene_id int, x int, y int, RED double, BNIR double")
    mean = fine.groupBy("scene_id", (F.floor(F.col("x") / 2)).cast("int").alias("cx"), (F.floor(F.col("y") / 2)).cast("int").alias("cy")).agg(
        (2 + 3 * F.avg("RED") - F.avg("BNIR")).alias("SWIR1"), F.avg("RED").alias("SWIR2"))
    copied = merge.resolution_merge(fine, mean, ["RED"], "NONE", values=["SWIR1"])
    assert copied.count() == 64 and copied.select("SWIR1").distinct().count() == 16
    exact = merge.resolution_merge(fine, mean, ["RED", "BNIR"], "REGRESSION", values=["SWIR1", "SWIR2"])
    for r in exact.join(fine, ["scene_id", "x", "y"]).collect():
        assert r.SWIR1 == pytest.approx(2 + 3 * r.RED - r.BNIR, abs=1e-6) and r.SWIR2 == pytest.approx(r.RED, abs=1e-6)
    for method in ("IMPROPHE", "STARFM"):
        flat = mean.withColumn("SWIR1", F.lit(5.0)).drop("SWIR2")
        assert {round(r.SWIR1, 9) for r in merge.resolution_merge(fine, flat, ["RED"], method, values=["SWIR1"]).collect()} == {5.0}


def test_nadir_needs_no_brdf_change(spark):
    df = spark.createDataFrame([(0.2, 35.0, 0.0, 10.0), (0.2, 35.0, 8.0, 10.0)], "RED double, sun_zenith double, view_zenith double, rel_azimuth double")
    a, b = [r.RED for r in reflectance.brdf_adjust(df).collect()]
    assert a == pytest.approx(0.2) and b != pytest.approx(0.2)


def test_atmosphere_switches(spark):
    grid = spark.createDataFrame([(0, 0, 0, 0.3)], "scene_id int, x int, y int, RED double")
    lut = spark.createDataFrame([(0, "RED", "multi", 0.9, 0.02, 0.8, 0.1), (0, "RED", "single", 0.9, 0.01, 0.9, 0.0)],
                                "scene_id int, band string, scattering string, tg double, rho_path double, t_total double, albedo double")
    y = 0.3 / 0.9 - 0.02
    assert reflectance.atmo_correct(grid, lut, ["RED"]).first().RED == pytest.approx(y / (0.8 + 0.1 * y))
    assert reflectance.atmo_correct(grid, lut, ["RED"], multi=False).first().RED == pytest.approx((0.3 / 0.9 - 0.01) / 0.9)
    assert reflectance.atmo_correct(grid, lut, ["RED"], do_atmo=False).first().RED == 0.3


def test_impulse_noise_leaves_wider_values_alone(spark):
    df = raster(spark, 3, 3, lambda x, y: 900 if (x, y) == (1, 1) else 10).withColumnRenamed("class", "value")
    assert as_map(masks.impulse_noise(df, 20), "value")[(1, 1)] == 900
    df = raster(spark, 3, 3, lambda x, y: 200 if (x, y) == (1, 1) else 10).withColumnRenamed("class", "value")
    assert as_map(masks.impulse_noise(df, 20), "value")[(1, 1)] == 10


def test_square_mean_matches_brute_force(spark):
    rng = random.Random(1)
    cells = {(rng.randrange(20), rng.randrange(20)): rng.random() for _ in range(150)}
    df = spark.createDataFrame([(0, x, y, v) for (x, y), v in cells.items()], "scene_id int, x int, y int, v double")
    got = as_map(focal.square_stat(df, ["v"], 3, "avg", block=6), "v_env")
    for (x, y) in cells:
        near = [v for (a, b), v in cells.items() if abs(a - x) <= 3 and abs(b - y) <= 3]
        assert got[(x, y)] == pytest.approx(sum(near) / len(near))


@pytest.mark.parametrize("reach", [3, 40])
def test_wide_distances_multiply_no_row(spark, reach):
    rng = random.Random(7)
    # a stretch without pixels, negative places, blocks far smaller than the reach
    cells = {(rng.randrange(-60, 60), rng.randrange(-60, 60)): int(rng.random() < 0.01) for _ in range(1500)}
    rows = [(2**60 + i, 0, x, y, c, {"k": str(i)}) for i, ((x, y), c) in enumerate(cells.items())]
    df = spark.createDataFrame(rows, "pixel_id long, scene_id int, x int, y int, class int, note map<string,string>")
    near = focal.nearest_each(df, {"one": (F.col("class") == 1, reach), "none": (F.col("class") == 5, 2)}, block=8, carry=["pixel_id", "note"])
    assert near.columns == ["scene_id", "x", "y", "pixel_id", "note", "d2_one", "d2_none"]
    plan = near._jdf.queryExecution().executedPlan().toString()
    # only the two that send mask pixels to the blocks around
    assert plan.count("Generate explode") == 2 and plan.count("Exchange hashpartitioning") == 1
    got = {(r.x, r.y): r for r in near.collect()}
    assert len(got) == len(cells)
    marks = [k for k, c in cells.items() if c]
    for i, (x, y) in enumerate(cells):
        inside = [(x - a) ** 2 + (y - b) ** 2 for a, b in marks if max(abs(x - a), abs(y - b)) <= reach]
        row = got[(x, y)]
        assert (row.d2_one, row.d2_none) == (min(inside, default=None), None)
        # identifiers and text pass unchanged
        assert (row.pixel_id, row.note) == (2**60 + i, {"k": str(i)})


def test_distances_of_an_empty_raster(spark):
    empty = raster(spark, 1, 1).where("x > 1")
    assert masks.distance_to_mask(empty, [1], 60).count() == 0


def test_windows_carry_other_columns(spark):
    df = raster(spark, 6, 6, lambda x, y: 200 if (x, y) == (3, 3) else 10).withColumn("pixel_id", F.lit(2**60) + F.col("x") * 6 + F.col("y"))
    clean = masks.impulse_noise(df.withColumnRenamed("class", "byte"), 12, ["byte"], block=4, carry=["pixel_id"])
    assert {(r.x, r.y, r.pixel_id, r.byte) for r in clean.collect()} == {(x, y, 2**60 + x * 6 + y, 10.0) for x in range(6) for y in range(6)}
    lit = reflectance.terrain(df, 30, 90, dem="class", block=4, carry=["pixel_id"])
    assert lit.columns == ["scene_id", "x", "y", "pixel_id", "slope", "aspect", "cos_i"] and lit.where("pixel_id is null").count() == 0


@pytest.mark.parametrize("factor", [2, 3])
@pytest.mark.parametrize("method", resample.AGGREGATES)
def test_all_bands_of_a_cell_in_one_aggregate(spark, method, factor):
    rng = random.Random(3)
    df = raster(spark, 7, 7, lambda x, y: float(rng.randrange(5)), kind="double").withColumn("b", -F.col("class")).withColumn(
        "name", F.concat_ws(":", "x", "y")).where("not (x = 1 and y = 1)")
    got = resample.aggregate_rows(df, factor, method, ["class", "b"], ["name"])
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    names = {(r.tx, r.ty): r.name for r in resample.nearest_rows(df, factor, ["name"]).collect()}
    for v in ("class", "b"):
        alone = {(r.tx, r.ty): r.value for r in resample.resample(df, factor, method, v).collect()}
        assert {(r.tx, r.ty): (r[v], r.name) for r in got.collect()} == {k: (pytest.approx(alone[k]), n) for k, n in names.items()}


def test_cost_of_blocks_follows_their_pixels(spark):
    """Full and sparse blocks side by side, several blocks a batch, null and text keys, rows of one pixel."""
    rng = random.Random(11)
    cells = {("a", x, y) for x in range(20) for y in range(20)} | {(s, rng.randrange(400), rng.randrange(400)) for s in ("a", "b", None) for _ in range(700)}
    rows = [(s, x, y, rng.randrange(4), rng.random()) for s, x, y in cells]
    df = spark.createDataFrame(rows, "scene_id string, x int, y int, class int, v double")
    got = {(r.scene_id, r.x, r.y): r.distance for r in masks.distance_to_mask(df, [1], 9, 1, block=16).collect()}
    assert len(got) == len(rows)
    marks = {s: [(x, y) for t, x, y, c, _ in rows if t == s and c == 1] for s in ("a", "b", None)}
    for s, x, y, _, _ in rows:
        best = min(math.hypot(x - a, y - b) for a, b in marks[s])
        assert got[(s, x, y)] == (pytest.approx(best) if best <= 9 else None)
    value = {(s, x, y): v for s, x, y, _, v in rows}
    for r in focal.windows3(df, ["v"], block=16).collect():
        for i in range(9):
            assert r[f"v_{i}"] == value.get((r.scene_id, r.x + i % 3 - 1, r.y + i // 3 - 1))
    for r in focal.box_means(df, ["v"], 2, block=16).collect():
        near = [value[k] for dx in range(-2, 3) for dy in range(-2, 3) if (k := (r.scene_id, r.x + dx, r.y + dy)) in value]
        assert r.v_env == pytest.approx(sum(near) / len(near))
    plan = masks.distance_to_mask(df, [1], 9, 1)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan  # no call of Python for every block


def test_windows_multiply_no_rows_and_merge_rows_of_a_pixel(spark):
    nan = float("nan")
    rows = [(0, 0, 0, 1.0, "a"), (0, 0, 0, 3.0, None), (0, 1, 0, None, "b"), (0, 1, 0, nan, "c"), (0, 1, 0, 2.0, None), (0, 0, 1, None, None)]
    df = spark.createDataFrame(rows, "scene_id int, x int, y int, v double, note string")
    windows = focal.windows3(df, ["v"], carry=["note"])
    got = {(r.x, r.y): r for r in windows.collect()}
    assert {k: r.note for k, r in got.items()} == {(0, 0): "a", (1, 0): "c", (0, 1): None}
    assert got[(0, 0)].v_4 == 3.0 and math.isnan(got[(0, 0)].v_5) and got[(0, 0)].v_7 is None and got[(0, 1)].v_1 == 3.0
    plan = windows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "HashAggregate" not in plan and plan.count("Generate explode") == 2  # only copies of block rims
