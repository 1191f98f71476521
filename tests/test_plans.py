import datetime as dt
import json
import math
import random
from dataclasses import fields

import pytest
from pyspark.sql import functions as F

from pixelfold.operators import fold, interpolate, series, trend
from pixelfold.plans.parameters import SceneParameters, SeriesParameters, read_parameters
from pixelfold.plans.scene_preparation import prepare_scenes, rings_of
from pixelfold.plans.series_analysis import (
    analyse_series, analyse_together, index_series, index_series_of_rows, select_observations, select_rows, write_products)
from pixelfold.session import shared_dir
from pixelfold.sinks.writers import cube_name, stac_result, write_cube

DAY0 = dt.date(2001, 1, 1)


def test_parameters_go_by_their_names():
    # fixed names
    assert {"name", "aoi", "resolution", "projection", "resampling", "dem", "do_atmo", "cloud_buffer", "res_merge", "output_format",
            "do_topo", "do_brdf", "do_adjacency", "do_multi_scattering", "do_aod", "erase_clouds", "max_cloud_cover_frame", "max_cloud_cover_tile",
            "cirrus_buffer", "shadow_buffer", "snow_buffer", "cloud_threshold", "shadow_threshold", "impulse_noise", "buffer_nodata", "tile_size",
            "block_size", "origin_lon", "origin_lat"} <= {f.name for f in fields(SceneParameters)}
    assert {"name", "date_range", "chunk_size", "resolution", "sensors", "index", "standardize_tss", "interpolate", "int_day", "output_stm", "stm",
            "doy_range", "x_tile_range", "y_tile_range", "file_tile", "target_sensor", "screen_qai", "above_noise", "below_noise", "moving_max",
            "rbf_sigma", "rbf_cutoff", "harmonic_modes", "harmonic_trend", "fold_type", "trend_tail", "trend_conf", "change_penalty", "pol"} <= {
        f.name for f in fields(SeriesParameters)}


def test_tiles_count_from_the_origin_of_an_own_projection(spark):
    flags = dict(cloud_threshold=5.0, shadow_threshold=5.0, projection="LAEA 50 10", tile_size=30000, **QUIET)
    at_centre = prepare_scenes(scene(spark), origin_lon=9.0, origin_lat=51.0, **flags)["TOA"]
    moved = prepare_scenes(scene(spark), origin_lon=0.0, origin_lat=60.0, **flags)["TOA"]
    a, b = ({(r.tile_x, r.tile_y) for r in out.select("tile_x", "tile_y").distinct().collect()} for out in (at_centre, moved))
    assert min(a) >= (0, 0) and a != b and min(b)[0] > max(a)[0]
    assert at_centre.select("zone").distinct().collect()[0].zone == "LAEA 50 10"


def test_every_parameter_has_its_counterpart():
    assert len(fields(SeriesParameters)) == 67 and len(fields(SceneParameters)) == 35
    p = SeriesParameters(date_range=("2001-01-01", "2002-01-01"))
    assert (p.int_day, p.moving_max, p.rbf_sigma, p.rbf_cutoff) == (16, 16, (8, 16, 32), 0.95)
    assert (p.doy_range, p.harmonic_modes, p.trend_conf, p.target_sensor) == ((1, 366), 3, 0.95, "SEN2L")
    s = SceneParameters()
    assert (s.tile_size, s.block_size, s.origin_lon, s.origin_lat, s.resolution) == (30000, 3000, -25.0, 60.0, 20)
    assert (s.cloud_buffer, s.cirrus_buffer, s.shadow_buffer, s.snow_buffer) == (300, 0, 90, 30)
    assert (s.cloud_threshold, s.shadow_threshold, s.max_cloud_cover_frame, s.max_cloud_cover_tile) == (0.225, 0.02, 99, 99)
    assert all(isinstance(getattr(s, f.name), bool) for f in fields(s) if f.name.startswith("do_"))


@pytest.mark.parametrize("bad", [
    {"interpolate": "SPLINE"}, {"index": ("NOPE",)}, {"stm": ("Q00",)}, {"standardize_tss": "BOTH"}, {"trend_tail": "UP"},
    {"output_nrt": True}, {"screen_qai": ("FOG",)}, {"pol": ("ABC",)}, {"chunk_size": (0, 10)}, {"sensors": ("LND08",)}, {"nonsense": 1}])
def test_wrong_parameters_are_rejected(bad):
    with pytest.raises(ValueError):
        read_parameters(SeriesParameters, {"date_range": ("2001-01-01", "2002-01-01"), **bad})


@pytest.fixture(scope="module")
def cube(spark):
    rows = []
    for pixel in (1, 2):
        for i in range(0, 1090, 10):
            day = DAY0 + dt.timedelta(days=i)
            nir = 0.4 + 0.1 * math.sin(2 * math.pi * i / 365.25) + 0.01 * pixel
            sensor = ("SEN2A", "SEN2B")[i // 10 % 2]
            for product, qai in (("BOA", None), ("QAI", 4 if i % 70 == 0 else 0)):
                rows.append((pixel, pixel, 0, pixel, 0, day, sensor, product, qai, 0.1 if product == "BOA" else None, nir if product == "BOA" else None))
    return spark.createDataFrame(
        rows, "pixel_id long, tile_x int, tile_y int, x int, y int, date date, sensor string, product string, qai int, RED double, BNIR double")


RANGE = ("2001-01-01", "2003-12-31")


def same(a, b):
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_only_requested_products_are_made(cube):
    assert analyse_series(cube, date_range=RANGE) == {}
    out = analyse_series(cube, date_range=RANGE, index=("NDVI", "B8"), interpolate="LINEAR", output_tss=True, output_try=True, output_fbm=True)
    assert set(out) == {f"{i}_{p}" for i in ("NDVI", "B8") for p in ("TSS", "TRY", "FBM")}


def test_products_equal_the_operators(cube):
    out = analyse_series(
        cube, date_range=RANGE, interpolate="LINEAR", output_tss=True, output_tsi=True, output_stm=True, stm=("AVG", "Q50"),
        output_fby=True, output_try=True, output_cam=True, output_pol=True, pol=("VPS", "LGS"), output_tro=True, output_pct=True)
    ndvi = (F.col("BNIR") - F.col("RED")) / (F.col("BNIR") + F.col("RED"))
    flags = cube.where("product = 'QAI'").select("pixel_id", "date", F.col("qai").alias("q"))
    tss = series.daily_series(cube.where("product = 'BOA'").join(flags, ["pixel_id", "date"]).where("q = 0")
                              .select("pixel_id", "date", ndvi.alias("value")))
    same(out["NDVI_TSS"], tss)
    tsi = interpolate.interp_linear(tss, *RANGE)
    same(out["NDVI_TSI"], tsi)
    same(out["NDVI_STM"], fold.stm(tsi, ["AVG", "Q50"]))
    same(out["NDVI_TRY"], trend.trend(fold.fold(tsi, "Y")))
    same(out["NDVI_CAM"], trend.cat(fold.fold(tsi, "M")))
    assert {"NDVI_POL-VPS", "NDVI_POL-LGS", "NDVI_TRO-VPS", "NDVI_PCT"} <= set(out)


@pytest.mark.parametrize("more", [{}, {"above_noise": 3}, {"above_noise": 3, "below_noise": 1}, {"product_type_quality": None}])
@pytest.mark.parametrize("index", ["NDVI", "B8", "SMA"])
def test_one_pass_equals_the_joined_products(spark, more, index):
    rng = random.Random(3)
    rows = []
    for pixel in range(4):
        for _ in range(300):
            key = (pixel, 0, 0, DAY0 + dt.timedelta(days=rng.randrange(40)), rng.choice(["SEN2A", "SEN2B", "SEN2C", "LND08"]))
            qai = rng.choice([0, 0, 0, 4, 16, None])
            # copies of an acquisition, acquisitions without a quality row, missing bands, rows of a third product
            rows.append((*key, rng.choice(["BOA", "BOA", "QAI", "IMP"]), qai, rng.choice([0.1, 0.2, None]), rng.choice([0.4, 0.5, None])))
    df = spark.createDataFrame(
        rows, "pixel_id long, tile_x int, tile_y int, date date, sensor string, product string, qai int, RED double, BNIR double")
    p = read_parameters(SeriesParameters, {"date_range": RANGE, **more})
    ends = ("a", {"a": [0.1, 0.4], "b": [0.1, 0.1]}) if index == "SMA" else ()
    joined = index_series(select_observations(df, p), index, p, *ends)
    once = index_series_of_rows(select_rows(df, p), index, p, *ends)
    rounded = [F.col("pixel_id"), F.col("date"), F.round("value", 9).alias("value")]
    assert once.count() > 100
    same(joined.select(*rounded), once.select(*rounded))


def test_the_series_plan_scans_once_and_shuffles_by_day_and_pixel(spark, cube, tmp_path):
    cube.write.parquet(str(tmp_path / "cube"))
    read = spark.read.parquet(str(tmp_path / "cube"))
    plan = analyse_series(read, date_range=RANGE, interpolate="LINEAR", output_try=True)["NDVI_TRY"]
    text = plan._jdf.queryExecution().sparkPlan().toString()
    assert text.count("FileScan") == 1 and "Join" not in text
    assert plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") <= 3


def test_products_together_equal_those_of_each_index(spark, cube, tmp_path):
    cube.write.parquet(str(tmp_path / "cube"))
    read = spark.read.parquet(str(tmp_path / "cube"))
    flags = dict(date_range=RANGE, index=("NDVI", "B8", "SMA"), endmembers={"a": [0.1, 0.4], "b": [0.1, 0.1]}, interpolate="LINEAR",
                 above_noise=3, output_tss=True, output_try=True, output_cao=True, output_pol=True, pol=("VPS", "LGS"))
    single, together = analyse_series(read, **flags), analyse_together(read, **flags)
    assert set(together) == {"TSS", "TRY", "POL", "CAO"}
    for name, df in together.items():
        labels = [f"{i}_{name}" for i in ("NDVI", "B8", "SMA-a", "SMA-b")]
        for label in labels:
            one = df.where(F.col("index") == label.rsplit("_", 1)[0])
            if name in ("POL", "CAO"):
                for m in ("VPS", "LGS"):
                    same(one.where(F.col("metric") == m).drop("index", "metric"), single[f"{label}-{m}"])
            else:
                same(one.drop("index"), single[label])
    text = together["CAO"]._jdf.queryExecution().sparkPlan().toString()
    assert text.count("FileScan") == 1 and "Join" not in text


def test_series_can_be_shared_through_a_table(cube):
    flags = dict(date_range=RANGE, interpolate="RBF", output_fby=True, output_tsi=True)
    lazy, shared = analyse_series(cube, **flags), analyse_series(cube, share_series=True, **flags)
    same(lazy["NDVI_FBY"].select("pixel_id", "step", F.round("value", 9)), shared["NDVI_FBY"].select("pixel_id", "step", F.round("value", 9)))
    assert "Window" not in shared["NDVI_FBY"]._jdf.queryExecution().executedPlan().toString()


def test_extent_noise_harmonic_and_sensors(cube):
    out = analyse_series(cube, date_range=RANGE, x_tile_range=(1, 1), output_tss=True)["NDVI_TSS"]
    assert [r.pixel_id for r in out.select("pixel_id").distinct().collect()] == [1]
    out = analyse_series(cube, date_range=RANGE, file_tile=["X0002_Y0000"], output_tss=True, sensors=("SEN2A",), doy_range=(300, 60))["NDVI_TSS"]
    assert [r.pixel_id for r in out.select("pixel_id").distinct().collect()] == [2]
    assert out.where(F.dayofyear("date").between(61, 299)).count() == 0
    spoiled = cube.withColumn("BNIR", F.when((F.col("date") == "2001-04-21") & F.col("BNIR").isNotNull(), 0.11).otherwise(F.col("BNIR")))
    noisy = dict(date_range=RANGE, output_tss=True, above_noise=3, below_noise=1)
    kept = analyse_series(spoiled, **noisy)["NDVI_TSS"]
    assert kept.where("date = '2001-04-21'").count() == 0
    assert kept.where("date = '2001-03-12'").count() == 2  # screened, but fits its neighbours
    nrt = analyse_series(cube, date_range=RANGE, interpolate="HARMONIC", harmonic_modes=1, harmonic_trend=False,
                         harmonic_fit_range=("2001-01-01", "2002-12-31"), output_nrt=True)["NDVI_NRT"]
    assert nrt.count() > 0 and nrt.agg(F.max(F.abs("residual"))).first()[0] < 0.05


def test_enhanced_product_and_adjustment(cube):
    better = cube.where("product = 'BOA'").withColumns({"product": F.lit("IMP"), "BNIR": F.lit(0.9)})
    both = cube.unionByName(better)
    plain = analyse_series(both, date_range=RANGE, output_tss=True, index=("B8",))["B8_TSS"]
    used = analyse_series(both, date_range=RANGE, output_tss=True, index=("B8",), use_l2_improphe=True)["B8_TSS"]
    assert plain.where("value = 0.9").count() == 0 and used.where("value <> 0.9").count() == 0
    same_material = [{"name": "m", "spectrum": [0.1, 0.4], "transfer": {"RED": (0.0, {"RED": 1.0}), "BNIR": (0.5, {"BNIR": 0.0})}}]
    moved = analyse_series(cube, materials=same_material, date_range=RANGE, output_tss=True, index=("B8",), spectral_adjust=True)["B8_TSS"]
    assert [r.value for r in moved.select("value").distinct().collect()] == [0.5]
    mixed = analyse_series(cube, endmembers={"a": [0.1, 0.4], "b": [0.1, 0.1]}, date_range=RANGE, output_tss=True, index=("SMA",))
    assert set(mixed) == {"SMA-a_TSS", "SMA-b_TSS"}


def test_degrading_takes_the_nearest_flags(spark):
    rows = [(x * 10 + y, 0, 0, x, y, DAY0, "SEN2A", p, 0, 0.1 if p == "BOA" else None, 0.5 if p == "BOA" else None)
            for x in range(6) for y in range(6) for p in ("BOA", "QAI")]
    df = spark.createDataFrame(
        rows, "pixel_id long, tile_x int, tile_y int, x int, y int, date date, sensor string, product string, qai int, RED double, BNIR double")
    for psf in (False, True):
        out = analyse_series(df, input_resolution=10, date_range=RANGE, resolution=30, reduce_psf=psf, output_tss=True)["NDVI_TSS"]
        assert out.count() == 4 and all(r.value == pytest.approx(2 / 3) for r in out.collect())
    with pytest.raises(ValueError):
        analyse_series(df, date_range=RANGE, resolution=70)


def test_products_are_written_by_tile(spark, cube, tmp_path):
    p = SeriesParameters(date_range=RANGE, name="valley", fail_if_empty=True)
    products = analyse_series(cube, date_range=RANGE, output_tss=True, output_fby=True)
    pixels = cube.select("pixel_id", "tile_x", "tile_y").distinct()
    paths = write_products(products, pixels, str(tmp_path), p)
    assert paths["NDVI_TSS"].endswith("/valley/NDVI_TSS") and (tmp_path / "valley" / "NDVI_FBY" / "tile_x=1" / "tile_y=0").is_dir()
    back = spark.read.parquet(paths["NDVI_TSS"])
    assert back.count() == 2 and set(back.columns) == {"pixel_id", "stack", "tile_x", "tile_y"}
    assert cube_name().startswith("cube-") and cube_name("x") == "x"


def test_written_cube_reads_back_and_prunes(spark, cube, tmp_path):
    boa = cube.where("product = 'BOA'")
    path = write_cube(boa, str(tmp_path), "c")
    same(spark.read.schema(boa.schema).parquet(path).select(boa.columns), boa)
    plan = spark.read.parquet(path).where("tile_x = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tile_x" in plan
    items = stac_result(boa, "https://host/out", "c").collect()
    assert len(items) == 2 and items[0].href.startswith("https://host/out/c/tile_x=")
    document = json.loads(items[0].document)
    assert document["id"] == items[0].id and document["bbox"] == [items[0].west, 0, items[0].east, 0]
    assert stac_result(boa, "https://bucket/out", "c", direct_s3=True).first().href.startswith("s3://bucket/out/c/")


def scene(spark, size=12):
    rows = []
    for x in range(size):
        for y in range(size):
            bright = 1 if (x, y) == (3, 3) else 0
            rows.append((0, x, y, 10.5 + x * 0.001, 44.5 - y * 0.001, 0.08 + 0.02 * ((x * 7 + y) % 3) + 0.5 * bright, 0.1 + 0.5 * bright, 0.1 + 0.5 * bright,
                         0.3 + 0.3 * bright, 0.2 + 0.3 * bright, 0.1 + 0.3 * bright, 100.0 + 3 * x, 30.0, 120.0, 4.0, 50.0, 9 if y else 3, 1.5))
    names = "scene_id int, x int, y int, lon double, lat double, BLUE double, GREEN double, RED double, BNIR double, SWIR1 double, SWIR2 double, " \
            "dem double, sun_zenith double, sun_azimuth double, view_zenith double, rel_azimuth double, class int, wvp double"
    return spark.createDataFrame(rows, names)


QUIET = dict(do_atmo=False, do_topo=False, do_brdf=False, do_adjacency=False)


def test_flags_of_a_prepared_scene(spark):
    out = prepare_scenes(scene(spark), cloud_threshold=0.1, shadow_threshold=5.0, cloud_buffer=40, snow_buffer=0, **QUIET)
    assert list(out) == ["TOA"]
    words = {(r.x, r.y): r.qai for r in out["TOA"].collect()}
    assert len(words) == 144
    cloud = {k for k, q in words.items() if (q >> 1) & 3 == 2}
    near = {k for k, q in words.items() if (q >> 1) & 3 == 1}
    assert cloud == {(3, 3)} and near == {(x, y) for x in range(12) for y in range(12) if 0 < math.hypot(x - 3, y - 3) <= 2}
    assert {k for k, q in words.items() if q & 16} == {(x, 0) for x in range(12)}


def test_scene_switches_and_products(spark):
    grid = scene(spark)
    flags = dict(cloud_threshold=0.1, shadow_threshold=5.0, cloud_buffer=0)
    out = prepare_scenes(grid, output_dst=True, output_aod=True, output_wvp=True, output_vzn=True, output_hot=True, output_ovv=True,
                         erase_clouds=True, buffer_nodata=True, **flags, **QUIET)
    assert set(out) == {"TOA", "DST", "AOD", "WVP", "VZN", "HOT", "OVV"}
    erased = {(r.x, r.y) for r in out["TOA"].where("RED is null").collect()}
    assert erased == {(x, y) for x in (2, 3, 4) for y in (2, 3, 4)}
    assert out["AOD"].count() == 144 and out["WVP"].first().wvp == 1.5
    assert {r.overlay for r in out["OVV"].collect()} >= {"pink", "yellow"}
    full = prepare_scenes(grid, **flags)["TOA"]  # nothing was corrected without coefficients
    assert full.count() == 144 and full.where("RED is null").count() == 0
    assert prepare_scenes(grid, max_cloud_cover_frame=0.1, **flags, **QUIET)["TOA"].count() == 0


def test_scene_extent_resolution_and_own_projection(spark):
    grid = scene(spark)
    box = {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[10.4, 44.4], [10.4, 44.6], [10.5035, 44.6], [10.5035, 44.4], [10.4, 44.4]]]}}
    assert rings_of(json.dumps(box))[0][0] == [10.4, 44.4]
    hole = [[10.4215, 44.4], [10.4215, 44.6], [10.4415, 44.6], [10.4415, 44.4], [10.4215, 44.4]]
    parts = {"type": "MultiPolygon", "coordinates": [[*box["geometry"]["coordinates"], hole]]}
    ringed = [tuple(r) for r in prepare_scenes(grid, aoi=parts, **QUIET)["TOA"].select("lon").distinct().collect()]
    assert ringed and not any(10.4215 < lon < 10.4415 for lon, in ringed)
    assert prepare_scenes(grid, aoi=json.dumps(box), **QUIET)["TOA"].select("x").distinct().count() == 4
    coarse = prepare_scenes(grid, input_resolution=10, resampling="AVG", resolution=20, **QUIET)["TOA"]
    assert coarse.count() == 36 and coarse.schema["x"].dataType.simpleString() == "int"
    assert prepare_scenes(grid, input_resolution=10, resampling="CC", resolution=20, **QUIET)["TOA"].count() == 36
    local = grid.withColumns({"px": F.col("x") * 20.0, "py": F.col("y") * -20.0})
    tiled = prepare_scenes(local, projection="local", tile_size=100, block_size=20, resolution=20, **QUIET)["TOA"]
    assert tiled.where("x = 6 and y = 2").first().tile == "X0001_Y0000"


def test_scene_with_coarse_bands(spark):
    grid = scene(spark)
    coarse = grid.groupBy("scene_id", F.floor(F.col("x") / 2).cast("int").alias("cx"), F.floor(F.col("y") / 2).cast("int").alias("cy")).agg(F.avg("SWIR1").alias("RE1"))
    out = prepare_scenes(grid, coarse=coarse, res_merge="NONE", cloud_threshold=0.1, shadow_threshold=5.0, **QUIET)["TOA"]
    assert out.where("RE1 is null").count() == 1  # the cloud pixel is skipped


class OnCluster:
    """Just enough of a session to ask for its shared folder."""

    def __init__(self, named):
        self.conf = {"spark.checkpoint.dir": named}
        self.sparkContext = type("Context", (), {"master": "yarn", "getConf": lambda _: {}})()


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(OnCluster("hdfs://place/")) == "hdfs://place"
    with pytest.raises(ValueError):
        shared_dir(OnCluster(None))
    assert shared_dir(spark) == shared_dir(spark)
