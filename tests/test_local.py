"""Windows by summed-area tables, local regression, constrained unmixing, and the clustered layout of a cube."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelfold.operators import focal, merge, series
from pixelfold.sinks.writers import morton, write_cube


@pytest.mark.parametrize("reach", [1, 4, 11])
def test_box_means_across_blocks(spark, reach):
    rng = np.random.default_rng(reach)
    pixels = [(s, x, y) for s in (1, 2) for x in range(-7, 25) for y in range(3, 21) if rng.random() > 0.2]
    rows = [(*p, None if rng.random() < 0.1 else float(1e9 + rng.random()), float(rng.random())) for p in pixels]
    df = spark.createDataFrame(rows, "scene_id long, x int, y int, big double, small double")
    by = {r[:3]: r[3:] for r in rows}
    got = focal.box_means(df, ["big", "small"], reach, block=8).collect()
    assert len(got) == len(rows)
    for r in got:
        near = [by[k] for k in ((r.scene_id, r.x + a, r.y + b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)) if k in by]
        big = [b for b, _ in near if b is not None]
        assert r.big_env is None if not big else abs(r.big_env - sum(b - 1e9 for b in big) / len(big) - 1e9) < 1e-6
        assert r.small_env == pytest.approx(sum(s for _, s in near) / len(near))


def test_local_regression_follows_the_ground(spark):
    """A relation that changes from west to east is met by local fits, not by one for the scene."""
    rng = np.random.default_rng(5)
    rows = [(1, x, y, float(rng.random()), float(rng.random())) for x in range(40) for y in range(20)]
    fine = spark.createDataFrame(rows, "scene_id long, x int, y int, RED double, BNIR double")
    slope = F.when(F.col("x") < 20, 2.0).otherwise(-1.0)
    truth = fine.withColumn("value", slope * F.col("RED") + 0.5 * F.col("BNIR") + 0.1)
    coarse = truth.groupBy("scene_id", F.floor(F.col("x") / 2).cast("int").alias("cx"), F.floor(F.col("y") / 2).cast("int").alias("cy")).agg(
        F.avg("value").alias("value"))

    def error(**how):
        merged = merge.resolution_merge(fine, coarse, ("RED", "BNIR"), "REGRESSION", block=8, **how).withColumnRenamed("value", "got")
        both = truth.join(merged, ["scene_id", "x", "y"])
        return both.agg(F.max(F.when(F.abs(F.col("x") - 20) > 8, F.abs(F.col("got") - F.col("value"))))).first()[0]

    assert error() > 0.1
    assert error(tile=5) < 1e-9 and error(reach=2) < 1e-9


def test_regression_without_solution_is_null(spark):
    fine = spark.createDataFrame([(1, x, y, 0.5, float(x)) for x in range(4) for y in range(4)], "scene_id long, x int, y int, RED double, BNIR double")
    coarse = spark.createDataFrame([(1, a, b, 1.0) for a in range(2) for b in range(2)], "scene_id long, cx int, cy int, value double")
    out = merge.resolution_merge(fine, coarse, ("RED", "BNIR"), "REGRESSION", tile=1).collect()
    assert len(out) == 16 and all(r.value is None for r in out)


ENDS = {"a": [0.1, 0.2, 0.3, 0.5], "b": [0.6, 0.5, 0.1, 0.0], "c": [0.3, 0.9, 0.4, 0.2], "d": [0.0, 0.1, 0.8, 0.9]}
BANDS = ["B1", "B2", "B3", "B4"]


def best_of_all(m, y, total):
    """Constrained least squares by trying every set of endmembers."""
    best = None
    for size in range(0 if not total else 1, m.shape[1] + 1):
        for s in map(list, itertools.combinations(range(m.shape[1]), size)):
            if total:
                base = m[:, s[-1]]
                free = np.linalg.lstsq(m[:, s[:-1]] - base[:, None], y - base, rcond=None)[0] if size > 1 else np.zeros(0)
                f = np.append(free, 1 - free.sum())
            else:
                f = np.linalg.lstsq(m[:, s], y, rcond=None)[0] if size else np.zeros(0)
            if (f >= -1e-12).all():
                e = ((y - m[:, s] @ f) ** 2).mean() ** 0.5
                if best is None or e < best[0] - 1e-12:
                    whole = np.zeros(m.shape[1])
                    whole[s] = f
                    best = (e, whole)
    return best


@pytest.mark.parametrize("total", [True, False])
def test_constrained_unmixing(spark, total):
    rng = np.random.default_rng(9)
    m = np.array(list(ENDS.values())).T
    made = rng.dirichlet([0.4] * 4, 40)
    spectra = np.vstack([made @ m.T, rng.random((60, 4)), m.T, np.zeros((1, 4))])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(spectra)] + [(-1, None, 0.1, 0.1, 0.1)],
                               "i int, B1 double, B2 double, B3 double, B4 double")
    got = {r.i: r for r in series.sma_constrained(df, ENDS, BANDS, sum_to_one=total).collect()}
    clipped = {r.i: r for r in series.sma(df, ENDS, BANDS).collect()}
    assert got[-1].frac_a is None and got[-1].sma_rmse is None
    for i, y in enumerate(spectra):
        f = np.array([getattr(got[i], f"frac_{n}") for n in ENDS])
        error, want = best_of_all(m, y, total)
        assert got[i].sma_rmse == pytest.approx(error, abs=1e-9) and f == pytest.approx(want, abs=1e-7)
        assert (f >= 0).all() and (not total or f.sum() == pytest.approx(1))
        cut = np.maximum([getattr(clipped[i], f"frac_{n}") for n in ENDS], 0)
        if total and cut.sum() > 0:
            assert got[i].sma_rmse <= ((y - m @ (cut / cut.sum())) ** 2).mean() ** 0.5 + 1e-9
    for i, f in enumerate(made):
        assert [getattr(got[i], f"frac_{n}") for n in ENDS] == pytest.approx(f, abs=1e-6)
    with pytest.raises(ValueError):
        series.sma_constrained(df, {str(k): [0.1 * k, 0.2, 0.3, 0.4] for k in range(7)}, BANDS)


def test_morton_curve(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 1 << 31, (200, 2))] + [(0, 0), (1, 0), (0, 1), (3, 5)]
    df = spark.createDataFrame(pairs, "x long, y long").select("x", "y", morton().alias("m"))
    for r in df.collect():
        assert r.m == sum(((r.x >> i & 1) << 2 * i) | ((r.y >> i & 1) << 2 * i + 1) for i in range(31))


def test_box_scans_skip_row_groups(spark, tmp_path):
    """A small box reads few rows of a clustered cube, most rows of one in the order of its pixels."""
    cube = spark.range(1 << 18).select(
        F.lit(0).alias("tile_x"), F.lit(0).alias("tile_y"), F.col("id").alias("pixel_id"),
        (F.col("id") % 512).cast("int").alias("x"), F.floor(F.col("id") / 512).cast("int").alias("y"))

    def read(name, **how):
        path = write_cube(cube, str(tmp_path), name, group_rows=4096, **how)
        box = spark.read.parquet(path).where("x between 100 and 115 and y between 100 and 400")
        assert box.count() == 16 * 301
        plan = box._jdf.queryExecution()
        box._jdf.collectAsList()
        scan = plan.executedPlan()
        while not scan.children().isEmpty():
            scan = scan.children().head()
        return scan.metrics().get("numOutputRows").get().value()

    rows = read("rows"), read("curve", cluster=("x", "y"))
    # groups of 64 x 64 pixels along the strip, against whole lines
    assert rows[1] <= 6 * 4096 and rows[0] >= 301 * 512


def test_box_means_carry_other_columns(spark):
    rng = random.Random(9)
    cells = {(x, y): None if rng.random() < 0.3 else rng.randrange(100) for x in range(-7, 9) for y in range(12) if rng.random() < 0.8}
    rows = [(0, x, y, v, 2**60 + i, f"p{i}") for i, ((x, y), v) in enumerate(cells.items())]
    df = spark.createDataFrame(rows, "scene_id int, x int, y int, v int, pixel_id long, name string")
    got = focal.box_means(df, ["v"], 2, block=4, carry=["pixel_id", "name", "v"])
    assert got.columns == ["scene_id", "x", "y", "pixel_id", "name", "v", "v_env"]
    got = {(r.x, r.y): r for r in got.collect()}
    assert len(got) == len(cells)
    for i, (x, y) in enumerate(cells):
        near = [v for (a, b), v in cells.items() if max(abs(a - x), abs(b - y)) <= 2 and v is not None]
        row = got[(x, y)]
        assert (row.pixel_id, row.name, row.v) == (2**60 + i, f"p{i}", cells[(x, y)])
        assert row.v_env == (pytest.approx(sum(near) / len(near)) if near else None)
