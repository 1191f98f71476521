"""Points in polygons by cells, against the parity of all edges."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelfold.operators import area, gridding, select

POINT = "id int, lon double, lat double"


def held(rings, x, y):
    inside = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                inside = not inside
    return inside


def star(rng, x, y, r, corners):
    turns = sorted(rng.random(corners) * 2 * math.pi)
    return [(x + r * (0.3 + rng.random()) * math.cos(t), y + r * (0.3 + rng.random()) * math.sin(t)) for t in turns]


SHAPES = {
    "star with holes": lambda rng: [star(rng, 0, 0, 40, 300), star(rng, 2, 1, 9, 40), star(rng, 90, 5, 20, 7), star(rng, 92, 5, 3, 90)],
    "comb": lambda rng: [[(0, 0)] + [p for i in range(60) for p in ((i, 50), (i + 0.5, 3))] + [(60, 0)]],
    "axis parallel": lambda rng: [[(0, 0), (64, 0), (64, 32), (32, 32), (32, 64), (0, 64)], [(8, 8), (16, 8), (16, 16), (8, 16)]],
    "triangle": lambda rng: [[(0, 0), (100, 1), (3, 77)]],
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("cells", [None, 1, 7, 150])
def test_points_in_areas(spark, shape, cells):
    rng = np.random.default_rng(11)
    rings = SHAPES[shape](rng)
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((1500, 2)) * 200 - 70)]
    # points level with corners, and beyond the box
    points += [(2000 + i, float(x) + 0.37, float(y)) for i, (x, y) in enumerate(rings[0])] + [(5000, None, 1.0), (5001, 1.0, None), (5002, 1e9, 0.0)]
    df = spark.createDataFrame(points, POINT)
    got = area.filter_area(df, area.ring_edges(spark, rings), cells=cells)
    assert got.columns == df.columns
    assert {r.id for r in got.collect()} == {i for i, x, y in points if x is not None and y is not None and held(rings, x, y)}


def test_corner_table_closes_rings(spark):
    rows = [("a", 1, 1, 0.0, 0.0), ("a", 1, 3, 4.0, 4.0), ("a", 1, 2, 4.0, 0.0), ("a", 1, 4, 0.0, 4.0), ("a", 1, 5, 0.0, 0.0)]
    corners = spark.createDataFrame(rows, "zone string, ring int, seq int, lon double, lat double")
    assert area.corner_edges(corners, ["zone"]).count() == 4


def test_large_and_small_polygons_agree(spark, monkeypatch):
    rng = np.random.default_rng(2)
    ring = star(rng, 10, 45, 8, 60)
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((800, 2)) * 20 + (0, 35))], POINT)
    small = {r.id for r in select.filter_aoi(df, ring).collect()}
    monkeypatch.setattr(select, "FEW_CORNERS", 3)
    assert {r.id for r in select.filter_aoi(df, ring).collect()} == small and small


def test_plan_does_not_grow_with_corners(spark):
    def size(n):
        ring = [(math.cos(2 * math.pi * k / n), math.sin(2 * math.pi * k / n)) for k in range(n)]
        df = spark.createDataFrame([(1, 0.1, 0.2)], POINT)
        plan = area.filter_area(df, area.ring_edges(spark, [ring]), cells=20)
        return len(plan._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert size(100) == size(10_000)


def test_no_edges(spark):
    df = spark.createDataFrame([(1, 0.1, 0.2)], POINT)
    assert area.filter_area(df, area.ring_edges(spark, [[(0, 0), (0, 0)]])).count() == 0


def test_zones_by_rank_and_outside(spark):
    square = lambda zone, rank, x, y, r: [(zone, rank, y, x, rank, k, x + r * a, y + r * b) for k, (a, b) in enumerate(((-1, -1), (1, -1), (1, 1), (-1, 1)))]
    zones = spark.createDataFrame(square("B", 2, 0.0, 0.0, 10) + square("A", 1, 5.0, 5.0, 3) + square("B", 3, 50.0, 0.0, 4),
                                  "zone string, rank int, lat0 double, lon0 double, ring int, seq int, lon double, lat double")
    zones = zones.withColumn("lat0", F.lit(0.0)).withColumn("lon0", F.lit(0.0))
    df = spark.createDataFrame([(1, 5.5, 5.5), (2, 1.0, 1.0), (3, 30.0, 0.0), (4, 51.0, 1.0), (5, None, 0.0)], POINT)
    got = {r.id: (r.zone, r.tile) for r in gridding.project_grid(df, "GLANCE7", zones=zones).collect()}
    assert {i: z for i, (z, _) in got.items()} == {1: "A", 2: "B", 3: None, 4: "B", 5: None}
    assert got[3][1] is None and got[1][1] == "X0004_Y-005"
    ocean = spark.createDataFrame([(1, -140.0, -30.0), (2, 20.0, 50.0)], POINT)
    assert {r.id: r.zone for r in gridding.project_grid(ocean).collect()} == {1: None, 2: "EU"}
