"""Flooding, lines towards the sun, quality conditions and interpolated coefficients against brute force."""

import heapq
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelfold.functions.qai import LAYOUT, packed
from pixelfold.operators import flags, lines, masks, reflectance
from pixelfold.operators.flood import fill_holes, settle
from pixelfold.queries import QUERIES


def flooded(values):
    """Fill from the border inwards, lowest first; values maps (scene, x, y) to height."""
    near = ((1, 0), (-1, 0), (0, 1), (0, -1))
    heap = [(v, *p) for p, v in values.items() if any((p[0], p[1] + a, p[2] + b) not in values for a, b in near)]
    heapq.heapify(heap)
    level = {}
    while heap:
        v, s, x, y = heapq.heappop(heap)
        if (s, x, y) in level:
            continue
        level[s, x, y] = v
        for a, b in near:
            n = (s, x + a, y + b)
            if n in values and n not in level:
                heapq.heappush(heap, (max(v, values[n]), *n))
    return level


def canyon(width, height):
    """A plateau with a winding canyon that leaves it at one place only, and a pit without a way out."""
    z = np.full((height, width), 9.0)
    rows = list(range(2, height - 2, 4))
    for k, y in enumerate(rows):
        z[y, 2:width - 2] = 1
        if y != rows[-1]:
            z[y:y + 4, width - 3 if k % 2 == 0 else 2] = 1
    z[rows[-1] + 2:, width // 2] = 2
    z[rows[-1]:, width // 2] = 2
    return z


@pytest.mark.parametrize("block", [7, 16, 64])
def test_fill_across_blocks(spark, block):
    rng = np.random.default_rng(block)
    rows = []
    for s, z in ((1, rng.integers(0, 9, (40, 50)).astype(float)), (2, canyon(50, 40))):
        for y, x in itertools.product(range(40), range(50)):
            if s == 2 or rng.random() > 0.02:
                rows.append((s, x - 9, y - 5, float(z[y, x])))
    rows += [(3, 0, 0, 5.0), (3, 1, 0, None), (3, 2, 0, float("nan")), (4, -100, 100, 1.0)]
    df = spark.createDataFrame(rows, "scene_id long, x int, y int, v double")
    want = flooded({(s, x, y): v for s, x, y, v in rows if v is not None and not math.isnan(v)})
    got = {(r.scene_id, r.x, r.y): r.filled for r in fill_holes(df, "v", block=block).collect()}
    assert got == want
    assert sum(got[k] > v for *k_, v in rows if (k := tuple(k_)) in got) > 100


def test_fill_of_nothing(spark):
    empty = spark.createDataFrame([], "scene_id long, x int, y int, v double")
    assert fill_holes(empty, "v").count() == 0


def test_settle_with_neighbours():
    pit = np.array([[5.0, 5, 5], [5, 1, 5], [5, 5, 5]])
    walls = {s: np.full(3, np.inf) for s in ("north", "south", "west", "east")}
    assert settle(pit, {}).tolist() == [[5, 5, 5]] * 3 == settle(pit, {}).tolist()
    assert np.isinf(settle(pit, walls)).all()
    assert settle(pit, {**walls, "west": np.array([np.inf, 2.0, np.inf])}).tolist() == [[5, 5, 5]] * 3
    assert settle(np.array([[np.nan, 1.0], [1.0, 1.0]]), {s: np.full(2, np.inf) for s in walls})[1, 1] == 1


@pytest.mark.parametrize("azimuth", [0, 10, 45, 90, 133, 180, 225, 275.5, 359])
def test_terrain_shadow_and_cloud_match(spark, azimuth):
    rng = np.random.default_rng(int(azimuth))
    zenith = 60.0
    dem, cloud = rng.random((18, 23)) * 60, rng.random((18, 23)) > 0.9
    east, south = math.sin(math.radians(azimuth)), -math.cos(math.radians(azimuth))

    def place(x, y):
        if abs(east) >= abs(south):
            t = south / east
            return y - math.floor(t * x + 0.5), x * math.copysign(1, east) * math.sqrt(1 + t * t) * 20
        t = east / south
        return x - math.floor(t * y + 0.5), y * math.copysign(1, south) * math.sqrt(1 + t * t) * 20

    rise = 1 / math.tan(math.radians(zenith))
    pixels = {(x, y): (*place(x, y), dem[y, x], bool(cloud[y, x])) for x in range(23) for y in range(18)}
    hidden, under = set(), set()
    for p, (line, at, z, _) in pixels.items():
        for _, (other, there, top, c) in pixels.items():
            if other == line and there > at:
                if top - there * rise > z - at * rise:
                    hidden.add(p)
                if c and 60 - 1e-9 <= (there - at) * rise <= 150 + 1e-9:
                    under.add(p)
    rows = [(1, x, y, float(dem[y, x]), bool(cloud[y, x]), zenith, float(azimuth)) for x, y in pixels]
    df = spark.createDataFrame(rows, "scene_id long, x int, y int, dem double, cloud boolean, sun_zenith double, sun_azimuth double")
    both = lines.under_clouds(lines.terrain_shadow(df), heights=(60, 150))
    got = both.collect()
    assert {(r.x, r.y) for r in got if r.shaded} == hidden and {(r.x, r.y) for r in got if r.under} == under
    assert both.columns == [*df.columns, "shaded", "under"] and len(got) == len(pixels) and hidden


def test_shadow_needs_a_cloud_towards_the_sun(spark):
    """Two equal dark hollows; only one has a cloud where the sun stands."""
    rows = []
    for x, y in itertools.product(range(60), range(9)):
        dark = y in (4, 5) and x in (10, 11, 40, 41)
        white = y in (4, 5) and x in (22, 23)
        bright = 0.6 if white else 0.3
        rows.append((1, x, y, bright if white else 0.1, bright if white else 0.1, bright if white else 0.05, 0.05 if dark else bright, bright, bright))
    df = spark.createDataFrame(rows, "scene_id long, x int, y int, BLUE double, GREEN double, RED double, BNIR double, SWIR1 double, SWIR2 double")
    hollow = {(r.x, r.y) for r in masks.classify_clouds(df, 0.1, 0.1).where("shadow").collect()}
    assert hollow == {(x, y) for x in (10, 11, 40, 41) for y in (4, 5)}
    cast = masks.classify_clouds(df, 0.1, 0.1, sun=(45.0, 90.0))
    assert {(r.x, r.y) for r in cast.where("cloud").collect()} == {(x, y) for x in (22, 23) for y in (4, 5)}
    # the clouds stand 220 to 260 m east of the first hollow, the second lies east of them
    assert {(r.x, r.y) for r in cast.where("shadow").collect()} == {(x, y) for x in (10, 11) for y in (4, 5)}


def test_packed_word_takes_the_first_state(spark):
    row = spark.range(1).select(
        packed({"NODATA": F.lit(True), "CLOUD_OPAQUE": F.lit(False), "CLOUD_CIRRUS": F.lit(None).cast("boolean"), "CLOUD_BUFFER": F.lit(True),
                "ILLUMIN_NONE": F.lit(True), "ILLUMIN_LOW": F.lit(True), "WVP_NONE": F.lit(True)}).alias("w")).first()
    assert row.w == 1 + 2 + (3 << 11) + (1 << 14)


def test_all_conditions_occur(spark, folder):
    words = [int(r.qai) for r in QUERIES["quality_word"](spark, folder).collect()]
    for name, (bit, mask, state) in LAYOUT.items():
        held = sum(w >> bit & mask == state for w in words)
        assert 0 < held < len(words), name


def test_aerosol_cells(spark):
    rows = [(1, x, y, 0.2 + 0.01 * x) for x in range(8) for y in range(4)] + [(2, 0, 0, 0.5)] + [(3, x, 0, 0.3) for x in range(4)]
    df = spark.createDataFrame(rows, "scene_id long, x int, y int, BLUE double")
    given = spark.createDataFrame([(3, 0.77)], "scene_id long, aod double")
    got = {(r.scene_id, r.ax): (round(r.aod, 6), r.state) for r in flags.aerosol(df, F.col("x") < 6, 4, 10, given).collect()}
    assert got == {(1, 0): (0.9, "ESTIMATED"), (1, 1): (0.9, "INTERPOLATED"), (2, 0): (0.1, "FILLED"), (3, 0): (0.77, "GIVEN")}
    assert flags.with_aerosol(df, flags.aerosol(df, F.lit(True), 4, 10), 4).count() == len(rows)


def nodes(spark, axes, drop=0):
    rows = [(b, s, *p, 0.9 - 0.01 * k * p[0], 0.01 * k * (1 + p[0]) + p[1] / 1000, 0.9 - p[1] / 1000 - p[2] / 100, 0.1 + p[0] * p[2] / 100)
            for k, b in enumerate(("BLUE", "RED"), 1) for s in ("multi", "single") for p in itertools.product(*axes)]
    return rows, spark.createDataFrame(rows[drop:], "band string, scattering string, aod double, sun_zenith double, view_zenith double, "
                                                    "tg double, rho_path double, t_total double, albedo double")


@pytest.mark.parametrize("axes", [((0.0, 0.2, 1.0), (10.0, 50.0), (0.0, 5.0, 9.0)), ((0.3,), (10.0, 20.0, 60.0, 70.0), (4.0,))])
def test_interpolated_coefficients(spark, axes):
    rng = np.random.default_rng(3)
    rows, lut = nodes(spark, axes)
    pixels = [(1, i, 0, float(rng.random()), float(rng.random()), float(rng.random() * 1.4 - 0.1), float(rng.random() * 80), float(rng.random() * 12))
              for i in range(60)] + [(1, 60, 0, 0.5, None, 0.2, 50.0, 5.0), (1, 61, 0, 0.5, 0.5, None, 50.0, 5.0), (1, 62, 0, 0.5, 0.5, 1.0, 10.0, 9.0)]
    df = spark.createDataFrame(pixels, "scene_id long, x int, y int, BLUE double, RED double, aod double, sun_zenith double, view_zenith double")
    table = {(r[0], *r[2:5]): r[5:] for r in rows if r[1] == "multi"}

    def at(band, point):
        low, share = [], []
        for v, ax in zip(point, axes, strict=True):
            v = min(max(v, ax[0]), ax[-1])
            i = max(0, min(len(ax) - 2, sum(v >= n for n in ax) - 1))
            low.append(i)
            share.append(0 if len(ax) == 1 else (v - ax[i]) / (ax[i + 1] - ax[i]))
        out = np.zeros(4)
        for corner in itertools.product((0, 1), repeat=3):
            w = np.prod([s if c else 1 - s for s, c in zip(share, corner, strict=True)])
            out += w * np.array(table[band, *(ax[min(i + c, len(ax) - 1)] for ax, i, c in zip(axes, low, corner, strict=True))])
        return out

    got = {r.x: r for r in reflectance.atmo_correct(df, lut, ["BLUE", "RED"]).collect()}
    assert len(got) == len(pixels)
    for _, x, _, blue, red, *point in pixels:
        for band, v in (("BLUE", blue), ("RED", red)):
            # an axis of one node does not look at its value
            if v is None or any(p is None and len(ax) > 1 for p, ax in zip(point, axes, strict=True)):
                assert got[x][band] is None
                continue
            tg, rho, t, s = at(band, [ax[0] if p is None else p for p, ax in zip(point, axes, strict=True)])
            assert got[x][band] == pytest.approx((v / tg - rho) / (t + s * (v / tg - rho)))


def test_coefficients_must_fill_their_axes(spark):
    _, lut = nodes(spark, ((0.0, 1.0), (10.0, 20.0), (0.0, 5.0)), drop=1)
    df = spark.createDataFrame([(1, 0, 0, 0.5, 0.5, 0.5, 15.0, 2.0)], "scene_id long, x int, y int, BLUE double, RED double, aod double, sun_zenith double, view_zenith double")
    with pytest.raises(Exception, match="do not fill their axes"):
        reflectance.atmo_correct(df, lut, ["BLUE", "RED"]).collect()
    with pytest.raises(ValueError, match="nodes"):
        reflectance.atmo_correct(df, lut.where("false"), ["BLUE"])


def test_aerosol_changes_the_surface(spark):
    """The switch reaches the corrected reflectance: an estimate differs from a supplied value."""
    from pixelfold.plans.scene_preparation import prepare_scenes
    rows = [(1, x, y, 10.0, 50.0, 0.3, 0.3, 0.3, 0.4, 0.4, 0.4, 40.0, 150.0, 3.0, 50.0) for x in range(6) for y in range(6)]
    df = spark.createDataFrame(rows, "scene_id long, x int, y int, lon double, lat double, BLUE double, GREEN double, RED double, BNIR double, SWIR1 double, "
                                     "SWIR2 double, sun_zenith double, sun_azimuth double, view_zenith double, rel_azimuth double")
    _, lut = nodes(spark, ((0.0, 0.2, 2.0), (10.0, 50.0), (0.0, 5.0)))
    quiet = dict(do_topo=False, do_brdf=False, do_adjacency=False, output_aod=True, cloud_threshold=5.0)
    own = prepare_scenes(df, lut, **quiet)
    given = prepare_scenes(df, lut, external_aod=spark.createDataFrame([(1, 0.1)], "scene_id long, aod double"), do_aod=False, **quiet)
    a, b = (o["BOA"].where("x = 2 and y = 2").first() for o in (own, given))
    assert a.BLUE != b.BLUE and {r.source for r in given["AOD"].collect()} == {"given"} and {round(r.aod, 6) for r in own["AOD"].collect()} == {1.4}
