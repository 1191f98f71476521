"""Queries over gridding, resampling, masks and corrections."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pixelfold.functions import projections as prj
from pixelfold.functions.kernels import gaussian_sigma
from pixelfold.functions.qai import has_flag
from pixelfold.operators import flags, gridding, masks, merge, reflectance, resample, sar
from pixelfold.queries import fixtures as fx
from pixelfold.queries.base import query, r
from pixelfold.queries.fixtures import ctes


def projected(spark, sf):
    """Projected metres per order."""
    return fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("item_id"),
        (F.col("o_custkey") * 137.5 - 50000).alias("px"), (F.lit(40000) - F.col("o_orderkey") * 11.25).alias("py"))


_PROJECTED = "SELECT o_orderkey AS item_id, o_custkey*137.5::double - 50000 AS px, 40000 - o_orderkey*11.25::double AS py FROM orders"


@query("assign_tiles", ctes(p=_PROJECTED, t="SELECT *, floor((px - -25)/30000)::int AS tile_x, floor((60 - py)/30000)::int AS tile_y FROM p") + f"""
SELECT item_id, {r('px')} AS px, {r('py')} AS py, tile_x, tile_y, printf('X%04d_Y%04d', tile_x, tile_y) AS tile FROM t""")
def _tiles(spark, sf):
    return gridding.assign_tiles(projected(spark, sf), 30000, -25.0, 60.0)


@query("assign_blocks", ctes(p=_PROJECTED, t="""
SELECT *, px - 30000*floor(px/30000) AS ix, -py - 30000*floor(-py/30000) AS iy FROM p""") + f"""
SELECT item_id, {r('px')} AS px, {r('py')} AS py, floor(iy/3000)::int AS block, floor(ix/7500)::int AS chunk_x, floor(iy/6000)::int AS chunk_y
FROM t""")
def _blocks(spark, sf):
    return gridding.assign_blocks(projected(spark, sf), 3000, (7500, 6000), 30000, 20)


def _zones_sql(zones):
    rows = ", ".join(
        f"({i}, '{c}', {la}::double, {lo}::double, {w}::double, {s}::double, {e}::double, {n}::double)"
        for i, (c, la, lo, (w, s, e, n)) in enumerate(zones))
    return f"SELECT * FROM (VALUES {rows}) z(i, zone, lat0, lon0, w, s, e, n)"


def grid_sql(name):
    zones, size, kind = prj.GRIDS[name]
    scale = "sqrt(2/greatest(1+cc, 1e-12))" if kind == "equal_area" else "CASE WHEN sin(acos(cc)) < 1e-12 THEN 1 ELSE acos(cc)/sin(acos(cc)) END"
    return f"""
SELECT item_id, lon, lat, zone, R*k*cos(phi)*sin(lam) AS px, R*k*(cos(phi0)*sin(phi) - sin(phi0)*cos(phi)*cos(lam)) AS py, {size} AS size FROM (
  SELECT *, {scale} AS k, {prj.EARTH_RADIUS} AS R FROM (
    SELECT *, greatest(-1, least(1, sin(phi0)*sin(phi) + cos(phi0)*cos(phi)*cos(lam))) AS cc FROM (
      SELECT item_id, lon, lat, arg_min(zone, i) AS zone, radians(lat) AS phi, radians(arg_min(lat0, i)) AS phi0,
             radians(lon - arg_min(lon0, i)) AS lam
      FROM points p LEFT JOIN ({_zones_sql(zones)}) z ON lon >= w AND lon < e AND lat >= s AND lat < n
      GROUP BY item_id, lon, lat)))"""


@query("project_grid", ctes("points", a=grid_sql("GLANCE7"), b=grid_sql("EQUI7"),
                            c="SELECT 'GLANCE7' AS grid, * FROM a UNION ALL SELECT 'EQUI7', * FROM b") + f"""
SELECT grid, item_id, zone, {r('px/1000')} AS km_x, {r('py/1000')} AS km_y,
       floor(px/size)::int AS tile_x, floor(-py/size)::int AS tile_y FROM c""")
def _project(spark, sf):
    parts = [
        gridding.project_grid(fx.points(spark, sf), g).select(
            F.lit(g).alias("grid"), "item_id", "zone", (F.col("px") / 1000).alias("km_x"), (F.col("py") / 1000).alias("km_y"),
            "tile_x", "tile_y")
        for g in ("GLANCE7", "EQUI7")]
    return parts[0].unionByName(parts[1])


_SHIFT = 0.037


@query("project_grid_zones", ctes("points", a=grid_sql("GLANCE7").replace(
    "lon >= w AND lon < e AND lat >= s AND lat < n", f"lon > w + {_SHIFT} AND lon < e + {_SHIFT} AND lat > s + {_SHIFT} AND lat < n + {_SHIFT}")) + f"""
SELECT item_id, zone, {r('px/1000')} AS km_x, {r('py/1000')} AS km_y, floor(px/size)::int AS tile_x, floor(-py/size)::int AS tile_y FROM a""")
def _project_zones(spark, sf):
    """Zones given as a table of polygons, here the boxes moved off the points."""
    corners = [(zone, rank, lat0, lon0, rank, k, x + _SHIFT, y + _SHIFT)
               for rank, (zone, lat0, lon0, (w, s, e, n)) in enumerate(prj.GLANCE7)
               for k, (x, y) in enumerate(((w, s), (e, s), (e, n), (w, n)))]
    zones = spark.createDataFrame(corners, "zone string, rank int, lat0 double, lon0 double, ring int, seq int, lon double, lat double")
    placed = gridding.project_grid(fx.points(spark, sf), "GLANCE7", zones=zones)
    return placed.select("item_id", "zone", (F.col("px") / 1000).alias("km_x"), (F.col("py") / 1000).alias("km_y"), "tile_x", "tile_y")


@query("resample_agg", ctes("grid_big", n="SELECT scene_id, x//8 AS cx, y//8 AS cy, class, count(*) AS n FROM grid_big GROUP BY ALL",
            m="SELECT scene_id, cx, cy, class FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, cx, cy ORDER BY n DESC, class) AS k FROM n) WHERE k = 1") + f"""
SELECT g.scene_id, g.x//8 AS cx, g.y//8 AS cy, {r('avg(g.class)')} AS "AVG", any_value(m.class) AS "MODE",
       max(g.class) AS "MAX", min(g.class) AS "MIN", {r('quantile_cont(g.class, 0.5)')} AS "MED",
       {r('quantile_cont(g.class, 0.25)')} AS "Q1", {r('quantile_cont(g.class, 0.75)')} AS "Q3",
       sum(g.class) AS "SUM", {r('sqrt(avg(g.class*g.class))')} AS "RMS"
FROM grid_big g JOIN m ON m.scene_id = g.scene_id AND m.cx = g.x//8 AND m.cy = g.y//8 GROUP BY 1, 2, 3""")
def _resample_agg(spark, sf):
    return resample.resample_agg(fx.grid_big(spark, sf), 8, resample.AGGREGATES, "class")


def _taps(step, half):
    """Targets with the source pixel under them, joined to the sources in reach."""
    reach = math.ceil(half) + 1
    return f"""
SELECT t.scene_id, t.tx, t.ty, t.cx - s.x AS dx, t.cy - s.y AS dy, s.v FROM (
  SELECT scene_id, tx, ty, (tx+0.5)*{step} - 0.5 AS cx, (ty+0.5)*{step} - 0.5 AS cy, x, y FROM src,
    (SELECT unnest(range(0, (SELECT cast(ceil((max(x)+1)/{step}) AS bigint) + 1 FROM src))) AS tx) a,
    (SELECT unnest(range(0, (SELECT cast(ceil((max(y)+1)/{step}) AS bigint) + 1 FROM src))) AS ty) b
  WHERE floor((tx+0.5)*{step}) = x AND floor((ty+0.5)*{step}) = y) t
JOIN (SELECT unnest(range(-{reach}, {reach + 1})) AS ox) o ON true JOIN (SELECT unnest(range(-{reach}, {reach + 1})) AS oy) q ON true
JOIN src s ON s.scene_id = t.scene_id AND s.x = t.x + ox AND s.y = t.y + oy
WHERE t.cx - s.x >= -{half} AND t.cx - s.x < {half} AND t.cy - s.y >= -{half} AND t.cy - s.y < {half}"""


def _weight_sql(method, v):
    a = f"abs({v})"
    return {
        "NN": "1.0::double",
        "BL": f"greatest(0, 1 - {a})",
        "CC": f"CASE WHEN {a} < 1 THEN 1.5*{a}**3 - 2.5*{a}**2 + 1 WHEN {a} < 2 THEN -0.5*{a}**3 + 2.5*{a}**2 - 4*{a} + 2 ELSE 0 END",
        "CSP": f"CASE WHEN {a} < 1 THEN (3*{a}**3 - 6*{a}**2 + 4)/6 WHEN {a} < 2 THEN (2-{a})**3/6 ELSE 0 END",
        "LZ": f"CASE WHEN {a} < 1e-12 THEN 1 WHEN {a} < 3 THEN sin(pi()*{v})/(pi()*{v}) * sin(pi()*{v}/3)/(pi()*{v}/3) ELSE 0 END",
    }[method]


def _interp_sql(label, step, half, weight):
    return f"""
SELECT '{label}' AS method, scene_id, tx, ty, {r('sum(w*v)/CASE WHEN abs(sum(w)) > 1e-9 THEN sum(w) END')} AS value
FROM (SELECT *, ({weight}) AS w FROM ({_taps(step, half)})) GROUP BY ALL"""


_HALF = {"NN": 0.5, "BL": 1, "CC": 2, "CSP": 2, "LZ": 3}
_SRC = 'SELECT scene_id, x, y, "RED" AS v FROM grid'


@query("resample_interp", ctes("grid", src=_SRC) + " UNION ALL ".join(
    _interp_sql(m, "1.75::double", h, f"({_weight_sql(m, 'dx')}) * ({_weight_sql(m, 'dy')})") for m, h in _HALF.items()))
def _resample_interp(spark, sf):
    out = None
    for m in _HALF:
        part = resample.resample_interp(fx.grid(spark, sf), 1.75, m, "RED").select(F.lit(m).alias("method"), "scene_id", "tx", "ty", "value")
        out = part if out is None else out.unionByName(part)
    return out


@query("reduce_psf", ctes("grid", src=_SRC) + _interp_sql("nearest", "3.0::double", 0.5, "1.0::double") + " UNION ALL "
       + _interp_sql("gaussian", "3.0::double", 3, f"exp(-(dx*dx+dy*dy)/(2*{gaussian_sigma(3)}*{gaussian_sigma(3)}))"))
def _psf(spark, sf):
    grid = fx.grid(spark, sf)
    near = resample.reduce_psf(grid, 3, False, "RED").select(F.lit("nearest").alias("method"), "*")
    return near.unionByName(resample.reduce_psf(grid, 3, True, "RED").select(F.lit("gaussian").alias("method"), "*"))


@query("cloud_cover_frame", """
WITH f AS (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING avg(CASE WHEN l_linenumber - 1 IN (0, 1) THEN 1.0 ELSE 0.0 END) * 100 <= 40)
SELECT l_orderkey AS scene_id, l_partkey, l_linenumber - 1 AS class FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM f)""")
def _frame(spark, sf):
    pixels = fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("scene_id"), "l_partkey", (F.col("l_linenumber") - 1).alias("class"))
    return masks.cloud_cover_frame(pixels, 40.0)


@query("cloud_cover_tile", """
WITH p AS (SELECT l_orderkey, l_linenumber, cast(l_shipdate AS date) AS scene, l_suppkey % 8 AS tile_x, l_suppkey // 8 % 8 AS tile_y FROM lineitem)
SELECT l_orderkey, l_linenumber, tile_x, tile_y FROM (
  SELECT *, avg(CASE WHEN l_linenumber - 1 IN (0, 1) THEN 100.0 ELSE 0.0 END) OVER (PARTITION BY scene, tile_x, tile_y) AS share FROM p)
WHERE share <= 60""")
def _chip(spark, sf):
    raw = fx.obs_raw(spark, sf).select("l_orderkey", "l_linenumber", F.col("date").alias("scene_id"), "tile_x", "tile_y",
                                       (F.col("l_linenumber") - 1).alias("class"))
    return masks.cloud_cover_tile(raw, 60.0).select("l_orderkey", "l_linenumber", "tile_x", "tile_y")


def _offsets(reach, test):
    return f"""SELECT dx, dy FROM (SELECT unnest(range(-{reach}, {reach + 1})) AS dx) a,
  (SELECT unnest(range(-{reach}, {reach + 1})) AS dy) b WHERE {test}"""


@query("buffer_mask", ctes("grid_big", o=_offsets(3, "dx*dx + dy*dy <= 9"),
                           hit="SELECT DISTINCT g.scene_id, g.x + o.dx AS x, g.y + o.dy AS y FROM grid_big g, o WHERE g.class = 7") + """
SELECT g.scene_id, g.x, g.y, g.class, h.x IS NOT NULL AS buffered FROM grid_big g LEFT JOIN hit h USING (scene_id, x, y)""")
def _buffer(spark, sf):
    return masks.buffer_mask(fx.grid_big(spark, sf).select("scene_id", "x", "y", "class"), 7, 60, 20)


@query("buffer_nodata", ctes("grid_big", o=_offsets(1, "true"),
                             hit="SELECT DISTINCT g.scene_id, g.x + o.dx AS x, g.y + o.dy AS y FROM grid_big g, o WHERE g.class = 4") + f"""
SELECT g.scene_id, g.x, g.y, CASE WHEN h.x IS NULL THEN {r('g.value')} END AS value FROM grid_big g LEFT JOIN hit h USING (scene_id, x, y)""")
def _nodata(spark, sf):
    pixels = fx.grid_big(spark, sf).select("scene_id", "x", "y", F.when(F.col("class") != 4, F.col("value")).alias("value"))
    return masks.buffer_nodata(pixels)


@query("distance_to_mask", ctes("grid_big", o=_offsets(5, "dx*dx + dy*dy <= 25"),
                                near="""SELECT g.scene_id, g.x + o.dx AS x, g.y + o.dy AS y, min(o.dx*o.dx + o.dy*o.dy) AS d2
  FROM grid_big g, o WHERE g.class IN (6, 7) GROUP BY ALL""") + f"""
SELECT g.scene_id, g.x, g.y, {r('sqrt(n.d2)*20')} AS distance FROM grid_big g LEFT JOIN near n USING (scene_id, x, y)""")
def _distance(spark, sf):
    return masks.distance_to_mask(fx.grid_big(spark, sf), (6, 7), 100, 20)


_CLOUDS = """
SELECT scene_id, x, y, "BNIR" AS nir,
  "SWIR2" > 0.03 AND ndsi < 0.8 AND ndvi < 0.8 AND white < 0.7 AND "BLUE" - 0.5*"RED" - 0.08 > 0 AND "BNIR"/nullif("SWIR1", 0) > 0.75 AS potential,
  1 - greatest(abs(ndvi), abs(ndsi), white) AS probability
FROM (SELECT *, ("BNIR"-"RED")/nullif("BNIR"+"RED",0) AS ndvi, ("GREEN"-"SWIR1")/nullif("GREEN"+"SWIR1",0) AS ndsi,
  (abs("BLUE"-m) + abs("GREEN"-m) + abs("RED"-m))/nullif(m,0) AS white
  FROM (SELECT *, ("BLUE"+"GREEN"+"RED")/3 AS m FROM grid))"""


CLOUD_STEPS = {
    "c": _CLOUDS,
    "lim": "SELECT scene_id, quantile_cont(probability, 0.825) AS lim FROM c WHERE NOT potential GROUP BY 1",
    "f": "SELECT c.*, potential AND probability > coalesce(lim, 0) + 0.02 AS cloud FROM c LEFT JOIN lim USING (scene_id)",
    "fn": "SELECT * FROM f WHERE nir IS NOT NULL",
    # water levels: every way in from the border, by the highest pixel on it
    "m": """WITH RECURSIVE step(dx, dy) AS (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)), w(scene_id, x, y, level) AS (
  SELECT a.scene_id, a.x, a.y, a.nir FROM fn a JOIN step s ON true LEFT JOIN fn b ON b.scene_id = a.scene_id AND b.x = a.x + s.dx AND b.y = a.y + s.dy
  WHERE b.x IS NULL
  UNION SELECT b.scene_id, b.x, b.y, greatest(w.level, b.nir) FROM w, step s, fn b
  WHERE b.scene_id = w.scene_id AND b.x = w.x + s.dx AND b.y = w.y + s.dy
) SELECT scene_id, x, y, min(level) AS top FROM w GROUP BY ALL""",
}


@query("classify_clouds", ctes("grid", **CLOUD_STEPS) + f"""
SELECT f.scene_id, f.x, f.y, {r('probability')} AS probability, cloud, NOT cloud AND m.top - f.nir > 0.1 AS shadow
FROM f JOIN m USING (scene_id, x, y)""")
def _clouds(spark, sf):
    return masks.classify_clouds(fx.grid(spark, sf), 0.02, 0.1)


@query("erase_clouds", ctes("obs_raw") + f"""
SELECT l_orderkey, l_linenumber, qai, CASE WHEN (qai >> 1) & 3 <> 2 THEN {r('value')} END AS value FROM obs_raw""")
def _erase(spark, sf):
    return masks.erase_clouds(fx.obs_raw(spark, sf).select("l_orderkey", "l_linenumber", "qai", "value"), ["value"], has_flag("CLOUD_OPAQUE"))


@query("impulse_noise", ctes("grid_big", o=_offsets(1, "true"), m="""
SELECT a.scene_id, a.x, a.y, median(b.byte) AS med FROM (SELECT scene_id, x, y, x + dx AS nx, y + dy AS ny FROM grid_big, o) a
JOIN grid_big b ON b.scene_id = a.scene_id AND b.x = a.nx AND b.y = a.ny GROUP BY ALL""") + f"""
SELECT g.scene_id, g.x, g.y, CASE WHEN abs(g.byte - m.med) > 12 THEN {r('m.med')} ELSE {r('g.byte')} END AS value, abs(g.byte - m.med) > 12 AS replaced
FROM grid_big g JOIN m USING (scene_id, x, y)""")
def _impulse(spark, sf):
    return masks.impulse_noise(fx.grid_big(spark, sf), 12.0, "byte")


SUN_ZENITH, SUN_AZIMUTH = 35.0, 150.0


def _dem(i):
    dx, dy = i % 3 - 1, i // 3 - 1
    return f"max(CASE WHEN b.x - a.x = {dx} AND b.y - a.y = {dy} THEN b.dem END) AS n{i}"


_TERRAIN = f"""
SELECT scene_id, x, y, slope, aspect, cos(radians({SUN_ZENITH}))*cos(slope) + sin(radians({SUN_ZENITH}))*sin(slope)*cos(radians({SUN_AZIMUTH}) - aspect) AS cos_i
FROM (SELECT *, atan(sqrt(e*e + s*s)) AS slope, CASE WHEN atan2(-e, s) < 0 THEN atan2(-e, s) + 2*pi() ELSE atan2(-e, s) END AS aspect
  FROM (SELECT scene_id, x, y, ((n2 + 2*n5 + n8) - (n0 + 2*n3 + n6))/160 AS e, ((n6 + 2*n7 + n8) - (n0 + 2*n1 + n2))/160 AS s
    FROM (SELECT a.scene_id, a.x, a.y, {', '.join(_dem(i) for i in range(9))} FROM grid a JOIN grid b
      ON a.scene_id = b.scene_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY ALL)))"""


@query("terrain", ctes("grid", t=_TERRAIN) + f"""
SELECT scene_id, x, y, {r('degrees(slope)')} AS slope, {r('degrees(aspect)')} AS aspect, {r('cos_i')} AS cos_i FROM t""")
def _terrain(spark, sf):
    return reflectance.terrain(fx.grid(spark, sf), SUN_ZENITH, SUN_AZIMUTH)


@query("topo_correct", ctes(
    "grid", t=_TERRAIN, j='SELECT g.scene_id, g.x, g.y, g."BNIR" AS value, t.cos_i FROM grid g LEFT JOIN t USING (scene_id, x, y)',
    f="SELECT scene_id, regr_intercept(value, cos_i)/nullif(regr_slope(value, cos_i), 0) AS c FROM j GROUP BY 1") + f"""
SELECT scene_id, x, y, {r('value')} AS value, {r('cos_i')} AS cos_i,
       {r(f'coalesce(value*(cos(radians({SUN_ZENITH})) + c)/nullif(cos_i + c, 0), value)')} AS corrected FROM j LEFT JOIN f USING (scene_id)""")
def _topo(spark, sf):
    grid = fx.grid(spark, sf)
    lit = reflectance.terrain(grid, SUN_ZENITH, SUN_AZIMUTH)
    both = grid.select("scene_id", "x", "y", F.col("BNIR").alias("value"), F.col("BNIR").alias("corrected")).join(
        lit.drop("slope", "aspect"), ["scene_id", "x", "y"], "left")
    return reflectance.topo_correct(both, ["corrected"], SUN_ZENITH)


def scattering_lut(grid):
    """Coefficients per scene and band, from the scene's mean brightness."""
    dark = grid.groupBy("scene_id").agg(F.avg("BLUE").alias("m"))
    rows = [F.struct(F.lit(b).alias("band"), F.lit(s).alias("scattering"), (F.lit(0.9) + 0.01 * i).alias("tg"),
                     (F.col("m") * k / (i + 2)).alias("rho_path"), (F.lit(0.8) + 0.02 * i).alias("t_total"), F.lit(0.1 * k).alias("albedo"))
            for i, b in enumerate(("BLUE", "GREEN", "RED")) for s, k in (("multi", 0.2), ("single", 0.1))]
    return dark.select("scene_id", F.inline(F.array(*rows)))


def _atmo(i, b):
    y = f"(g.\"{b}\"/(0.9::double + 0.01::double*{i}) - m*0.2::double/({i}+2))"
    return f"{r(f'{y}/((0.8::double + 0.02::double*{i}) + 0.02::double*{y})')} AS \"{b}\""


# Coefficients over aerosol and angles, from the mean brightness of all scenes: 3 x 3 x 2 nodes.
NODES = {"aod": (0.0, 0.25, 1.0), "sun_zenith": (20.0, 40.0, 70.0), "view_zenith": (0.0, 12.0)}


def aerosol_lut(grid):
    dark = grid.agg(F.avg("BLUE").alias("m"))
    for axis, nodes in NODES.items():
        dark = dark.withColumn(axis, F.explode(F.array(*[F.lit(n) for n in nodes])))
    bent = 1 + F.col("aod") * F.col("aod") + F.col("sun_zenith") / 100 + F.col("view_zenith") / 50
    rows = [F.struct(F.lit(b).alias("band"), F.lit(s).alias("scattering"), (F.lit(0.9) - 0.01 * F.col("aod") * (i + 1)).alias("tg"),
                     (F.col("m") * bent * k / (i + 4)).alias("rho_path"), (F.lit(0.95) - F.col("aod") * F.col("sun_zenith") / 400).alias("t_total"),
                     (F.lit(0.1 * k) + F.col("aod") / 10).alias("albedo"))
            for i, b in enumerate(("BLUE", "GREEN", "RED")) for s, k in (("multi", 0.2), ("single", 0.1))]
    return dark.select(*NODES, F.inline(F.array(*rows)))


def _between(axis, v):
    """Weight of every node of an axis for a value, by its neighbours on both sides."""
    nodes = NODES[axis]
    held = f"greatest({nodes[0]}::double, least({nodes[-1]}::double, {v}))"
    below = " ".join(f"WHEN {n} THEN {p}" for p, n in zip(nodes, nodes[1:]))
    above = " ".join(f"WHEN {p} THEN {n}" for p, n in zip(nodes, nodes[1:]))
    return (f"CASE WHEN {held} >= n.{axis} THEN greatest(0, coalesce(1 - ({held} - n.{axis})/((CASE n.{axis} {above} END) - n.{axis}), 1)) "
            f"ELSE greatest(0, coalesce(1 - (n.{axis} - {held})/(n.{axis} - (CASE n.{axis} {below} END)), 1)) END")


def _nodes_sql():
    bent = "(1 + aod*aod + sun_zenith/100 + view_zenith/50)"
    axes = ", ".join(f"(SELECT unnest([{', '.join(f'{n}::double' for n in nodes)}]) AS {a})" for a, nodes in NODES.items())
    return f"""SELECT aod, sun_zenith, view_zenith, 0.9::double - 0.01::double*aod*(i + 1) AS tg, m*{bent}*0.2::double/(i + 4) AS rho_path,
  0.95::double - aod*sun_zenith/400 AS t_total, 0.02::double + aod/10 AS albedo, i FROM (SELECT avg("BLUE") AS m FROM grid), {axes}, range(3) b(i)"""


@query("atmo_correct_aerosol", ctes(
    "grid", n=_nodes_sql(),
    a="""SELECT scene_id, x//5 AS ax, y//5 AS ay, greatest(0, (quantile_cont("BLUE", 0.01) - 0.02)*5) AS own, count(*) AS n FROM grid WHERE class >= 2 GROUP BY ALL""",
    cells="SELECT DISTINCT scene_id, x//5 AS ax, y//5 AS ay FROM grid",
    e="""SELECT c.*, CASE WHEN n >= 19 THEN 'ESTIMATED' ELSE 'INTERPOLATED' END AS state,
  coalesce(CASE WHEN n >= 19 THEN own END, avg(CASE WHEN n >= 19 THEN own END) OVER (PARTITION BY scene_id)) AS aod
  FROM cells c LEFT JOIN a USING (scene_id, ax, ay)""",
    p="""SELECT scene_id, g.x, g.y, "BLUE", "GREEN", "RED", 15.0::double + 3*g.x AS sun, g.y*1.5::double AS view, e.aod, e.state
  FROM grid g JOIN e USING (scene_id) WHERE e.ax = g.x//5 AND e.ay = g.y//5""",
    w=f"SELECT p.*, n.* EXCLUDE (aod), {_between('aod', 'p.aod')} * {_between('sun_zenith', 'p.sun')} * {_between('view_zenith', 'p.view')} AS w FROM p, n",
    k="""SELECT scene_id, x, y, i, any_value(CASE i WHEN 0 THEN "BLUE" WHEN 1 THEN "GREEN" ELSE "RED" END) AS v, any_value(aod) AS aod, any_value(state) AS state,
  sum(w*tg) AS tg, sum(w*rho_path) AS rho, sum(w*t_total) AS t, sum(w*albedo) AS s FROM w GROUP BY scene_id, x, y, i""",
    b="SELECT *, (v/tg - rho)/(t + s*(v/tg - rho)) AS o FROM k") + f"""
SELECT scene_id, x, y, {r('any_value(aod)')} AS aod, any_value(state) AS aod_state, {r('max(CASE WHEN i = 0 THEN o END)')} AS "BLUE",
  {r('max(CASE WHEN i = 1 THEN o END)')} AS "GREEN", {r('max(CASE WHEN i = 2 THEN o END)')} AS "RED" FROM b GROUP BY 1, 2, 3""")
def _atmo_aerosol(spark, sf):
    """Aerosol estimated in cells of the scene reaches the correction of every pixel."""
    grid = fx.grid(spark, sf).withColumns({
        "sun_zenith": F.lit(15.0) + 3 * F.col("x"), "view_zenith": F.col("y") * F.lit(1.5)})
    cells = flags.aerosol(grid, F.col("class") >= 2, 5, 19)
    hazy = flags.with_aerosol(grid, cells, 5)
    out = reflectance.atmo_correct(hazy, aerosol_lut(grid), ("BLUE", "GREEN", "RED"))
    return out.select("scene_id", "x", "y", "aod", "aod_state", "BLUE", "GREEN", "RED")


@query("atmo_correct", ctes("grid", k='SELECT scene_id, avg("BLUE") AS m FROM grid GROUP BY 1') + f"""
SELECT g.scene_id, g.x, g.y, {', '.join(_atmo(i, b) for i, b in enumerate(('BLUE', 'GREEN', 'RED')))} FROM grid g JOIN k USING (scene_id)""")
def _atmo_correct(spark, sf):
    grid = fx.grid(spark, sf).select("scene_id", "x", "y", "BLUE", "GREEN", "RED")
    return reflectance.atmo_correct(grid, scattering_lut(grid), ("BLUE", "GREEN", "RED"))


@query("estimate_aod", ctes("grid") + f"""
SELECT scene_id, {r('CASE WHEN avg("RED") > 0.5 THEN avg("RED") ELSE greatest(0, (quantile_cont("BLUE", 0.01) - 0.02)*5) END')} AS aod,
       CASE WHEN avg("RED") > 0.5 THEN 'external' ELSE 'internal' END AS source FROM grid GROUP BY scene_id""")
def _aod(spark, sf):
    grid = fx.grid(spark, sf)
    known = grid.groupBy("scene_id").agg(F.avg("RED").alias("aod")).where("aod > 0.5")
    return reflectance.estimate_aod(grid, known)


@query("adjacency_correct", ctes("grid", e="""
SELECT a.scene_id, a.x, a.y, any_value(a."RED") AS red, any_value(a."BNIR") AS nir, avg(b."RED") AS er, avg(b."BNIR") AS en FROM grid a JOIN grid b
  ON a.scene_id = b.scene_id AND abs(a.x - b.x) <= 3 AND abs(a.y - b.y) <= 3 GROUP BY 1, 2, 3""") + f"""
SELECT scene_id, x, y, {r('red + 0.25*(red - er)')} AS "RED", {r('nir + 0.25*(nir - en)')} AS "BNIR" FROM e""")
def _adjacency(spark, sf):
    return reflectance.adjacency_correct(fx.grid(spark, sf), ("RED", "BNIR"), 3, 0.25)


def _kernels_sql(v, rel, tag):
    cc = f"greatest(-1, least(1, cos(s)*cos({v}) + sin(s)*sin({v})*cos({rel})))"
    sec = f"(1/cos(s) + 1/cos({v}))"
    d2 = f"greatest(0, tan(s)**2 + tan({v})**2 - 2*tan(s)*tan({v})*cos({rel}))"
    ct = f"greatest(-1, least(1, 2*sqrt({d2} + (tan(s)*tan({v})*sin({rel}))**2)/{sec}))"
    return (f"((pi()/2 - acos({cc}))*{cc} + sin(acos({cc})))/(cos(s) + cos({v})) - pi()/4 AS vol{tag}, "
            f"(acos({ct}) - sin(acos({ct}))*{ct})*{sec}/pi() - {sec} + 0.5*(1 + {cc})/(cos(s)*cos({v})) AS geo{tag}")


def _brdf_sql(b):
    i, g, v = reflectance.BRDF_WEIGHTS[b]
    return r(f'"{b}" * ({i} + {g}*geo0 + {v}*vol0)/nullif({i} + {g}*geo1 + {v}*vol1, 0)') + f' AS "{b}"'


@query("brdf_adjust", ctes("grid", a='SELECT *, radians(30.0 + x % 30) AS s, radians((y % 12)::double) AS v, radians((x*7 % 180)::double) AS p FROM grid',
                           k=f"SELECT *, {_kernels_sql('v', 'p', 1)}, {_kernels_sql('0.0', '0.0', 0)} FROM a") + f"""
SELECT scene_id, x, y, {', '.join(_brdf_sql(b) for b in fx.BANDS)} FROM k""")
def _brdf(spark, sf):
    angled = fx.grid(spark, sf).select(
        "scene_id", "x", "y", *fx.BANDS, (F.col("x") % 30 + 30).cast("double").alias("sun_zenith"),
        (F.col("y") % 12).cast("double").alias("view_zenith"), (F.col("x") * 7 % 180).cast("double").alias("rel_azimuth"))
    return reflectance.brdf_adjust(angled).select("scene_id", "x", "y", *fx.BANDS)


@query("resolution_merge", ctes(
    "grid", f='SELECT scene_id, x, y, x//2 AS cx, y//2 AS cy, "RED" AS r, "BNIR" AS n FROM grid WHERE class NOT IN (0, 2)',
    c='SELECT scene_id, x//2 AS cx, y//2 AS cy, avg("SWIR1") AS v FROM grid GROUP BY ALL',
    m="SELECT scene_id, cx, cy, avg(r) AS mr, avg(n) AS mn FROM f GROUP BY ALL",
    k="SELECT * FROM m JOIN c USING (scene_id, cx, cy)",
    fit="SELECT scene_id, regr_slope(v, mr) AS b, regr_intercept(v, mr) AS a FROM k GROUP BY 1",
    w="""SELECT f.scene_id, f.x, f.y, k.v, 1/(abs(f.r - k.mr) + abs(f.n - k.mn) + 0.001) AS w,
  1 + sqrt((k.cx - f.cx)**2 + (k.cy - f.cy)**2) AS dist
  FROM f LEFT JOIN k ON k.scene_id = f.scene_id AND abs(k.cx - f.cx) <= 1 AND abs(k.cy - f.cy) <= 1""") + f"""
SELECT 'NONE' AS method, f.scene_id, f.x, f.y, {r('c.v')} AS value FROM f LEFT JOIN c USING (scene_id, cx, cy)
UNION ALL SELECT 'REGRESSION', f.scene_id, f.x, f.y, {r('a + b*f.r')} FROM f JOIN fit USING (scene_id)
UNION ALL SELECT 'IMPROPHE', scene_id, x, y, {r('sum(w*v)/sum(w)')} FROM w GROUP BY ALL
UNION ALL SELECT 'STARFM', scene_id, x, y, {r('sum(w/dist*v)/sum(w/dist)')} FROM w GROUP BY ALL""")
def _merge(spark, sf):
    grid = fx.grid(spark, sf)
    coarse = resample.resample_agg(grid, 2, "AVG", "SWIR1").withColumnRenamed("AVG", "value")
    fine = grid.select("scene_id", "x", "y", "RED", "BNIR", "class")
    out = None
    for method in merge.METHODS:
        bands = ("RED",) if method == "REGRESSION" else ("RED", "BNIR")
        part = merge.resolution_merge(fine, coarse, bands, method, F.col("class").isin(masks.OPAQUE, masks.SHADOW))
        part = part.select(F.lit(method).alias("method"), "scene_id", "x", "y", "value")
        out = part if out is None else out.unionByName(part)
    return out


def _plane(near):
    """Two-band regression over the cells that ``near`` brings together, solved by hand."""
    return f"""
SELECT *, sv - br*sr - bn*sn AS a FROM (
  SELECT *, (crv*vnn - cnv*crn)/nullif(vrr*vnn - crn*crn, 0) AS br, (cnv*vrr - crv*crn)/nullif(vrr*vnn - crn*crn, 0) AS bn FROM (
    SELECT {near}, avg(v) AS sv, avg(mr) AS sr, avg(mn) AS sn, var_pop(mr) AS vrr, var_pop(mn) AS vnn, covar_pop(mr, mn) AS crn,
      covar_pop(mr, v) AS crv, covar_pop(mn, v) AS cnv FROM near GROUP BY ALL))"""


@query("local_regression", ctes(
    "grid", f='SELECT scene_id, x, y, x//2 AS cx, y//2 AS cy, "RED" AS r, "BNIR" AS n FROM grid WHERE class NOT IN (0, 2)',
    c='SELECT scene_id, x//2 AS cx, y//2 AS cy, avg("SWIR1") AS v FROM grid GROUP BY ALL',
    k="SELECT scene_id, cx, cy, v, mr, mn FROM (SELECT scene_id, cx, cy, avg(r) AS mr, avg(n) AS mn FROM f GROUP BY ALL) JOIN c USING (scene_id, cx, cy)",
    t=_plane("scene_id, tx, ty").replace("FROM near", "FROM (SELECT *, cx//5 AS tx, cy//5 AS ty FROM k)"),
    w=_plane("scene_id, cx, cy").replace("FROM near", "FROM (SELECT a.scene_id, a.cx, a.cy, b.v, b.mr, b.mn FROM k a JOIN k b ON a.scene_id = b.scene_id AND abs(a.cx - b.cx) <= 2 AND abs(a.cy - b.cy) <= 2)")) + f"""
SELECT 'tile' AS fit, f.scene_id, f.x, f.y, {r('a + br*r + bn*n')} AS value FROM f LEFT JOIN t ON t.scene_id = f.scene_id AND t.tx = f.cx//5 AND t.ty = f.cy//5
UNION ALL SELECT 'window', f.scene_id, f.x, f.y, {r('a + br*r + bn*n')} FROM f LEFT JOIN w USING (scene_id, cx, cy)""")
def _local_regression(spark, sf):
    """Two bands, one fit per tile of five cells and one per cell over the cells around it."""
    grid = fx.grid(spark, sf)
    coarse = resample.resample_agg(grid, 2, "AVG", "SWIR1").withColumnRenamed("AVG", "value")
    fine = grid.select("scene_id", "x", "y", "RED", "BNIR", "class")
    parts = [merge.resolution_merge(fine, coarse, ("RED", "BNIR"), "REGRESSION", F.col("class").isin(masks.OPAQUE, masks.SHADOW), **how).select(
        F.lit(name).alias("fit"), "scene_id", "x", "y", "value") for name, how in (("tile", {"tile": 5}), ("window", {"reach": 2}))]
    return parts[0].unionByName(parts[1])


@query("hot", ctes("grid") + f"""SELECT scene_id, x, y, {r('"BLUE" - 0.5*"RED" - 0.08')} AS hot FROM grid""")
def _hot(spark, sf):
    return reflectance.hot(fx.grid(spark, sf)).select("scene_id", "x", "y", "hot")


def _byte(b):
    return f'least(255, greatest(0, floor(avg("{b}")*255 + 0.5)))::int'


@query("overview", ctes("grid") + f"""
SELECT scene_id, x//5 AS cx, y//5 AS cy, {_byte('RED')} AS r, {_byte('GREEN')} AS g, {_byte('BLUE')} AS b,
  CASE WHEN bool_or(class = 0) THEN 'pink' WHEN bool_or(class = 1) THEN 'red' WHEN bool_or(class = 2) THEN 'cyan'
       WHEN bool_or(class = 3) THEN 'yellow' WHEN bool_or("RED" > 0.65) THEN 'orange' WHEN bool_or("RED" < 0.35) THEN 'green' ELSE 'none' END AS overlay
FROM grid GROUP BY ALL""")
def _overview(spark, sf):
    c = F.col("class")
    return reflectance.overview(fx.grid(spark, sf), 5, {
        "cloud": c == masks.OPAQUE, "cirrus": c == masks.CIRRUS, "shadow": c == masks.SHADOW, "snow": c == masks.SNOW,
        "saturated": F.col("RED") > 0.65, "subzero": F.col("RED") < 0.35})


@query("emit_products", ctes("grid") + f"""
SELECT scene_id, x, y, 'HOT' AS product, {r('"BLUE" - 0.5*"RED" - 0.08')} AS value FROM grid
UNION ALL SELECT scene_id, x, y, 'AOD', {r('"BLUE"*0.5')} FROM grid
UNION ALL SELECT scene_id, x, y, 'WVP', {r('"NIR"*2')} FROM grid WHERE class <> 4
UNION ALL SELECT scene_id, x, y, 'VZN', {r('dem')} FROM grid""")
def _products(spark, sf):
    grid = reflectance.hot(fx.grid(spark, sf)).withColumns({
        "aod": F.col("BLUE") * 0.5, "wvp": F.when(F.col("class") != 4, F.col("NIR") * 2)})
    return reflectance.emit_products(grid, {"HOT": "hot", "AOD": "aod", "WVP": "wvp", "VZN": "dem"})


def swath(spark, sf):
    """Digital numbers along the pixel axis."""
    return fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_partkey")).alias("line_pixel"),
        F.when(F.col("l_returnflag") == "A", "VV").otherwise("VH").alias("polarisation"), (F.col("l_quantity") * 10).alias("dn"))


def calibration(spark, sf):
    """One calibration node per forty parts and polarisation."""
    nodes = fx.table(spark, sf, "part").groupBy(F.expr("p_partkey div 40").alias("node")).agg(
        F.min("p_partkey").alias("line_pixel"), (F.max("p_retailprice") / 10).alias("a"),
        (F.max("p_size") * 5.0).alias("noise"), (F.lit(30.0) + F.max("p_size") / 4).alias("incidence"))
    both = F.explode(F.array(F.struct(F.lit("VV").alias("p"), F.lit(1.0).alias("k")), F.struct(F.lit("VH").alias("p"), F.lit(1.25).alias("k"))))
    return nodes.withColumn("b", both).select(
        "line_pixel", F.col("b.p").alias("polarisation"), (F.col("a") * F.col("b.k")).alias("a"), "noise", "incidence")


_SWATH = """SELECT l_orderkey, l_linenumber, l_partkey AS line_pixel, CASE l_returnflag WHEN 'A' THEN 'VV' ELSE 'VH' END AS polarisation,
  l_quantity*10 AS dn FROM lineitem"""
_CAL = """SELECT line_pixel, p AS polarisation, a*k AS a, noise, incidence FROM (
  SELECT min(p_partkey) AS line_pixel, max(p_retailprice)/10 AS a, max(p_size)*5.0::double AS noise, 30.0::double + max(p_size)/4 AS incidence
  FROM part GROUP BY p_partkey // 40), (VALUES ('VV', 1.0::double), ('VH', 1.25::double)) v(p, k)"""
_LOOK = """SELECT s.*, CASE WHEN b.line_pixel IS NULL OR a.line_pixel IS NULL THEN NULL WHEN a.line_pixel = s.line_pixel THEN 0.0
  ELSE (s.line_pixel - a.line_pixel)::double/(b.line_pixel - a.line_pixel) END AS f,
  a.a AS a0, b.a AS a1, a.noise AS n0, b.noise AS n1, a.incidence AS i0, b.incidence AS i1 FROM s
  ASOF LEFT JOIN cal a ON a.polarisation = s.polarisation AND a.line_pixel <= s.line_pixel
  ASOF LEFT JOIN cal b ON b.polarisation = s.polarisation AND b.line_pixel >= s.line_pixel"""


@query("lut_asof", ctes(s=_SWATH, cal=_CAL, k=_LOOK) + f"""
SELECT l_orderkey, l_linenumber, line_pixel, polarisation, {r('a0 + (a1 - a0)*f')} AS a, {r('n0 + (n1 - n0)*f')} AS noise FROM k""")
def _asof(spark, sf):
    looked = sar.lut_asof(swath(spark, sf), calibration(spark, sf), "line_pixel", ["polarisation"], ["a", "noise"])
    return looked.select("l_orderkey", "l_linenumber", "line_pixel", "polarisation", "a", "noise")


@query("sar_backscatter", ctes(s=_SWATH, cal=_CAL, k=_LOOK, v="""
SELECT *, a0 + (a1 - a0)*f AS a, n0 + (n1 - n0)*f AS noise, i0 + (i1 - i0)*f AS inc FROM k""") + f"""
SELECT l_orderkey, l_linenumber, line_pixel, polarisation, dn,
       {r('CASE WHEN a IS NOT NULL THEN greatest(dn*dn - noise, 0)/nullif(a*a, 0) END')} AS sigma0,
       CASE WHEN a IS NULL THEN 2 WHEN dn = 0 THEN 1 ELSE 0 END AS mask,
       {r('1/nullif(sin(radians(inc)), 0)')} AS contributing_area, {r('inc')} AS local_incidence_angle, {r('inc')} AS ellipsoid_incidence_angle
FROM v""")
def _sar(spark, sf):
    return sar.sar_backscatter(
        swath(spark, sf), calibration(spark, sf), noise_removal=True, mask=True, contributing_area=True,
        local_incidence_angle=True, ellipsoid_incidence_angle=True)
