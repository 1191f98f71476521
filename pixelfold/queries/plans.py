"""Queries that run whole analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelfold.plans.parameters import SceneParameters, read_parameters
from pixelfold.plans.scene_preparation import flag_masks, prepare_scenes
from pixelfold.plans.series_analysis import analyse_series, analyse_together
from pixelfold.queries import fixtures as fx
from pixelfold.operators.polar import METRICS
from pixelfold.queries.analysis import METRIC_SQL, POLARMETRICS, _cat_sql, _trend_sql
from pixelfold.queries.base import query, r, rounded
from pixelfold.queries.fixtures import FIRST, LAST, ctes
from pixelfold.queries.rasters import _TERRAIN, CLOUD_STEPS, _brdf_sql, _kernels_sql, grid_sql, scattering_lut


def cube(spark, sf):
    """A reflectance product and its quality product, one acquisition per line item."""
    return fx.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("pixel_id"), (F.col("l_suppkey") % 8).alias("tile_x"), (F.expr("l_suppkey div 8") % 8).alias("tile_y"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.when(F.col("l_returnflag") == "A", "SEN2A").when(F.col("l_returnflag") == "N", "SEN2B").otherwise("SEN2C").alias("sensor"),
        ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 32768).alias("qai"),
        (F.col("l_tax") + 0.05).alias("RED"), (F.col("l_extendedprice") / 100000).alias("BNIR"),
        F.explode(F.array(F.lit("BOA"), F.lit("QAI"))).alias("product"))


@query("analyse_series", ctes(
    "dates",
    raw="""SELECT l_suppkey AS pixel_id, cast(l_shipdate AS date) AS date, l_returnflag AS sensor, (l_orderkey*7 + l_linenumber*13) % 32768 AS qai,
  l_tax + 0.05::double AS red, l_extendedprice/100000 AS nir FROM lineitem WHERE l_shipdate BETWEEN '1995-01-01' AND '2001-12-31'""",
    q="SELECT pixel_id, date, sensor, bit_or(qai) AS qai FROM raw GROUP BY ALL",
    obs="""SELECT pixel_id, date, avg((nir - red)/nullif(nir + red, 0)) AS value FROM raw JOIN (
    SELECT * FROM q WHERE NOT ((qai >> 1) & 3 = 2 OR (qai >> 4) & 1 = 1)) USING (pixel_id, date, sensor) GROUP BY 1, 2""",
    pixels="SELECT DISTINCT pixel_id FROM obs", tsi=fx.SQL["tsi"],
    **_trend_sql("SELECT pixel_id, year(date) AS step, avg(value) AS value FROM tsi WHERE value IS NOT NULL GROUP BY 1, 2", "TWO", 0.95, 60))
    + "SELECT * FROM out")
def _analyse(spark, sf):
    """Screened vegetation index, interpolated, folded by year, with the significance of its trend."""
    products = analyse_series(
        cube(spark, sf), date_range=(FIRST, LAST), index=("NDVI",), screen_qai=("CLOUD_OPAQUE", "SNOW"),
        interpolate="LINEAR", output_try=True)
    return products["NDVI_TRY"]


# Series of several indices as one, named index:pixel, then of their metrics, named index:pixel:metric.
_MANY = ctes(
    "dates",
    raw="""SELECT l_suppkey AS pixel_id, cast(l_shipdate AS date) AS date, l_returnflag AS sensor, (l_orderkey*7 + l_linenumber*13) % 32768 AS qai,
  l_tax + 0.05::double AS red, l_extendedprice/100000 AS nir FROM lineitem WHERE l_shipdate BETWEEN '1995-01-01' AND '2001-12-31'""",
    q="SELECT pixel_id, date, sensor, bit_or(qai) AS qai FROM raw GROUP BY ALL",
    clear="""SELECT pixel_id, date, avg((nir - red)/nullif(nir + red, 0)) AS "NDVI", avg((nir - red)*2.4::double/nullif(nir + red + 1, 0)) AS "EVI2",
  avg((nir - red)*1.5::double/nullif(nir + red + 0.5::double, 0)) AS "SAVI" FROM raw JOIN (
    SELECT * FROM q WHERE NOT ((qai >> 1) & 3 = 2 OR (qai >> 4) & 1 = 1)) USING (pixel_id, date, sensor) GROUP BY 1, 2""",
    obs="""SELECT "index" || ':' || pixel_id AS pixel_id, date, value FROM (UNPIVOT clear ON "NDVI", "EVI2", "SAVI" INTO NAME "index" VALUE value)""",
    pixels="SELECT DISTINCT pixel_id FROM obs", tsi=fx.SQL["tsi"], **POLARMETRICS,
    yearly="SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT pixel_id || ':{n}' AS pixel_id, pyear AS step, ({e})::double AS value FROM pol" for n, e in METRIC_SQL.items()) + ") WHERE value IS NOT NULL")
_NAMED = """SELECT split_part(pixel_id, ':', 2)::bigint AS pixel_id, split_part(pixel_id, ':', 1) AS "index", split_part(pixel_id, ':', 3) AS metric"""


def _many(spark, sf):
    return analyse_together(
        cube(spark, sf), date_range=(FIRST, LAST), index=("NDVI", "EVI2", "SAVI"), screen_qai=("CLOUD_OPAQUE", "SNOW"),
        interpolate="LINEAR", pol=METRICS, output_pol=True, output_tro=True, output_cao=True)


def _many_sql(steps, columns):
    return _MANY.rstrip() + ",\n" + ",\n".join(f"{n} AS ({q})" for n, q in steps.items()) + f"\n{_NAMED}, {columns} FROM out"


@query("together_pol", _many_sql({"out": "SELECT * FROM yearly"}, f"step, {r('value')} AS value"))
def _together_pol(spark, sf):
    """All seasonal metrics of three indices as one long table, from one scan."""
    return _many(spark, sf)["POL"]


@query("together_tro", _many_sql(_trend_sql("SELECT * FROM yearly", "TWO", 0.95, 60),
                                    """* EXCLUDE (pixel_id) REPLACE (floor("offset"*1000 + 0.50001::double)/1000 AS "offset")"""))
def _together_tro(spark, sf):
    """The trends of all seasonal metrics of three indices; the offset, a value at year 0, with three decimals."""
    return _many(spark, sf)["TRO"].withColumn("offset", F.floor(rounded(F.col("offset")) * 1000 + F.lit(0.50001)) / 1000)


@query("together_cao", _many_sql(_cat_sql("SELECT * FROM yearly", False), "* EXCLUDE (pixel_id)"))
def _together_cao(spark, sf):
    """The changes of all seasonal metrics of three indices."""
    return _many(spark, sf)["CAO"]


def _near(flag, radius):
    """Pixels within ``radius`` pixels of a flagged one."""
    return f"""SELECT DISTINCT a.scene_id, a.x, a.y FROM fl a JOIN fl b ON a.scene_id = b.scene_id
  AND (a.x - b.x)*(a.x - b.x) + (a.y - b.y)*(a.y - b.y) <= {radius}::double*{radius} WHERE b.{flag}"""


def _set(name, value):
    return f"CASE WHEN {name}.x IS NOT NULL THEN {value} ELSE 0 END"


@query("prepare_scenes", ctes(
    "grid", **CLOUD_STEPS,
    fl="SELECT f.*, g.class = 1 AS cirrus, g.class = 3 AS snow, NOT f.cloud AND m.top - f.nir > 0.1 AS shadow "
       "FROM f JOIN m USING (scene_id, x, y) JOIN grid g USING (scene_id, x, y)",
    nc=_near("cloud", 2), ni=_near("cirrus", 0), ns=_near("shadow", 1), nw=_near("snow", 1.5),
    points="SELECT DISTINCT x*1000 + y AS item_id, 10.0::double + x*0.01::double AS lon, 50.0::double - y*0.01::double AS lat FROM grid",
    pg=grid_sql("GLANCE7")) + f"""
SELECT g.scene_id, g.x, g.y, {r('g."BLUE"')} AS "BLUE", {r('g."GREEN"')} AS "GREEN", {r('g."RED"')} AS "RED",
  2*CASE WHEN fl.cloud THEN 2 WHEN ni.x IS NOT NULL THEN 3 WHEN nc.x IS NOT NULL THEN 1 ELSE 0 END + {_set('ns', 8)} + {_set('nw', 16)} AS qai,
  pg.zone, printf('X%04d_Y%04d', floor(pg.px/pg.size)::int, floor(-pg.py/pg.size)::int) AS tile
FROM grid g JOIN fl USING (scene_id, x, y) JOIN pg ON pg.item_id = g.x*1000 + g.y
LEFT JOIN nc USING (scene_id, x, y) LEFT JOIN ni USING (scene_id, x, y) LEFT JOIN ns USING (scene_id, x, y) LEFT JOIN nw USING (scene_id, x, y)""")
def _prepare(spark, sf):
    """Flagged, buffered and gridded scenes; the corrections have queries of their own."""
    placed = fx.grid(spark, sf).withColumns({"lon": F.lit(10.0) + F.col("x") * 0.01, "lat": F.lit(50.0) - F.col("y") * 0.01})
    out = prepare_scenes(
        placed, cloud_threshold=0.02, shadow_threshold=0.1, cloud_buffer=40, shadow_buffer=20, snow_buffer=30,
        max_cloud_cover_frame=100, max_cloud_cover_tile=100, do_atmo=False, do_topo=False, do_brdf=False)["TOA"]
    return out.select("scene_id", "x", "y", "BLUE", "GREEN", "RED", "qai", "zone", "tile")


# Stretched rasters of three scenes a block, so that every condition of the quality word occurs.
def wide_scenes(spark, sf):
    grid = fx.grid(spark, sf).withColumn("scene_id", F.col("scene_id") * 3 + F.floor(F.col("y") / 4).cast("int"))
    raw = fx.table(spark, sf, "embeddings").select(
        (F.expr("vec_id div 250") * 3 + F.floor(F.expr("(vec_id % 250) div 25") / 4)).cast("bigint").alias("scene_id"),
        (F.col("vec_id") % 25).cast("int").alias("x"), F.expr("(vec_id % 250) div 25").cast("int").alias("y"),
        (F.col("embedding")[10].cast("double") * 0.05).alias("CIRRUS"))
    even = F.floor(F.col("scene_id") / 3) % 2 == 0
    bands = {b: F.when(F.col("class") != 4, (F.col(b) - 0.5) * 2.5 + 0.35 + (F.when(F.col("x") == 7, 0.7).otherwise(0.0) if b == "SWIR2" else 0.0))
             for b in fx.BANDS}
    return grid.join(raw, ["scene_id", "x", "y"]).withColumns({
        **bands, "dem": F.col("dem") * 0.03, "sun_zenith": F.when(even, 35.0).otherwise(78.0),
        "sun_azimuth": F.when(even, 100.0).otherwise(250.0), "wvp": F.when(F.col("class") != 9, F.col("NIR"))}).drop("class")


def _stretched(b):
    more = " + CASE WHEN x = 7 THEN 0.7::double ELSE 0 END" if b == "SWIR2" else ""
    return f'CASE WHEN class <> 4 THEN ("{b}" - 0.5)*2.5::double + 0.35::double{more} END AS "{b}"'


def _state(*pairs):
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + " ELSE 0 END"


LINES = """SELECT *, sin(radians(azi)) AS e, -cos(radians(azi)) AS s,
  CASE WHEN abs(e) >= abs(s) THEN y - floor(s/e*x + 0.5) ELSE x - floor(e/s*y + 0.5) END AS line,
  CASE WHEN abs(e) >= abs(s) THEN x*sign(e)*sqrt(1 + (s/e)**2)*20 ELSE y*sign(s)*sqrt(1 + (e/s)**2)*20 END AS ahead FROM lit"""
SHADED = """SELECT scene_id, x, y, coalesce(max(h) OVER (PARTITION BY scene_id, line ORDER BY ahead DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > h, false) AS shaded
  FROM (SELECT *, dem - ahead/tan(radians(zen)) AS h FROM l)"""
UNDER = """SELECT scene_id, x, y, coalesce(bool_or(cloud) OVER (PARTITION BY scene_id, line ORDER BY ahead/tan(radians(zen))
  RANGE BETWEEN 200.0::double FOLLOWING AND 12000.0::double FOLLOWING), false) AS under FROM l JOIN f USING (scene_id, x, y)"""


@query("quality_word", ctes(
    "grid", raw="""SELECT g.* EXCLUDE (scene_id), g.scene_id*3 + g.y//4 AS scene_id, embedding[11]::double*0.05::double AS cir
  FROM grid g JOIN embeddings v ON g.scene_id = v.vec_id//250 AND g.x = v.vec_id % 25 AND g.y = (v.vec_id % 250)//25""")
    .replace("WITH grid AS", "WITH RECURSIVE first AS").replace("FROM grid g", "FROM first g").rstrip() + ",\n" + ",\n".join(f"{n} AS ({q})" for n, q in {
    "grid": "SELECT scene_id, x, y, class, cir, dem*0.03::double AS dem, CASE WHEN class <> 9 THEN \"NIR\" END AS wvp, "
            + ", ".join(_stretched(b) for b in fx.BANDS) + " FROM raw",
    "lit": """SELECT *, CASE WHEN scene_id//3 % 2 = 0 THEN 35.0::double ELSE 78 END AS zen, CASE WHEN scene_id//3 % 2 = 0 THEN 100.0::double ELSE 250 END AS azi FROM grid""",
    "t": _TERRAIN, "l": LINES, "sh": SHADED, **CLOUD_STEPS, "u": UNDER,
    "fl": """SELECT f.scene_id, f.x, f.y, coalesce(f.cloud, false) AS cloud, NOT coalesce(f.cloud, false) AND coalesce(m.top - f.nir > 0.1, false) AND u.under AS shadow,
  g.cir > 0.01 AS cirrus, NOT coalesce(f.cloud, false) AND coalesce(("GREEN"-"SWIR1")/nullif("GREEN"+"SWIR1", 0) > 0.4 AND "BNIR" > 0.11 AND "GREEN" > 0.1, false) AS snow,
  coalesce((("BNIR"-"RED")/nullif("BNIR"+"RED", 0) < 0.01 AND "BNIR" < 0.11) OR (("BNIR"-"RED")/nullif("BNIR"+"RED", 0) < 0.1 AND "BNIR" < 0.05), false) AS water
  FROM f JOIN grid g USING (scene_id, x, y) JOIN u USING (scene_id, x, y) LEFT JOIN m USING (scene_id, x, y)""",
    "nc": _near("cloud", 2), "ni": _near("cirrus", 1), "ns": _near("shadow", 1), "nw": _near("snow", 1.5),
    "a": """SELECT scene_id, x//4 AS ax, y//4 AS ay, count("BLUE") FILTER (NOT (cloud OR cirrus OR shadow)) AS n,
  greatest(0, (quantile_cont("BLUE", 0.01) FILTER (NOT (cloud OR cirrus OR shadow)) - 0.02)*5) AS own FROM grid JOIN fl USING (scene_id, x, y) GROUP BY ALL""",
    "ae": "SELECT *, avg(CASE WHEN n >= 12 THEN own END) OVER (PARTITION BY scene_id) AS mean FROM a",
    "q": "SELECT *, cos(radians(zen))*cos(slope) + sin(radians(zen))*sin(slope)*cos(radians(azi) - aspect) AS ci FROM lit JOIN t USING (scene_id, x, y)",
}.items()) + f"""
SELECT scene_id, x, y, {_state(('class = 4', 1))} + {_state(('fl.cloud', 4), ('ni.x IS NOT NULL', 6), ('nc.x IS NOT NULL', 2))}
  + {_state(('ns.x IS NOT NULL', 8))} + {_state(('nw.x IS NOT NULL', 16))} + {_state(('fl.water AND NOT fl.cloud', 32))}
  + {_state(('ae.mean IS NULL', 192), ('ae.n < 12', 64), ('coalesce(CASE WHEN ae.n >= 12 THEN ae.own END, ae.mean) > 0.6', 128))}
  + {_state((' OR '.join(f'"{b}" < 0' for b in fx.BANDS), 256))} + {_state((' OR '.join(f'"{b}" > 1' for b in fx.BANDS), 512))}
  + {_state(('zen > 75', 1024))} + {_state(('sh.shaded OR ci <= 0', 3 << 11), ('ci < cos(radians(80))', 2 << 11), ('ci < cos(radians(55))', 1 << 11))}
  + {_state(('degrees(slope) > 2', 1 << 13))} + {_state(('wvp IS NULL', 1 << 14))} AS qai
FROM q JOIN fl USING (scene_id, x, y) JOIN sh USING (scene_id, x, y) JOIN ae ON ae.scene_id = q.scene_id AND ae.ax = q.x//4 AND ae.ay = q.y//4
LEFT JOIN nc USING (scene_id, x, y) LEFT JOIN ni USING (scene_id, x, y) LEFT JOIN ns USING (scene_id, x, y) LEFT JOIN nw USING (scene_id, x, y)""")
def _quality_word(spark, sf):
    """All 18 conditions of the quality word, each from its own test."""
    p = read_parameters(SceneParameters, dict(
        cloud_threshold=0.02, shadow_threshold=0.1, cloud_buffer=40, cirrus_buffer=20, shadow_buffer=20, snow_buffer=30))
    return flag_masks(wide_scenes(spark, sf), p, aerosol_cell=4, aerosol_least=12).select("scene_id", "x", "y", "qai")


_FULL_BANDS = ("BLUE", "GREEN", "RED")


def _each(template, bands=_FULL_BANDS):
    return ", ".join(template.format(b=b, i=i) for i, b in enumerate(bands))


# atmosphere, terrain, adjacency and anisotropy one after another; bands without coefficients end as NULL
_FULL = {
    "lit": "SELECT *, 35.0::double AS zen, 150.0::double AS azi FROM grid", "t": _TERRAIN, "l": LINES, "sh": SHADED,
    **{n: q.replace("+ 0.02 ", "+ 0.05::double ") for n, q in CLOUD_STEPS.items()}, "u": UNDER,
    "fl": """SELECT f.scene_id, f.x, f.y, f.cloud, NOT f.cloud AND m.top - f.nir > 0.1 AND u.under AS shadow, g.class = 1 AS cirrus, g.class = 3 AS snow,
  coalesce((("BNIR"-"RED")/nullif("BNIR"+"RED", 0) < 0.01 AND "BNIR" < 0.11) OR (("BNIR"-"RED")/nullif("BNIR"+"RED", 0) < 0.1 AND "BNIR" < 0.05), false) AS water
  FROM f JOIN grid g USING (scene_id, x, y) JOIN u USING (scene_id, x, y) JOIN m USING (scene_id, x, y)""",
    "nc": _near("cloud", 15), "ni": _near("cirrus", 0), "ns": _near("shadow", 4.5), "nw": _near("snow", 1.5),
    "ae": """SELECT scene_id, count(*) FILTER (NOT (cloud OR cirrus OR shadow)) AS n,
  greatest(0, (quantile_cont("BLUE", 0.01) FILTER (NOT (cloud OR cirrus OR shadow)) - 0.02)*5) AS aod FROM grid JOIN fl USING (scene_id, x, y) GROUP BY 1""",
    "k": 'SELECT scene_id, avg("BLUE") AS mb FROM grid GROUP BY 1',
    "y": "SELECT g.scene_id, g.x, g.y, t.slope, t.cos_i, " + _each(
        '"{b}"/(0.9::double + 0.01::double*{i}) - mb*0.2::double/({i}+2) AS "{b}"') + " FROM grid g JOIN k USING (scene_id) JOIN t USING (scene_id, x, y)",
    "am": "SELECT scene_id, x, y, slope, cos_i, " + _each('"{b}"/((0.8::double + 0.02::double*{i}) + 0.02::double*"{b}") AS "{b}"') + " FROM y",
    "ft": "SELECT scene_id, " + _each('regr_intercept("{b}", cos_i)/nullif(regr_slope("{b}", cos_i), 0) AS "c{b}"') + " FROM am GROUP BY 1",
    "tp": "SELECT scene_id, x, y, slope, cos_i, " + _each(
        'coalesce("{b}"*(cos(radians(35.0)) + "c{b}")/nullif(cos_i + "c{b}", 0), "{b}") AS "{b}"') + " FROM am JOIN ft USING (scene_id)",
    "ad": "SELECT a.scene_id, a.x, a.y, any_value(a.slope) AS slope, any_value(a.cos_i) AS cos_i, " + _each(
        'any_value(a."{b}") + 0.1::double*(any_value(a."{b}") - avg(b."{b}")) AS "{b}"') + """ FROM tp a JOIN tp b
  ON a.scene_id = b.scene_id AND abs(a.x - b.x) <= 3 AND abs(a.y - b.y) <= 3 GROUP BY 1, 2, 3""",
    "br": "SELECT *, radians(35.0) AS s, radians(5.0) AS v, radians(60.0) AS p FROM ad",
    "ke": f"SELECT *, {_kernels_sql('v', 'p', 1)}, {_kernels_sql('0.0', '0.0', 0)} FROM br",
    "points": "SELECT DISTINCT x*1000 + y AS item_id, 10.0::double + x*0.01::double AS lon, 50.0::double - y*0.01::double AS lat FROM grid",
    "pg": grid_sql("GLANCE7"),
    "fr": "SELECT scene_id FROM fl GROUP BY 1 HAVING avg(CASE WHEN cloud OR cirrus THEN 100.0 ELSE 0 END) <= 99",
}


@query("prepare_scenes_full", ctes("grid").replace("WITH ", "WITH RECURSIVE ").rstrip() + ",\n" + ",\n".join(f"{n} AS ({q})" for n, q in _FULL.items()) + f"""
SELECT scene_id, x, y, {', '.join(_brdf_sql(b) for b in _FULL_BANDS)},
  {_state(('fl.cloud', 4), ('ni.x IS NOT NULL', 6), ('nc.x IS NOT NULL', 2))} + {_state(('ns.x IS NOT NULL', 8))} + {_state(('nw.x IS NOT NULL', 16))}
  + {_state(('fl.water AND NOT fl.cloud', 32))} + {_state(('ae.n < 20', 192), ('ae.aod > 0.6', 128))}
  + {_state(('sh.shaded OR ke.cos_i <= 0', 3 << 11), ('ke.cos_i < cos(radians(80))', 2 << 11), ('ke.cos_i < cos(radians(55))', 1 << 11))}
  + {_state(('degrees(ke.slope) > 2', 1 << 13))} AS qai,
  pg.zone, printf('X%04d_Y%04d', floor(pg.px/pg.size)::int, floor(-pg.py/pg.size)::int) AS tile
FROM ke JOIN fr USING (scene_id) JOIN fl USING (scene_id, x, y) JOIN sh USING (scene_id, x, y) JOIN ae USING (scene_id) JOIN pg ON pg.item_id = ke.x*1000 + ke.y
LEFT JOIN nc USING (scene_id, x, y) LEFT JOIN ni USING (scene_id, x, y) LEFT JOIN ns USING (scene_id, x, y) LEFT JOIN nw USING (scene_id, x, y)""")
def _prepare_full(spark, sf):
    """All corrections on, from the flags to the grid."""
    angled = fx.grid(spark, sf).withColumns({
        "lon": F.lit(10.0) + F.col("x") * 0.01, "lat": F.lit(50.0) - F.col("y") * 0.01,
        "sun_zenith": F.lit(35.0), "sun_azimuth": F.lit(150.0), "view_zenith": F.lit(5.0), "rel_azimuth": F.lit(60.0)})
    out = prepare_scenes(angled, scattering_lut(angled), cloud_threshold=0.05, shadow_threshold=0.1)["BOA"]
    return out.select("scene_id", "x", "y", "BLUE", "GREEN", "RED", "qai", "zone", "tile")
