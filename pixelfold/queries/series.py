"""Queries over quality screening, series building and interpolation."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import functions as F

from pixelfold.functions import indices
from pixelfold.functions import qai as q
from pixelfold.operators import harmonic, interpolate, quality, series
from pixelfold.queries import fixtures as fx
from pixelfold.queries.base import d, query, r
from pixelfold.queries.fixtures import FIRST, LAST, STEP, ctes


def _flag(name):
    bit, mask, state = q.LAYOUT[name]
    return f"(qai >> {bit}) & {mask} = {state}"


def _clear(names=q.DEFAULT_SCREEN):
    return "NOT (" + " OR ".join(f"({_flag(n)})" for n in names) + ")"


@query("decode_qai", ctes("obs_raw") + "SELECT l_orderkey, l_linenumber, "
       + ", ".join(f'{_flag(n)} AS "{n}"' for n in q.LAYOUT) + " FROM obs_raw")
def _decode(spark, sf):
    return quality.decode_qai(fx.obs_raw(spark, sf).select("l_orderkey", "l_linenumber", "qai")).drop("qai")


@query("screen_qai", ctes("obs_raw") + f"SELECT l_orderkey, l_linenumber, qai, {r('value')} AS value FROM obs_raw WHERE {_clear()}")
def _screen(spark, sf):
    return quality.screen_qai(fx.obs_raw(spark, sf)).select("l_orderkey", "l_linenumber", "qai", "value")


def _noise_pass(source):
    return f"""
SELECT pixel_id, date, value FROM (
  SELECT *, min(CASE WHEN res = worst AND res > 3 * noise THEN date END) OVER (PARTITION BY pixel_id) AS cut FROM (
    SELECT *, sqrt(avg(res*res) OVER (PARTITION BY pixel_id)) AS noise, max(res) OVER (PARTITION BY pixel_id) AS worst FROM (
      SELECT *, abs(value - (v0 + (v1 - v0)*((date - d0)::double/(d1 - d0)))) AS res FROM (
        SELECT *, lag(value) OVER w AS v0, lag(date) OVER w AS d0, lead(value) OVER w AS v1, lead(date) OVER w AS d1
        FROM {source} WINDOW w AS (PARTITION BY pixel_id ORDER BY date)))))
WHERE cut IS NULL OR cut <> date"""


def _spiky():
    """A calm series with the spikes of the obs values, so that outliers exist."""
    return "SELECT pixel_id, date, value*value*value*value AS value FROM obs"


def spiky(spark, sf):
    v = F.col("value")
    return fx.obs(spark, sf).select("pixel_id", "date", (v * v * v * v).alias("value"))


# every pass drops one value from each series that still has an outlier
_NOISE = f"""
WITH RECURSIVE {ctes("obs", s=_spiky()).strip().removeprefix("WITH ")}, passes AS (
  SELECT 0 AS n, pixel_id, date, value FROM s
  UNION ALL
  SELECT n + 1, pixel_id, date, value FROM (
  SELECT *, min(CASE WHEN res = worst AND res > 3 * noise THEN date END) OVER (PARTITION BY pixel_id) AS cut FROM (
    SELECT *, sqrt(avg(res*res) OVER (PARTITION BY pixel_id)) AS noise, max(res) OVER (PARTITION BY pixel_id) AS worst FROM (
      SELECT *, abs(value - (v0 + (v1 - v0)*((date - d0)::double/(d1 - d0)))) AS res FROM (
        SELECT *, lag(value) OVER w AS v0, lag(date) OVER w AS d0, lead(value) OVER w AS v1, lead(date) OVER w AS d1
        FROM passes WINDOW w AS (PARTITION BY pixel_id ORDER BY date)))))
  WHERE cut IS NOT NULL AND cut <> date
)
SELECT pixel_id, {d('date')} AS date, {r('value')} AS value FROM passes
JOIN (SELECT pixel_id, max(n) AS n FROM passes GROUP BY pixel_id) USING (pixel_id, n)"""


@query("noise_filter", _NOISE)
def _noise(spark, sf):
    return quality.noise_filter(spiky(spark, sf), 3.0)


@query("noise_restore", ctes("obs", k=f"SELECT pixel_id, date, value, {_clear()} AS kept FROM obs", n="""
SELECT k.*, a.date AS d0, a.value AS v0, b.date AS d1, b.value AS v1 FROM k
ASOF LEFT JOIN (SELECT * FROM k WHERE kept) a ON a.pixel_id = k.pixel_id AND a.date < k.date
ASOF LEFT JOIN (SELECT * FROM k WHERE kept) b ON b.pixel_id = k.pixel_id AND b.date > k.date""", m="""
SELECT *, abs(value - (v0 + (v1 - v0)*((date - d0)::double/(d1 - d0)))) AS res FROM n""", z="""
SELECT *, NOT kept AND coalesce(res < sqrt(avg(CASE WHEN kept THEN res*res END) OVER (PARTITION BY pixel_id)), false) AS restored FROM m""")
       + f"SELECT pixel_id, {d('date')} AS date, {r('value')} AS value, kept, restored FROM z WHERE kept OR restored")
def _restore(spark, sf):
    marked = quality.mark_screened(fx.obs(spark, sf)).drop("qai")
    return quality.noise_restore(marked, 1.0)


@query("band_values", ctes("grid") + f'SELECT scene_id, x, y, class, {r("dem")} AS dem, {r(chr(34) + "SWIR1" + chr(34))} AS value FROM grid')
def _band(spark, sf):
    return series.band_values(fx.grid(spark, sf), "SWIR1")


def _nd(a, b):
    return f'("{a}"-"{b}")/nullif("{a}"+"{b}",0)'


def _tc(name):
    return " + ".join(f'({w})*"{role}"' for role, w in indices.TASSELED_CAP[name].items())


def _msr(nir):
    return f'("{nir}"/nullif("RE1",0) - 1)/sqrt("{nir}"/nullif("RE1",0) + 1)'


_RB = '("RED"-("BLUE"-"RED"))'
INDEX_SQL = {
    "NDVI": _nd("BNIR", "RED"), "EVI": '2.5*("BNIR"-"RED")/nullif("BNIR"+6*"RED"-7.5*"BLUE"+1,0)',
    "NBR": _nd("BNIR", "SWIR2"), "NDTI": _nd("SWIR1", "SWIR2"),
    "ARVI": f'("BNIR"-{_RB})/nullif("BNIR"+{_RB},0)', "SAVI": '1.5*("BNIR"-"RED")/nullif("BNIR"+"RED"+0.5,0)',
    "SARVI": f'1.5*("BNIR"-{_RB})/nullif("BNIR"+{_RB}+0.5,0)',
    "TC-BRIGHT": _tc("TC-BRIGHT"), "TC-GREEN": _tc("TC-GREEN"), "TC-WET": _tc("TC-WET"),
    "TC-DI": f'({_tc("TC-BRIGHT")}) - (({_tc("TC-GREEN")}) + ({_tc("TC-WET")}))',
    "NDBI": _nd("SWIR1", "BNIR"), "NDWI": _nd("GREEN", "BNIR"), "MNDWI": _nd("GREEN", "SWIR1"), "NDMI": _nd("BNIR", "SWIR1"),
    "NDSI": _nd("GREEN", "SWIR1"), "kNDVI": f"(exp(2*({_nd('BNIR', 'RED')})**2)-1)/(exp(2*({_nd('BNIR', 'RED')})**2)+1)",
    "NDRE1": _nd("RE2", "RE1"), "NDRE2": _nd("RE3", "RE1"), "CIre": '"RE3"/nullif("RE1",0)-1',
    "NDVIre1": _nd("BNIR", "RE1"), "NDVIre2": _nd("BNIR", "RE2"), "NDVIre3": _nd("BNIR", "RE3"),
    "NDVIre1n": _nd("NIR", "RE1"), "NDVIre2n": _nd("NIR", "RE2"), "NDVIre3n": _nd("NIR", "RE3"),
    "MSRre": _msr("BNIR"), "MSRren": _msr("NIR"), "CCI": _nd("GREEN", "RED"),
    "EVI2": '2.4*("BNIR"-"RED")/nullif("BNIR"+"RED"+1,0)',
    "ContRemSWIR": '"SWIR1"/nullif("BNIR"+("SWIR2"-"BNIR")*(16.137-8.328)::double/(22.024-8.328)::double,0)',
}


@query("spectral_index", ctes("grid") + "SELECT scene_id, x, y, " + ", ".join(f'{r(e)} AS "{n}"' for n, e in INDEX_SQL.items()) + " FROM grid")
def _index(spark, sf):
    return series.spectral_index(fx.grid(spark, sf), indices.INDEX_NAMES, keep=["scene_id", "x", "y"])


# Two endmembers over three bands, and two materials (parameters of the queries).
ENDMEMBERS = {"soil": [0.30, 0.35, 0.40], "leaf": [0.05, 0.50, 0.25]}
SMA_BANDS = ("RED", "BNIR", "SWIR1")
_S, _L = ENDMEMBERS["soil"], ENDMEMBERS["leaf"]
_SS, _LL, _SL = (sum(a * b for a, b in zip(p, w)) for p, w in ((_S, _S), (_L, _L), (_S, _L)))


def _dot(m):
    return "(" + " + ".join(f'"{b}"*{v}' for b, v in zip(SMA_BANDS, m)) + ")"


@query("sma", ctes("grid", f=f"""
SELECT *, ({_LL}::double*{_dot(_S)} - {_SL}::double*{_dot(_L)})/{_SS * _LL - _SL * _SL}::double AS fs,
          ({_SS}::double*{_dot(_L)} - {_SL}::double*{_dot(_S)})/{_SS * _LL - _SL * _SL}::double AS fl FROM grid""") + f"""
SELECT scene_id, x, y, {r('fs')} AS frac_soil, {r('fl')} AS frac_leaf,
  {r('sqrt((' + ' + '.join(f'("{b}" - fs*{s} - fl*{v})**2' for b, s, v in zip(SMA_BANDS, _S, _L)) + ')/3)')} AS sma_rmse FROM f""")
def _sma(spark, sf):
    return series.sma(fx.grid(spark, sf), ENDMEMBERS, SMA_BANDS).select("scene_id", "x", "y", "frac_soil", "frac_leaf", "sma_rmse")


_SHARE = " + ".join(f'("{b}" - {v}::double)*{s - v}::double' for b, s, v in zip(SMA_BANDS, _S, _L))


@query("sma_constrained", ctes("grid", f=f"""
SELECT *, greatest(0, least(1, ({_SHARE})/{sum((s - v) ** 2 for s, v in zip(_S, _L))}::double)) AS fs FROM grid""") + f"""
SELECT scene_id, x, y, {r('fs')} AS frac_soil, {r('1 - fs')} AS frac_leaf,
  {r('sqrt((' + ' + '.join(f'("{b}" - fs*{s} - (1 - fs)*{v})**2' for b, s, v in zip(SMA_BANDS, _S, _L)) + ')/3)')} AS sma_rmse FROM f""")
def _sma_constrained(spark, sf):
    """No fraction below zero, all of them one together."""
    return series.sma_constrained(fx.grid(spark, sf), ENDMEMBERS, SMA_BANDS).select("scene_id", "x", "y", "frac_soil", "frac_leaf", "sma_rmse")


MATERIALS = [
    {"name": "bright", "spectrum": [0.5, 0.5, 0.5], "transfer": {"RED": (0.01, {"RED": 0.98}), "NIRX": (0.0, {"BNIR": 0.6, "SWIR1": 0.4})}},
    {"name": "green", "spectrum": [0.4, 0.6, 0.5], "transfer": {"RED": (-0.02, {"RED": 1.03}), "NIRX": (0.05, {"BNIR": 0.9})}},
    {"name": "dry", "spectrum": [0.5, 0.4, 0.6], "transfer": {"RED": (0.0, {"RED": 1.0, "SWIR1": 0.05}), "NIRX": (0.02, {"SWIR1": 0.8})}},
]


def _angle(m):
    norm = math.sqrt(sum(v * v for v in m["spectrum"]))
    return f'{_dot(m["spectrum"])}/(sqrt("RED"**2 + "BNIR"**2 + "SWIR1"**2)*{norm}::double)'


def _transfer(out):
    cases = []
    for i, m in enumerate(MATERIALS):
        offset, weights = m["transfer"][out]
        cases.append(f"WHEN {i} THEN {offset} + " + " + ".join(f'"{b}"*{w}' for b, w in weights.items()))
    return f"CASE m {' '.join(cases)} END"


@query("spectral_adjust", ctes("grid", a="SELECT *, " + ", ".join(f"{_angle(m)} AS c{i}" for i, m in enumerate(MATERIALS)) + " FROM grid",
                               m="SELECT *, CASE WHEN c0 >= c1 AND c0 >= c2 THEN 0 WHEN c1 >= c2 THEN 1 ELSE 2 END AS m FROM a") + f"""
SELECT scene_id, x, y, CASE class % 3 WHEN 0 THEN 'SEN2B' WHEN 1 THEN 'SEN2C' ELSE 'LND08' END AS sensor,
  CASE m {' '.join(f"WHEN {i} THEN '{x['name']}'" for i, x in enumerate(MATERIALS))} END AS material,
  {r(_transfer('RED'))} AS "RED", {r(_transfer('NIRX'))} AS "NIRX" FROM m WHERE class <> 9""")
def _adjust(spark, sf):
    sensor = F.when(F.col("class") == 9, "OTHER").when(F.col("class") % 3 == 0, "SEN2B").when(F.col("class") % 3 == 1, "SEN2C").otherwise("LND08")
    grid = fx.grid(spark, sf).select("scene_id", "x", "y", *SMA_BANDS, sensor.alias("sensor"))
    return series.spectral_adjust(grid, MATERIALS, SMA_BANDS, ["RED", "NIRX"])


@query("time_series_stack", ctes("obs") + f"""
SELECT pixel_id, row_number() OVER (PARTITION BY pixel_id ORDER BY date) - 1 AS layer, {d('date')} AS date, {r('value')} AS value FROM obs""")
def _stack(spark, sf):
    stacks = series.time_series_stack(fx.obs(spark, sf))
    return stacks.select("pixel_id", F.posexplode("stack").alias("layer", "o")).select("pixel_id", "layer", "o.date", "o.value")


@query("standardize", ctes("obs") + f"""
SELECT pixel_id, {d('date')} AS date, {r('value - avg(value) OVER w')} AS centred,
       {r('(value - avg(value) OVER w)/nullif(stddev_samp(value) OVER w, 0)')} AS normalized
FROM obs WINDOW w AS (PARTITION BY pixel_id)""")
def _standardize(spark, sf):
    both = fx.obs(spark, sf).select("pixel_id", "date", F.col("value").alias("centred"), F.col("value").alias("normalized"))
    return series.standardize(series.standardize(both, "CENTER", value="centred"), "NORMALIZE", value="normalized")


LAYERS = ("1995", "1996", "1997", "1998", "1999", "2000", "2001")


def yearly(spark, sf):
    from pixelfold.operators.fold import fold
    return fold(fx.obs(spark, sf), "Y").withColumn("layer", F.col("step").cast("string"))


@query("pivot_stack", ctes("obs") + "SELECT pixel_id, " + ", ".join(
    f"{r(f'avg(value) FILTER (year(date) = {y})')} AS \"{y}\"" for y in LAYERS) + " FROM obs GROUP BY 1")
def _pivot(spark, sf):
    return series.pivot_stack(yearly(spark, sf), LAYERS)


@query("explode_stack", ctes("obs") + f"""
SELECT pixel_id, year(date)::varchar AS layer, {r('avg(value)')} AS value FROM obs GROUP BY 1, 2""")
def _explode(spark, sf):
    return series.explode_stack(series.pivot_stack(yearly(spark, sf), LAYERS), LAYERS)


@query("interp_grid", ctes("obs", "pixels", "dates") + f"SELECT pixel_id, {d('date')} AS date FROM pixels, dates")
def _grid(spark, sf):
    return interpolate.interp_grid(fx.obs(spark, sf), FIRST, LAST, STEP)


@query("interp_linear", ctes("tsi") + f"SELECT pixel_id, {d('date')} AS date, {r('value')} AS value FROM tsi")
def _linear(spark, sf):
    return fx.tsi(spark, sf)


@query("interp_moving", ctes("obs", "pixels", "dates") + f"""
SELECT p.pixel_id, {d('g.date')} AS date, {r('avg(o.value)')} AS value FROM pixels p CROSS JOIN dates g
LEFT JOIN obs o ON o.pixel_id = p.pixel_id AND o.date BETWEEN g.date - 16 AND g.date + 16 GROUP BY p.pixel_id, g.date""")
def _moving(spark, sf):
    return interpolate.interp_moving(fx.obs(spark, sf), FIRST, LAST, STEP, 16)


_HALVES = {s: interpolate.rbf_half_width(s, 0.95) for s in (8, 16, 32)}


def _rbf_sums():
    out = []
    for s, h in _HALVES.items():
        w = f"CASE WHEN abs(gap) <= {h} THEN exp(-(gap*gap)/{2.0 * s * s}::double) END"
        out.append(f"sum({w}) AS w{s}, sum({w}*value) AS v{s}, count({w})/{2 * h + 1}::double AS n{s}")
    return ", ".join(out)


_RBF_TOP = " + ".join(f"coalesce(n{s}*v{s}/w{s}, 0)" for s in _HALVES)
_RBF_BOTTOM = " + ".join(f"n{s}" for s in _HALVES)


_RBF_GAPS = f"""
SELECT p.pixel_id, g.date, o.value, (g.date - o.date)::double AS gap FROM pixels p CROSS JOIN dates g
LEFT JOIN obs o ON o.pixel_id = p.pixel_id AND abs(g.date - o.date) <= {_HALVES[32]}"""


@query("interp_rbf", ctes("obs", "pixels", "dates", g=_RBF_GAPS,
                          s=f"SELECT pixel_id, date, {_rbf_sums()} FROM g GROUP BY ALL") + f"""
SELECT pixel_id, {d('date')} AS date, {r(f'({_RBF_TOP})/nullif({_RBF_BOTTOM}, 0)')} AS value FROM s""")
def _rbf(spark, sf):
    return interpolate.interp_rbf(fx.obs(spark, sf), FIRST, LAST, STEP, (8, 16, 32), 0.95)


FIT_END = "1999-12-31"

# Cramer's rule for intercept, cosine and sine.
HARMONIC = {
    "trig": f"""SELECT pixel_id, date, value, cos(2*pi()*(date - date '{FIRST}')/365.25::double) AS c,
  sin(2*pi()*(date - date '{FIRST}')/365.25::double) AS s FROM obs WHERE date BETWEEN '{FIRST}' AND '{FIT_END}'""",
    "sums": """SELECT pixel_id, count(*) AS n, sum(c) AS c, sum(s) AS s, sum(c*c) AS cc, sum(c*s) AS cs, sum(s*s) AS ss,
  sum(value) AS v, sum(c*value) AS vc, sum(s*value) AS vs, sum(value*value) AS vv FROM trig GROUP BY 1""",
    "det": "SELECT *, n*(cc*ss - cs*cs) - c*(c*ss - cs*s) + s*(c*cs - cc*s) AS det FROM sums",
    "raw": """SELECT *, (v*(cc*ss - cs*cs) - c*(vc*ss - cs*vs) + s*(vc*cs - cc*vs))/nullif(det, 0) AS c0,
  (n*(vc*ss - cs*vs) - v*(c*ss - cs*s) + s*(c*vs - vc*s))/nullif(det, 0) AS c1,
  (n*(cc*vs - vc*cs) - c*(c*vs - vc*s) + v*(c*cs - cc*s))/nullif(det, 0) AS c2 FROM det""",
    "coef": "SELECT pixel_id, n AS n_obs, c0, c1, c2, sqrt(greatest(0, vv - c0*v - c1*vc - c2*vs)/n) AS rmse FROM raw",
}


def season_model(spark, sf):
    return harmonic.harmonic_fit(fx.obs(spark, sf), FIRST, 1, False, (FIRST, FIT_END))


@query("harmonic_fit", ctes("obs", **HARMONIC) + f"SELECT pixel_id, n_obs, {r('c0')} AS c0, {r('c1')} AS c1, {r('c2')} AS c2, {r('rmse')} AS rmse FROM coef")
def _harmonic(spark, sf):
    fit = season_model(spark, sf)
    return fit.select("pixel_id", "n_obs", *[F.col("coef")[i].alias(f"c{i}") for i in range(3)], "rmse")


def _model(date):
    angle = f"2*pi()*({date} - date '{FIRST}')/365.25::double"
    return f"(c0 + c1*cos({angle}) + c2*sin({angle}))"


@query("interp_harmonic", ctes("obs", "dates", **HARMONIC) + f"""
SELECT pixel_id, {d('date')} AS date, {r(_model('date'))} AS value FROM coef, dates""")
def _interp_harmonic(spark, sf):
    return harmonic.interp_harmonic(season_model(spark, sf), FIRST, LAST, STEP, FIRST, 1, False)


@query("nrt_residual", ctes("obs", **HARMONIC) + f"""
SELECT pixel_id, {d('date')} AS date, {r('value')} AS value, {r(_model('date'))} AS expected, {r('value - ' + _model('date'))} AS residual, {r('rmse')} AS rmse
FROM obs JOIN coef USING (pixel_id) WHERE date > '{FIT_END}'""")
def _nrt(spark, sf):
    return harmonic.nrt_residual(fx.obs(spark, sf), season_model(spark, sf), FIT_END, FIRST, 1, False)


@query("interpolate", ctes("obs", "pixels", "dates", "tsi", g=_RBF_GAPS, rbf=f"SELECT pixel_id, date, {_rbf_sums()} FROM g GROUP BY ALL", **HARMONIC, m=f"""
SELECT p.pixel_id, g.date, avg(o.value) AS value FROM pixels p CROSS JOIN dates g
LEFT JOIN obs o ON o.pixel_id = p.pixel_id AND o.date BETWEEN g.date - 10 AND g.date + 10 GROUP BY ALL""") + f"""
SELECT 'NONE' AS method, pixel_id, {d('date')} AS date, {r('value')} AS value FROM obs
UNION ALL SELECT 'LINEAR', pixel_id, {d('date')}, {r('value')} FROM tsi
UNION ALL SELECT 'MOVING', pixel_id, {d('date')}, {r('value')} FROM m
UNION ALL SELECT 'RBF', pixel_id, {d('date')}, {r(f'({_RBF_TOP})/nullif({_RBF_BOTTOM}, 0)')} FROM rbf
UNION ALL SELECT 'HARMONIC', pixel_id, {d('date')}, {r(_model('date'))} FROM coef, dates""")
def _interpolate(spark, sf):
    """All five methods through the one entry."""
    options = {"MOVING": {"moving_max": 10}, "RBF": {"sigmas": (8, 16, 32), "cutoff": 0.95},
               "HARMONIC": {"modes": 1, "trend": False, "fit_range": (FIRST, FIT_END)}}
    parts = [interpolate.interpolate(fx.obs(spark, sf), m, FIRST, LAST, STEP, **options.get(m, {})).select(
        F.lit(m).alias("method"), "pixel_id", "date", "value") for m in interpolate.METHODS]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("daily_series", ctes("obs_raw") + f"""
SELECT pixel_id, {d('date')} AS date, {r('avg(value)')} AS value, bit_or(qai) AS qai FROM obs_raw GROUP BY pixel_id, date""")
def _daily(spark, sf):
    return series.daily_series(fx.obs_raw(spark, sf))


@query("harmonic_fit_full")
def _harmonic_full(spark, sf):
    """Three modes with trend: eight unknowns, checked on made series in the tests."""
    fit = harmonic.harmonic_fit(fx.obs(spark, sf), FIRST, 3, True)
    return fit.select("pixel_id", "n_obs", *[F.col("coef")[i].alias(f"c{i}") for i in range(8)], "rmse")
