"""Queries over metrics, folds, trends, changes and seasonal metrics."""

from __future__ import annotations


from pixelfold.functions import statistics as st
from pixelfold.functions.student import critical_values
from pixelfold.operators import fold, polar, trend
from pixelfold.queries import fixtures as fx
from pixelfold.queries.base import d, query, r
from pixelfold.queries.fixtures import STEP, ctes

_STEP_SQL = {"Y": "year(date)", "Q": "quarter(date)", "M": "month(date)", "W": "weekofyear(date)", "D": "dayofyear(date)"}


def _stat(name):
    v = "value"
    simple = {
        "MIN": "min(value)", "MAX": "max(value)", "AVG": "avg(value)", "STD": "stddev_samp(value)",
        "RNG": "max(value) - min(value)", "IQR": "quantile_cont(value, 0.75) - quantile_cont(value, 0.25)",
        "SKW": "avg((value-mu)**3)/nullif(avg((value-mu)**2), 0)**1.5", "KRT": "avg((value-mu)**4)/nullif(avg((value-mu)**2), 0)**2 - 3",
    }
    if name == "NUM":
        return 'count(value) AS "NUM"'
    return r(simple.get(name) or f"quantile_cont({v}, {int(name[1:]) / 100})") + f' AS "{name}"'


def _stats(names, by):
    return (f"SELECT {by}, {', '.join(_stat(n) for n in names)} FROM "
            f"(SELECT *, avg(value) OVER (PARTITION BY {by}) AS mu FROM s) GROUP BY {by}")


@query("stm", ctes("tsi", s="SELECT pixel_id, value FROM tsi WHERE value IS NOT NULL") + _stats(st.STM_NAMES, "pixel_id"))
def _stm(spark, sf):
    return fold.stm(fx.tsi(spark, sf))


def _folded(period):
    return f"SELECT pixel_id, {_STEP_SQL[period]} AS step, value FROM obs"


NAMES = {"Y": "year", "Q": "quarter", "M": "month", "W": "week", "D": "doy"}


def _register_fold(period):
    @query(f"fold_{NAMES[period]}", ctes("obs", s=_folded(period)) + _stats(st.FOLD_NAMES, "pixel_id, step"))
    def run(spark, sf):
        return fold.fold(fx.obs(spark, sf), period, list(st.FOLD_NAMES))


for _p in NAMES:
    _register_fold(_p)


@query("fold_all", ctes("obs") + " UNION ALL ".join(
    f"SELECT pixel_id, '{p}' AS period, step, {r('avg(value)')} AS value FROM ({_folded(p)}) GROUP BY ALL" for p in NAMES))
def _fold_all(spark, sf):
    return fold.fold_all(fx.obs(spark, sf))


TESTS = {"Y": ("TWO", 0.95), "Q": ("LEFT", 0.9), "M": ("RIGHT", 0.95), "W": ("TWO", 0.9), "D": ("TWO", 0.99)}


def _trend_sql(source, tail, conf, max_dof):
    rows = ", ".join(f"({i}, {c}::double)" for i, c in enumerate(critical_values(conf, tail, max_dof), start=1))
    up = "WHEN slope > crit*se THEN 1" if tail != "LEFT" else ""
    down = "WHEN slope < -crit*se THEN -1" if tail != "RIGHT" else ""
    return dict(
        f=source,
        fit="SELECT pixel_id, regr_slope(value, step) AS m, regr_intercept(value, step) AS b, regr_r2(value, step) AS r2, regr_sxx(value, step) AS sxx FROM f GROUP BY 1",
        res="SELECT f.*, fit.m, fit.b, fit.r2, fit.sxx, abs(value - (b + m*step)) AS e FROM f JOIN fit USING (pixel_id)",
        agg="""SELECT pixel_id, avg(value) AS mean, any_value(b) AS "offset", any_value(m) AS slope, any_value(r2) AS r2, sqrt(sum(e*e)/count(*)) AS rmse,
  avg(e) AS mae, max(e) AS mx, count(*) AS n, coalesce(sqrt(sum(e*e)/nullif((count(*)-2)*any_value(sxx), 0)), 0) AS se FROM res GROUP BY 1""",
        t=f"SELECT agg.*, crit FROM agg LEFT JOIN (VALUES {rows}) c(dof, crit) ON dof = n - 2",
        out=f"""SELECT pixel_id, {r('mean')} AS mean, {r('"offset"')} AS "offset", {r('slope')} AS slope, {r('r2')} AS r2,
  CASE WHEN n < 3 OR slope IS NULL THEN 0 {up} {down} ELSE 0 END AS significance, {r('rmse')} AS rmse, {r('mae')} AS mae, {r('mx')} AS max_residual, n FROM t""")


def _mean_fold(period):
    return f"SELECT pixel_id, step, avg(value) AS value FROM ({_folded(period)}) GROUP BY ALL"


def _register_trend(period):
    tail, conf = TESTS[period]

    @query(f"trend_{NAMES[period]}", ctes("obs", **_trend_sql(_mean_fold(period), tail, conf, 366)) + "SELECT * FROM out")
    def run(spark, sf):
        return trend.trend(fold.fold(fx.obs(spark, sf), period), tail, conf)


for _p in NAMES:
    _register_trend(_p)


def _cat_sql(source, penalty):
    rebound = "greatest(0, coalesce(lead(value) OVER w - value, 0))" if penalty else "0"
    part = lambda name, test: (
        f"{r(f'avg(value) FILTER ({test})')} AS {name}_mean, {r(f'regr_slope(value, step) FILTER ({test})')} AS {name}_slope, "
        f"{r(f'regr_r2(value, step) FILTER ({test})')} AS {name}_r2, count(*) FILTER ({test}) AS {name}_n")
    return dict(
        f=source,
        g=f"SELECT *, lag(value) OVER w - value AS fall, (lag(value) OVER w - value) - {rebound} AS score FROM f WINDOW w AS (PARTITION BY pixel_id ORDER BY step)",
        k="""SELECT pixel_id, step AS turn, fall AS change FROM (
  SELECT *, row_number() OVER (PARTITION BY pixel_id ORDER BY score DESC, step) AS n FROM g WHERE score IS NOT NULL) WHERE n = 1""",
        out=f"""SELECT pixel_id, any_value(turn) AS change_step, {r('any_value(change)')} AS change, {part('before', 'step < turn')}, {part('after', 'step >= turn')}
  FROM f LEFT JOIN k USING (pixel_id) GROUP BY 1""")


def _register_cat(period):
    penalty = period in "YMD"

    @query(f"cat_{NAMES[period]}", ctes("obs", **_cat_sql(_mean_fold(period), penalty)) + "SELECT * FROM out")
    def run(spark, sf):
        return trend.cat(fold.fold(fx.obs(spark, sf), period), penalty)


for _p in NAMES:
    _register_cat(_p)


_ANGLE = "(2*pi()/365*(dayofyear(date) - 1))"


@query("polar_transform", ctes("tsi") + f"""
SELECT pixel_id, {d('date')} AS date, {r('value')} AS value, {r(f'value*cos({_ANGLE})')} AS pcx, {r(f'value*sin({_ANGLE})')} AS pcy FROM tsi""")
def _polar(spark, sf):
    return polar.polar_transform(fx.tsi(spark, sf))


def _opposite(x, y):
    turned = f"CASE WHEN atan2({y}, {x}) + pi() >= 2*pi() THEN 0 ELSE atan2({y}, {x}) + pi() END"
    return f"least(365, floor(({turned})/(2*pi()/365))::int + 1)"


def _doy_of(x, y):
    angle = f"CASE WHEN atan2({y}, {x}) < 0 THEN atan2({y}, {x}) + 2*pi() ELSE atan2({y}, {x}) END"
    return f"(floor(({angle})/(2*pi()/365) + 0.5)::int % 365 + 1)"


POLAR = {
    "v": f"SELECT *, value*cos({_ANGLE}) AS pcx, value*sin({_ANGLE}) AS pcy FROM tsi WHERE value IS NOT NULL",
    "ls": f"SELECT pixel_id, {_opposite('avg(pcx)', 'avg(pcy)')} AS long_start FROM v GROUP BY 1",
    "py": "SELECT v.*, long_start, CASE WHEN dayofyear(date) >= long_start THEN year(date) ELSE year(date) - 1 END AS pyear FROM v JOIN ls USING (pixel_id)",
    "st": "SELECT *, make_date(pyear, 1, 1) + (long_start - 1) AS st FROM py",
    "sh": """SELECT *, sum(value) OVER (PARTITION BY pixel_id, pyear ORDER BY date ROWS UNBOUNDED PRECEDING) / sum(value) OVER (PARTITION BY pixel_id, pyear) AS share,
  (value - lag(value) OVER w)/(date - lag(date) OVER w) AS rise FROM st WINDOW w AS (PARTITION BY pixel_id, pyear ORDER BY date)""",
}


@query("pheno_year", ctes("tsi", **POLAR) + f"""
SELECT pixel_id, pyear, any_value(long_start) AS mean_start, {d('any_value(st)')} AS "start", {d('any_value(st) + 365')} AS "end", count(*) AS dates
FROM st GROUP BY ALL""")
def _pheno(spark, sf):
    return polar.pheno_year(fx.tsi(spark, sf))


# Adaptive starts: each year's own mean vector moves its start.
_ADAPTIVE = {
    **{k: POLAR[k] for k in ("v", "ls", "py")},
    "own": f"SELECT pixel_id, pyear, any_value(long_start) AS ls, {_opposite('avg(pcx)', 'avg(pcy)')} AS od FROM py GROUP BY 1, 2",
    "beg": """SELECT pixel_id, pyear, make_date(pyear, 1, 1) + (ls - 1) + ((((od - ls + 182) % 365 + 365) % 365) - 182)::int AS b FROM own""",
    "nb": """SELECT b.*, coalesce(n.b, b.b + 365) AS nx, coalesce(p.b, b.b - 365) AS pv,
  coalesce(q.b, coalesce(n.b, b.b + 365) + 365) AS sc FROM beg b
  LEFT JOIN beg n ON n.pixel_id = b.pixel_id AND n.pyear = b.pyear + 1 LEFT JOIN beg p ON p.pixel_id = b.pixel_id AND p.pyear = b.pyear - 1
  LEFT JOIN beg q ON q.pixel_id = b.pixel_id AND q.pyear = b.pyear + 2""",
    "mv": """SELECT py.pixel_id, py.long_start, CASE WHEN date < b THEN py.pyear - 1 WHEN date >= nx THEN py.pyear + 1 ELSE py.pyear END AS pyear,
  CASE WHEN date < b THEN pv WHEN date >= nx THEN nx ELSE b END AS s, CASE WHEN date < b THEN b WHEN date >= nx THEN sc ELSE nx END AS e
  FROM py JOIN nb USING (pixel_id, pyear)""",
}


@query("pheno_year_adaptive", ctes("tsi", **_ADAPTIVE) + f"""
SELECT pixel_id, pyear, any_value(long_start) AS mean_start, {d('min(s)')} AS "start", {d('max(e)')} AS "end", count(*) AS dates FROM mv GROUP BY 1, 2""")
def _pheno_adaptive(spark, sf):
    return polar.pheno_year(fx.tsi(spark, sf), adaptive=True)


@query("polar_season", ctes("tsi", **POLAR) + f"""
SELECT pixel_id, pyear, {d('min(date) FILTER (share >= 0.2)')} AS start_of_season, {d('min(date) FILTER (share >= 0.5)')} AS mid_of_season,
  {d('min(date) FILTER (share >= 0.8)')} AS end_of_season, {r('sum(value)')} AS total FROM sh GROUP BY 1, 2""")
def _season(spark, sf):
    return polar.polar_season(fx.tsi(spark, sf))


def _in(a, b, what):
    return f"{what} FILTER (date BETWEEN {a} AND {b})"


_SPANS = {"e": ("dss", "dms"), "g": ("dss", "des"), "l": ("dms", "des")}
POLARMETRICS = {
    **POLAR,
    "se": """SELECT pixel_id, pyear, min(date) FILTER (share >= 0.2) AS dss, min(date) FILTER (share >= 0.5) AS dms, min(date) FILTER (share >= 0.8) AS des,
  max(value) AS peak FROM sh GROUP BY 1, 2""",
    "pk": "SELECT sh.*, se.dss, se.dms, se.des, se.peak, min(CASE WHEN value = peak THEN date END) OVER (PARTITION BY pixel_id, pyear) AS dps FROM sh JOIN se USING (pixel_id, pyear)",
    "ag": "SELECT pixel_id, pyear, any_value(st) AS dem, any_value(st) + 365 AS dlm, any_value(long_start) AS ls, "
          "any_value(dps) AS dps, any_value(dss) AS dss, any_value(dms) AS dms, any_value(des) AS des, "
          "arg_min(value, date) AS vem, arg_max(value, date) AS vlm, max(value) AS vps, max(value) FILTER (date = dss) AS vss, "
          "max(value) FILTER (date = dms) AS vms, max(value) FILTER (date = des) AS ves, "
          + ", ".join(f"{_in(*_SPANS[k], f'avg(pc{c})')} AS {k}{c}" for k in _SPANS for c in "xy") + ", "
          + f"{_in('dss', 'des', 'avg(value)')} AS vgm, {_in('dss', 'des', 'stddev_samp(value)')} AS vgv, sum(value)*{STEP} AS ibt, "
          + ", ".join(f"coalesce({_in(a, b, 'sum(value)')}, 0)*{STEP} AS {n}" for n, a, b in (("igs", "dss", "des"), ("irr", "dss", "dps"), ("ifr", "dps", "des")))
          + ", max(rise) AS rmr, -min(rise) AS rmf FROM pk GROUP BY 1, 2",
    "dd": "SELECT *, dem - make_date(pyear,1,1) + 1 AS dpy, (vem + vlm)/2 AS vbl, "
          + ", ".join(f"{_doy_of(k + 'x', k + 'y')} AS d{k}" for k in _SPANS) + " FROM ag",
    "pol": "SELECT *, " + ", ".join(f"d{k} + CASE WHEN d{k} < dpy THEN 365 ELSE 0 END AS t{k}" for k in _SPANS) + " FROM dd",
}


def _on(c):
    return f"({c} - make_date(pyear, 1, 1) + 1)"


METRIC_SQL = {
    "DEM": _on("dem"), "DLM": _on("dlm"), "DPS": _on("dps"), "DSS": _on("dss"), "DMS": _on("dms"), "DES": _on("des"),
    "DEV": "te", "DAV": "tg", "DLV": "tl", "LTS": "(dlm - dem)", "LGS": "(des - dss)", "LGV": "(tl - te)",
    "VEM": "vem", "VLM": "vlm", "VPS": "vps", "VSS": "vss", "VMS": "vms", "VES": "ves",
    "VEV": "sqrt(ex*ex + ey*ey)", "VAV": "sqrt(gx*gx + gy*gy)", "VLV": "sqrt(lx*lx + ly*ly)",
    "VBL": "vbl", "VGA": "vgm - vbl", "VSA": "vps - vbl", "VPA": "vps - (vss + ves)/2", "VGM": "vgm", "VGV": "vgv",
    "DPY": "dpy", "DPV": "(dpy - ls)", "IST": "ibt - vbl*(dlm - dem)", "IBL": "vbl*(dlm - dem)", "IBT": "ibt", "IGS": "igs", "IRR": "irr", "IFR": "ifr",
    "RAR": "(vps - vss)/nullif(dps - dss, 0)", "RAF": "(vps - ves)/nullif(des - dps, 0)", "RMR": "rmr", "RMF": "rmf",
}
_WHOLE = ("DEM", "DLM", "DPS", "DSS", "DMS", "DES", "DEV", "DAV", "DLV", "LTS", "LGS", "LGV", "DPY", "DPV")


@query("polarmetrics", ctes("tsi", **POLARMETRICS) + "SELECT pixel_id, pyear, " + ", ".join(
    f'{e if n in _WHOLE else r(e)} AS "{n}"' for n, e in METRIC_SQL.items()) + " FROM pol")
def _polarmetrics(spark, sf):
    return polar.polarmetrics(fx.tsi(spark, sf), step=STEP)


def green_amplitude(spark, sf):
    return polar.metric_series(polar.polarmetrics(fx.tsi(spark, sf), ("VGA",), step=STEP), "VGA")


_VGA = "SELECT pixel_id, pyear AS step, vgm - vbl AS value FROM pol WHERE vgm - vbl IS NOT NULL"


@query("trend_polar", ctes("tsi", **POLARMETRICS, **_trend_sql(_VGA, "TWO", 0.95, 60)) + "SELECT * FROM out")
def _trend_polar(spark, sf):
    return trend.trend(green_amplitude(spark, sf))


@query("cat_polar", ctes("tsi", **POLARMETRICS, **_cat_sql(_VGA, True)) + "SELECT * FROM out")
def _cat_polar(spark, sf):
    return trend.cat(green_amplitude(spark, sf), True)
