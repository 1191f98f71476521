import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from pixelfold.functions.student import critical_values, t_cdf
from pixelfold.operators import fold, interpolate, polar, trend


def folded(spark, values, pixel=1):
    return spark.createDataFrame([(pixel, i, float(v)) for i, v in enumerate(values, start=1)], "pixel_id int, step int, value double")


def test_known_critical_values():
    two = critical_values(0.95, "TWO", 366)
    assert two[0] == pytest.approx(12.7062, abs=1e-4) and two[9] == pytest.approx(2.2281, abs=1e-4) and two[29] == pytest.approx(2.0423, abs=1e-4)
    assert critical_values(0.95, "RIGHT", 5)[4] == pytest.approx(2.0150, abs=1e-4)
    assert two[365] == pytest.approx(1.9665, abs=1e-4) and t_cdf(0.0, 3)[0] == 0.5


def test_trend_by_hand(spark):
    row = trend.trend(folded(spark, [1, 2, 2, 4])).first()
    assert row.slope == pytest.approx(0.9) and row.offset == pytest.approx(0) and row["mean"] == pytest.approx(2.25)
    assert row.max_residual == pytest.approx(0.7) and row.mae == pytest.approx((0.1 + 0.2 + 0.7 + 0.4) / 4)
    assert row.rmse == pytest.approx(math.sqrt(0.7 / 4)) and row.significance == 0 and row.n == 4


@pytest.mark.parametrize("tail, up, down", [("TWO", 1, -1), ("RIGHT", 1, 0), ("LEFT", 0, -1)])
def test_significance_follows_the_tail(spark, tail, up, down):
    rising = [1, 2.1, 2.9, 4, 5.1, 6]
    assert trend.trend(folded(spark, rising), tail).first().significance == up
    assert trend.trend(folded(spark, [-v for v in rising]), tail).first().significance == down
    assert trend.trend(folded(spark, [1, 5]), tail).first().significance == 0


def test_change_of_a_step(spark):
    row = trend.cat(folded(spark, [1, 1, 1, 0.4, 0.4, 0.4])).first()
    assert row.change_step == 4 and row.change == pytest.approx(0.6) and (row.before_n, row.after_n) == (3, 3)
    assert row.before_slope == pytest.approx(0) and row.after_mean == pytest.approx(0.4)


def test_penalty_skips_a_blip(spark):
    blip = folded(spark, [1, 1, 0.2, 1, 0.6, 0.6])
    assert trend.cat(blip).first().change_step == 3
    row = trend.cat(blip, change_penalty=True).first()
    assert row.change_step == 5 and row.change == pytest.approx(0.4)


def test_folds_pool_years_and_skip_empty_steps(spark):
    rows = [(1, dt.date(2000, 12, 31), 1.0), (1, dt.date(2001, 12, 31), 3.0), (1, dt.date(2001, 3, 1), None)]
    df = spark.createDataFrame(rows, "pixel_id int, date date, value double")
    months = {r.step: r.value for r in fold.fold(df, "M").collect()}
    assert months == {12: 2.0}
    assert {r.step for r in fold.fold(df, "D").collect()} == {365, 366}
    assert {r.step: r.value for r in fold.fold(df, "Y").collect()} == {2000: 1.0, 2001: 3.0}
    both = {(r.period, r.step): r.value for r in fold.fold_all(df).collect()}
    assert both == {("Y", 2000): 1.0, ("Y", 2001): 3.0, ("Q", 4): 2.0, ("M", 12): 2.0, ("W", 52): 1.0, ("W", 1): 3.0, ("D", 366): 1.0, ("D", 365): 3.0}


def test_metrics_come_in_request_order(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (1, 2, 3, 4)], "pixel_id int, value double")
    out = fold.stm(df, ["Q50", "NUM", "RNG", "IQR"])
    assert out.columns == ["pixel_id", "Q50", "NUM", "RNG", "IQR"] and tuple(out.first())[1:] == (2.5, 4, 3.0, 1.5)
    with pytest.raises(ValueError):
        fold.stm(df, ["MEDIAN"])
    assert fold.stm(df.where("value = 1"), ["STD"]).first().STD is None


def test_one_percentile_call_for_all_quantiles(spark):
    df = spark.createDataFrame([(1, 1.0)], "pixel_id int, value double")
    plan = fold.stm(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(" percentile(") + plan.count("[percentile(") + plan.count("partial_percentile(") <= 2 and plan.count("Exchange") == 1


def test_season_of_a_wave(season):
    one = polar.polar_season(season).orderBy("pyear").collect()
    assert all(r.start_of_season <= r.mid_of_season <= r.end_of_season for r in one)
    years = {r.pyear: r for r in polar.pheno_year(season).collect()}
    # the wave peaks at day 91, so the year starts half a year later
    assert all(abs(r.mean_start - 274) <= 2 for r in years.values())
    assert (years[2001].end - years[2001].start).days == 365


def test_metrics_are_consistent(season):
    for adaptive in (False, True):
        rows = [r for r in polar.polarmetrics(season, adaptive=adaptive).collect() if r.pyear in (2001, 2002)]
        assert len(rows) == 2
        for r in rows:
            assert r.DEM <= r.DSS <= r.DMS <= r.DES <= r.DLM and r.DSS <= r.DPS <= r.DES
            assert r.VPS == pytest.approx(0.7, abs=0.01) and r.VBL < r.VGM < r.VPS
            assert r.IST == pytest.approx(r.IBT - r.IBL) and r.LGS == r.DES - r.DSS and r.RMR > 0 and r.RMF > 0
            assert r.IRR <= r.IGS <= r.IBT and r.LTS == r.DLM - r.DEM
    assert polar.polarmetrics(season, ["VPS", "DEM"]).columns == ["pixel_id", "pyear", "VPS", "DEM"]
    assert len(polar.METRICS) == 39
    with pytest.raises(ValueError):
        polar.polarmetrics(season, ["XXX"])


def test_thresholds_must_be_ordered(season):
    with pytest.raises(ValueError):
        polar.polar_season(season, 0.5, 0.2, 0.8)


def test_trend_of_a_metric(season):
    one = polar.metric_series(polar.polarmetrics(season), "VPS")
    assert trend.trend(one).first().n == one.count() and trend.cat(one).count() == 1


def test_series_chain_shares_one_partitioning(spark, season):
    from pixelfold.operators.interpolate import interp_linear
    chain = trend.trend(fold.fold(interp_linear(season, "2001-01-01", "2003-12-31"), "M"))
    assert chain._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert chain.select(F.col("n")).first().n == 12


def test_long_series_have_their_own_critical_value(spark):
    from pixelfold.functions.student import critical_values
    from pixelfold.operators.trend import significance
    for n in (300, 368, 369, 1000, 20000):
        for tail, sign in (("TWO", 1), ("RIGHT", 1), ("LEFT", -1)):
            limit = float(critical_values(0.95, tail, n)[n - 3])
            slopes = spark.createDataFrame([(sign * abs(limit) * s, n) for s in (1 - 1e-8, 1 + 1e-8)], "slope double, n long")
            got = slopes.select(significance(F.col("slope"), F.lit(1.0), F.col("n"), tail, 0.95)).collect()
            assert sorted(abs(r[0]) for r in got) == [0, 1], (n, tail)


@pytest.mark.parametrize("method", ["LINEAR", "MOVING", "RBF"])
def test_pixel_without_values_keeps_its_dates(spark, method):
    day = dt.date(2001, 1, 1)
    rows = [(1, day, None), (1, day + dt.timedelta(days=9), None), (2, day, 1.0), (2, day + dt.timedelta(days=3), None), (2, day + dt.timedelta(days=8), 5.0)]
    frame = spark.createDataFrame(rows, "pixel_id long, date date, value double")
    out = interpolate.interpolate(frame, method, "2001-01-01", "2001-01-09", 4)
    dates = interpolate.interp_grid(frame, "2001-01-01", "2001-01-09", 4).count()
    assert out.count() == dates == 6
    assert out.where("pixel_id = 1 and value is not null").count() == 0
    fitted = interpolate.interpolate(frame, "HARMONIC", "2001-01-01", "2001-01-09", 4, modes=1, trend=False)
    assert fitted.count() == 6 and fitted.where("value is not null").count() == 0
    known = {r.date.day: r.value for r in interpolate.interpolate(frame.where("value is not null"), method, "2001-01-01", "2001-01-09", 4).collect()}
    assert {r.date.day: r.value for r in out.where("pixel_id = 2").collect()} == known


def test_all_folds_happen_where_a_series_lies(spark):
    """Rows meet once, by series, and are not multiplied before that; rows without a date stay in their period."""
    rows = [(p, dt.date(2000 + y, m, 3), float(p + y * m)) for p in (1, 2) for y in range(3) for m in range(1, 13)] + [(3, None, 5.0)]
    df = spark.createDataFrame(rows, "pixel_id long, date date, value double")
    all_of_them = fold.fold_all(df, stat="Q50")
    got = {(r.pixel_id, r.period, r.step): r.value for r in all_of_them.collect()}
    want = {(r.pixel_id, p, r.step): r.value for p in fold.PERIODS for r in fold.fold(df, p, "Q50").collect()}
    assert got == want and (3, "Y", None) in got
    plan = fold.fold_all(df)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("Exchange hashpartitioning") == 1
