import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelfold.functions import indices, qai
from pixelfold.operators import harmonic, interpolate, quality, series
from pixelfold.sources.catalog import short_band_name

DAY0 = dt.date(2001, 1, 1)


def frame(spark, pairs, pixel=1):
    rows = [(pixel, DAY0 + dt.timedelta(days=d), float(v)) for d, v in pairs]
    return spark.createDataFrame(rows, "pixel_id long, date date, value double")


def by_day(df, col="value"):
    return {(r.date - DAY0).days: r[col] for r in df.collect()}


def test_every_flag_state(spark):
    for name, (bit, mask, state) in qai.LAYOUT.items():
        df = quality.decode_qai(spark.createDataFrame([(state << bit,)], "qai int"))
        row = df.first().asDict()
        same_field = {n for n, (b, _, s) in qai.LAYOUT.items() if b == bit and s == state}
        assert {n for n in qai.LAYOUT if row[n]} == same_field == {name}


def test_screen_keeps_clear_and_unknown(spark):
    df = spark.createDataFrame([(0,), (2,), (32,), (None,)], "qai int")
    assert [r.qai for r in quality.screen_qai(df).collect()] == [0, 32, None]
    assert quality.screen_qai(df, ["WATER"]).count() == 3
    with pytest.raises(ValueError):
        quality.screen_qai(df, ["FOG"])


def test_noise_filter_removes_exactly_the_spike(season):
    spiked = season.withColumn("value", F.when(F.col("date") == "2002-01-18", F.col("value") + 0.5).otherwise(F.col("value")))
    assert spiked.where("date = '2002-01-18'").count() == season.where("date = '2002-01-18'").count()
    day = season.orderBy("date").collect()[24].date
    spiked = season.withColumn("value", F.when(F.col("date") == F.lit(day), F.col("value") + 0.5).otherwise(F.col("value")))
    kept = quality.noise_filter(spiked, 5.0)
    assert [r.date for r in spiked.join(kept, "date", "left_anti").collect()] == [day]
    assert quality.noise_filter(spiked, 0) is spiked


def test_noise_filter_ends_by_itself(season, spark):
    rng = random.Random(3)
    noisy = frame(spark, [(i, rng.gauss(0, 1) + (40 if i in (20, 50, 70, 90, 91) else 0)) for i in range(0, 120)])
    rows = [(i, v) for i, v in sorted(by_day(noisy).items())]
    while True:  # the same rule in plain Python
        res = {}
        for (a, va), (b, vb), (c, vc) in zip(rows, rows[1:], rows[2:]):
            res[b] = abs(vb - (va + (vc - va) * (b - a) / (c - a)))
        noise = math.sqrt(sum(r * r for r in res.values()) / len(res))
        worst = max(res.values())
        if worst <= 3 * noise:
            break
        drop = min(d for d, r in res.items() if r == worst)
        rows = [p for p in rows if p[0] != drop]
    assert sorted(by_day(quality.noise_filter(noisy, 3.0)).items()) == rows and len(rows) < 120


def test_noise_filter_keeps_no_outlier(spark):
    rng = random.Random(5)
    spikes = set(range(20, 1480, 24))
    noisy = frame(spark, [(i, rng.gauss(0, 0.1) + (200 + i if i in spikes else 0)) for i in range(1500)])
    left = by_day(quality.noise_filter(noisy, 3.0))
    assert len(spikes) > 60 and not spikes & set(left)
    gaps = noisy.withColumn("value", F.when(F.dayofmonth("date") != 3, F.col("value")))
    assert quality.noise_filter(gaps, 3.0).where("value is null").count() == gaps.where("value is null").count()


def test_noise_restore_brings_back_what_fits(spark):
    df = frame(spark, [(0, 0), (10, 1.1), (20, 2), (30, 2.95), (40, 4), (50, 9)]).withColumn(
        "kept", ~F.col("date").isin(DAY0 + dt.timedelta(days=30), DAY0 + dt.timedelta(days=50)))
    back = quality.noise_restore(df, 1.0)
    assert sorted(by_day(back)) == [0, 10, 20, 30, 40]
    assert by_day(back, "restored")[30] and not by_day(back, "restored")[20]
    assert sorted(by_day(quality.noise_restore(df, 0))) == [0, 10, 20, 40]


def test_linear_reproduces_observations_and_stops_at_the_ends(spark):
    obs = frame(spark, [(10, 1.0), (30, 3.0), (35, 8.0)])
    got = by_day(interpolate.interp_linear(obs, DAY0, DAY0 + dt.timedelta(days=50), 5))
    assert got == {0: None, 5: None, 10: 1.0, 15: 1.5, 20: 2.0, 25: 2.5, 30: 3.0, 35: 8.0, 40: None, 45: None, 50: None}


def test_linear_uses_observations_outside_the_grid(spark):
    obs = frame(spark, [(-10, 0.0), (10, 2.0), (70, 8.0)])
    got = by_day(interpolate.interp_linear(obs, DAY0, DAY0 + dt.timedelta(days=40), 20))
    assert got == {0: 1.0, 20: 3.0, 40: 5.0}


def test_linear_plan_has_one_shuffle(spark):
    obs = frame(spark, [(10, 1.0)])
    plan = interpolate.interp_linear(obs, "2001-01-01", "2001-12-31")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_moving_and_rbf_against_brute_force(spark):
    rng = random.Random(4)
    pairs = sorted({rng.randrange(-20, 220): rng.random() for _ in range(30)}.items())
    obs, last = frame(spark, pairs), DAY0 + dt.timedelta(days=200)
    moving = by_day(interpolate.interp_moving(obs, DAY0, last, 7, 6))
    rbf = by_day(interpolate.interp_rbf(obs, DAY0, last, 7, (4, 9), 0.9))
    assert sorted(moving) == sorted(rbf) == list(range(0, 201, 7))
    for t in moving:
        near = [v for d, v in pairs if abs(d - t) <= 6]
        assert moving[t] == (pytest.approx(np.mean(near)) if near else None)
        top = bottom = 0
        for s in (4, 9):
            half = interpolate.rbf_half_width(s, 0.9)
            w = [(math.exp(-(d - t) ** 2 / (2 * s * s)), v) for d, v in pairs if abs(d - t) <= half]
            if w:
                density = len(w) / (2 * half + 1)
                top += density * sum(a * v for a, v in w) / sum(a for a, _ in w)
                bottom += density
        assert rbf[t] == (pytest.approx(top / bottom) if bottom else None)
    sparse = by_day(interpolate.interp_moving(obs, DAY0, last, 7, 6, complete=False))
    assert sparse == {k: v for k, v in moving.items() if v is not None}


@pytest.mark.parametrize("modes, trend", [(1, False), (2, True), (3, True)])
def test_harmonic_recovers_known_coefficients(spark, modes, trend):
    rng = np.random.default_rng(modes)
    k = 1 + trend + 2 * modes
    true = rng.normal(size=k)
    rows = []
    for i in range(0, 1100, 11):
        t = i / 365.25
        x = [1.0] + ([t] if trend else [])
        for m in range(1, modes + 1):
            x += [math.cos(2 * math.pi * m * t), math.sin(2 * math.pi * m * t)]
        rows.append((i, float(np.dot(true, x))))
    obs = frame(spark, rows)
    row = harmonic.harmonic_fit(obs, DAY0, modes, trend).first()
    assert row.coef == pytest.approx(list(true), abs=1e-8) and row.rmse == pytest.approx(0, abs=1e-6) and row.n_obs == 100
    coef = harmonic.harmonic_fit(obs, DAY0, modes, trend, ("2001-01-01", "2002-12-31"))
    later = harmonic.nrt_residual(obs, coef, "2002-12-31", DAY0, modes, trend).collect()
    assert later and all(abs(r.residual) < 1e-6 and r.date.year == 2003 for r in later)


def test_harmonic_needs_enough_observations(spark):
    row = harmonic.harmonic_fit(frame(spark, [(0, 1), (5, 2), (9, 3)]), DAY0, 3, True).first()
    assert row.coef is None and row.rmse is None and row.n_obs == 3
    mixed = frame(spark, [(0, 1), (5, 2)]).unionByName(frame(spark, [(i, i) for i in range(0, 400, 10)], 2))
    fits = {r.pixel_id: r.coef for r in harmonic.harmonic_fit(mixed, DAY0, 1, True).collect()}
    assert fits[1] is None and len(fits[2]) == 4


def test_index_formulas(spark):
    values = {"BLUE": 0.1, "GREEN": 0.2, "RED": 0.15, "RE1": 0.25, "RE2": 0.3, "RE3": 0.35, "BNIR": 0.5, "NIR": 0.55, "SWIR1": 0.3, "SWIR2": 0.2}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} double" for k in values))
    row = series.spectral_index(df, indices.INDEX_NAMES, keep=[]).first().asDict()
    assert len(row) == 31
    assert row["NDVI"] == pytest.approx(0.35 / 0.65) and row["kNDVI"] == pytest.approx(math.tanh((0.35 / 0.65) ** 2))
    assert row["EVI"] == pytest.approx(2.5 * 0.35 / (0.5 + 0.9 - 0.75 + 1)) and row["ARVI"] == pytest.approx(0.3 / 0.7)
    q = 0.5 / 0.25
    assert row["MSRre"] == pytest.approx((q - 1) / math.sqrt(q + 1)) and row["TC-DI"] == pytest.approx(row["TC-BRIGHT"] - row["TC-GREEN"] - row["TC-WET"])
    numbered = df.select(*[F.col(r).alias(b) for r, b in indices.ROLES.items()])
    assert series.spectral_index(numbered, ["NDVI"], keep=[]).first()[0] == row["NDVI"]
    zero = spark.createDataFrame([(0.0, 0.0)], "RED double, BNIR double")
    assert series.spectral_index(zero, ["NDVI"], keep=[]).first()[0] is None
    with pytest.raises(ValueError):
        series.spectral_index(df, ["NOPE"])


def test_unmixing_recovers_fractions(spark):
    ends = {"soil": [0.3, 0.35, 0.4], "leaf": [0.05, 0.5, 0.25]}
    mix = [0.25 * s + 0.75 * v for s, v in zip(ends["soil"], ends["leaf"])]
    row = series.sma(spark.createDataFrame([tuple(mix)], "a double, b double, c double"), ends, ["a", "b", "c"]).first()
    assert row.frac_soil == pytest.approx(0.25) and row.frac_leaf == pytest.approx(0.75) and row.sma_rmse == pytest.approx(0, abs=1e-9)


def test_standardize(spark):
    df = frame(spark, [(0, 1), (1, 2), (2, 6)])
    assert by_day(series.standardize(df, "CENTER")) == pytest.approx({0: -2, 1: -1, 2: 3})
    assert by_day(series.standardize(df, "NORMALIZE"))[2] == pytest.approx(3 / math.sqrt(7))
    flat = series.standardize(frame(spark, [(0, 1), (1, 1)]), "NORMALIZE").first()
    assert flat.value is None and series.standardize(df, "NONE") is df


def test_stack_and_layers(spark):
    df = frame(spark, [(5, 2), (1, 1)])
    stack = series.time_series_stack(df).first().stack
    assert [x.value for x in stack] == [1.0, 2.0]
    wide = series.pivot_stack(df.withColumn("layer", F.date_format("date", "yyyyMMdd")), ["20010106", "20010102"])
    assert wide.columns == ["pixel_id", "20010106", "20010102"]
    assert series.explode_stack(wide, ["20010106", "20010102"]).count() == 2


def test_band_names(spark):
    df = spark.createDataFrame([("B01",), ("B8A",), ("B10",)], "n string").select(short_band_name(F.col("n")).alias("n"))
    assert [r.n for r in df.collect()] == ["B1", "B8A", "B10"]
    assert series.band_values(spark.createDataFrame([(1, 2.0, 3.0)], "pixel_id int, B04 double, B08 double"), "B4").first().value == 2.0


@pytest.mark.parametrize("modes, trend, level", [(1, False, 0.0), (3, True, 0.0), (3, True, 1e7)])
def test_harmonic_error_of_a_good_fit_far_from_zero(spark, modes, trend, level):
    noise = 1e-3
    rows = [(d, level + math.sin(2 * math.pi * d / 365.25) + (noise if d % 2 else -noise)) for d in range(0, 1400, 3)]
    fit = harmonic.harmonic_fit(frame(spark, rows), DAY0, modes, trend).first()
    assert len(fit.coef) == 1 + trend + 2 * modes
    assert fit.rmse == pytest.approx(noise, rel=0.02) and fit.coef[0] == pytest.approx(level, abs=1e-3)
