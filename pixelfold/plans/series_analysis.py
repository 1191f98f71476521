"""Time-series analysis of a cube: one plan per requested product."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelfold.functions import qai as q
from pixelfold.functions.indices import RAW_BANDS, ROLES, index_column, role_columns
from pixelfold.operators import fold, harmonic, interpolate, polar, quality, resample, select, series, trend
from pixelfold.operators.gridding import check_sizes, tile_name
from pixelfold.plans.parameters import PERIOD_OUTPUTS, SeriesParameters, read_parameters
from pixelfold.session import scratch_path
from pixelfold.sinks.writers import cube_name, write_cube

TILE_SIZE = 30000


def band_columns(columns) -> list[str]:
    known = {*RAW_BANDS, *ROLES, *(b[:1] + b[1:].zfill(2) for b in RAW_BANDS)}
    return [c for c in columns if c in known]


def select_rows(cube: DataFrame, p: SeriesParameters, sensor_bands=None) -> DataFrame:
    """The rows of all products in the requested extent and of the requested sensors.

    Cheap predicates come first, so they reach the scan of a cube written by tile.
    """
    check_sizes(TILE_SIZE, p.chunk_size, p.resolution)
    df = select.filter_tile_range(cube, p.x_tile_range, p.y_tile_range)
    if p.file_tile is not None:
        df = df.where(tile_name().isin(list(p.file_tile)))
    df = select.filter_date_range(df, *p.date_range)
    if tuple(p.doy_range) != (1, 366):
        df = select.filter_doy_range(df, *p.doy_range)
    df = df.where(F.col("sensor").isin(list(p.sensors)))
    if sensor_bands:
        shared = reduce(lambda a, b: a & b, [set(sensor_bands[s]) for s in p.sensors])
        df = df.drop(*[b for b in band_columns(df.columns) if b not in shared])
    return df


def select_observations(cube: DataFrame, p: SeriesParameters, sensor_bands=None, materials=None, input_resolution=None) -> DataFrame:
    """The selected rows of the main product, with quality and values of choice."""
    df = select_rows(cube, p, sensor_bands)
    bands = band_columns(df.columns)
    original = df.where(F.col("product") != "IMP") if p.product_type_main != "IMP" else df
    main = select.join_quality(original, p.product_type_main, p.product_type_quality)
    if p.use_l2_improphe:
        main = select.prefer_improphe(main, df.where(F.col("product") == "IMP"), True, value=bands).drop("enhanced")
    if _is_coarser(p, input_resolution):
        main = degrade(main, bands, p.resolution // input_resolution, p.reduce_psf)
    if p.spectral_adjust:
        if not materials:
            raise ValueError("spectral_adjust needs materials")
        main = series.spectral_adjust(main, materials, bands).drop("material")
    return main.withColumn("sensor", F.lit(p.target_sensor))


def _is_coarser(p: SeriesParameters, input_resolution) -> bool:
    return bool(input_resolution) and input_resolution < p.resolution


def degrade(df: DataFrame, bands, factor: int, psf: bool) -> DataFrame:
    """Coarser pixels; flags come from the nearest pixel.  ``pixel_id`` becomes that of the nearest one."""
    keys = ["tile_x", "tile_y", "date", "sensor"]
    near = resample.nearest_rows(df, factor, ["qai", "pixel_id", *bands], keys)
    if psf:
        smooth = resample.reduce_psf(df, factor, True, list(bands), keys)
        near = near.drop(*bands).join(smooth, [*keys, "tx", "ty"], "left")
    return near.withColumnsRenamed({"tx": "x", "ty": "y"})


def _value_column(rows: DataFrame, name: str, endmember=None, endmembers=None) -> Column:
    """One index, band or endmember as an expression of the columns of ``rows``."""
    if name == "SMA":
        return series.fraction(endmember, endmembers, band_columns(rows.columns))
    if name in RAW_BANDS:
        roles = {b: r for r, b in ROLES.items()}
        return F.col(series.band_column(rows.columns, name if name in rows.columns else roles.get(name, name)))
    return index_column(name, role_columns(rows.columns))


def _valued(rows: DataFrame, name: str, keep, endmember=None, endmembers=None) -> DataFrame:
    """The columns in ``keep`` and the ``value`` of one index, band or endmember."""
    return rows.select(*keep, _value_column(rows, name, endmember, endmembers).alias("value"))


def _days_of_observations(observations: DataFrame, p: SeriesParameters) -> DataFrame:
    """(pixel_id, date, value, kept) from rows that carry their quality word."""
    clear = ~q.is_screened(p.screen_qai)
    return observations.where(F.col("value").isNotNull()).groupBy("pixel_id", F.col("date").cast("date").alias("date")).agg(
        F.coalesce(F.avg(F.when(clear, F.col("value"))), F.avg("value")).alias("value"), F.max(clear).alias("kept"))


def _days_of_rows(rows: DataFrame, p: SeriesParameters) -> DataFrame:
    """(pixel_id, date, value, kept) from main and quality rows together, by one combined aggregate.

    Sums and flags are kept by sensor until the flags of an acquisition are
    complete; the sensors are those of the parameters, so this is a few columns
    and no row meets another in a join.
    """
    main = F.col("product") == p.product_type_main
    flagged = F.lit(False) if p.product_type_quality is None else F.col("product") == p.product_type_quality
    aggs, clear_sum, clear_n, every_sum, every_n = [], F.lit(0.0), F.lit(0), F.lit(0.0), F.lit(0)
    for i, sensor in enumerate(p.sensors):
        own = F.col("sensor") == sensor
        aggs += [F.sum(F.when(own & main, F.col("value").cast("double"))).alias(f"_s{i}"),
                 F.count(F.when(own & main, F.col("value"))).alias(f"_n{i}"),
                 F.bit_or(F.when(own & flagged, F.col("qai"))).alias(f"_q{i}")]
        clear, total = ~q.is_screened(p.screen_qai, f"_q{i}"), F.coalesce(f"_s{i}", F.lit(0.0))
        clear_sum, clear_n = clear_sum + F.when(clear, total).otherwise(0.0), clear_n + F.when(clear, F.col(f"_n{i}")).otherwise(0)
        every_sum, every_n = every_sum + total, every_n + F.col(f"_n{i}")
    # enhanced rows count only where they are the main product
    wanted = [x for x in {p.product_type_main, p.product_type_quality} if x is not None and (x != "IMP" or p.product_type_main == "IMP")]
    days = rows.where(F.col("product").isin(sorted(wanted))).groupBy("pixel_id", "date").agg(*aggs).where(every_n > 0)
    kept = clear_n > 0
    return days.select("pixel_id", "date", F.when(kept, clear_sum / F.nullif(clear_n, F.lit(0))).otherwise(every_sum / every_n).alias("value"),
                       kept.alias("kept"))


def _screened(days: DataFrame, p: SeriesParameters) -> DataFrame:
    """The kept days, without outliers and with screened days that fit; a day is kept when any of its observations is clear."""
    if not (p.above_noise or p.below_noise):
        return days.where("kept").drop("kept")
    calm = quality.noise_filter(days.where("kept"), p.above_noise)
    if not p.below_noise:
        return calm.drop("kept")
    back = quality.noise_restore(calm.unionByName(days.where("not kept")), p.below_noise)
    return back.select("pixel_id", "date", "value")


def index_series(observations: DataFrame, name: str, p: SeriesParameters, endmember=None, endmembers=None) -> DataFrame:
    """The quality-screened daily series ``pixel_id, date, value`` of one index, band or endmember.

    ``observations`` come from ``select_observations``.
    """
    valued = _valued(observations, name, ("pixel_id", "date", "qai"), endmember, endmembers)
    return _screened(_days_of_observations(valued, p), p)


def index_series_of_rows(rows: DataFrame, name: str, p: SeriesParameters, endmember=None, endmembers=None) -> DataFrame:
    """``index_series`` straight from ``select_rows``, with one scan and one shuffle; dates must be days."""
    valued = _valued(rows, name, ("pixel_id", "date", "sensor", "product", "qai"), endmember, endmembers)
    return _screened(_days_of_rows(valued, p), p)


def interpolated(tss: DataFrame, p: SeriesParameters, coef: DataFrame | None = None) -> DataFrame:
    first, last = p.date_range
    if p.interpolate == "MOVING":
        return interpolate.interp_moving(tss, first, last, p.int_day, p.moving_max)
    if p.interpolate == "RBF":
        return interpolate.interp_rbf(tss, first, last, p.int_day, tuple(p.rbf_sigma), p.rbf_cutoff)
    if p.interpolate == "HARMONIC":
        return harmonic.interp_harmonic(coef, first, last, p.int_day, first, p.harmonic_modes, p.harmonic_trend)
    return interpolate.interpolate(tss, p.interpolate, first, last, p.int_day)


def _season_products(out: dict[str, DataFrame], suffix: str, yearly: DataFrame, p: SeriesParameters, keys) -> None:
    one = series.standardize(yearly, p.standardize_pol, keys)
    if p.output_pol:
        out[f"POL{suffix}"] = one
    if p.output_tro:
        out[f"TRO{suffix}"] = trend.trend(one, p.trend_tail, p.trend_conf, keys)
    if p.output_cao:
        out[f"CAO{suffix}"] = trend.cat(one, p.change_penalty, keys)


def _products(tss: DataFrame, p: SeriesParameters, shared, together=False) -> dict[str, DataFrame]:
    out: dict[str, DataFrame] = {}
    if p.output_tss:
        out["TSS"] = series.standardize(tss, p.standardize_tss)
    coef = None
    if p.interpolate == "HARMONIC":
        coef = harmonic.harmonic_fit(tss, p.date_range[0], p.harmonic_modes, p.harmonic_trend, p.harmonic_fit_range)
        if p.output_nrt:
            out["NRT"] = harmonic.nrt_residual(tss, coef, p.harmonic_fit_range[1], p.date_range[0], p.harmonic_modes, p.harmonic_trend)
    tsi = shared(series.standardize(interpolated(tss, p, coef), p.standardize_tsi))
    if p.output_tsi:
        out["TSI"] = tsi
    if p.output_stm:
        out["STM"] = fold.stm(tsi.where(F.col("value").isNotNull()), p.stm)
    for period, letter in PERIOD_OUTPUTS.items():
        wanted = {k: getattr(p, f"output_{k}{letter}") for k in ("fb", "tr", "ca")}
        if any(wanted.values()):
            folded = series.standardize(fold.fold(tsi, period, p.fold_type), p.standardize_fold)
            if wanted["fb"]:
                out[f"FB{period}"] = folded
            if wanted["tr"]:
                out[f"TR{period}"] = trend.trend(folded, p.trend_tail, p.trend_conf)
            if wanted["ca"]:
                out[f"CA{period}"] = trend.cat(folded, p.change_penalty)
    if p.output_pct:
        out["PCT"] = polar.polar_transform(tsi)
    if p.output_pol or p.output_tro or p.output_cao:
        metrics = polar.polarmetrics(
            tsi, tuple(p.pol), p.pol_start_threshold, p.pol_mid_threshold, p.pol_end_threshold, p.pol_adaptive, p.int_day)
        if together:
            _season_products(out, "", polar.metrics_series(metrics, p.pol), p, ("pixel_id", "metric"))
        else:
            for name in p.pol:
                _season_products(out, f"-{name}", polar.metric_series(metrics, name), p, ("pixel_id",))
    return out


def _consumers(p: SeriesParameters) -> int:
    flags = [getattr(p, f"output_{k}{x}") for k in ("fb", "tr", "ca") for x in PERIOD_OUTPUTS.values()]
    return sum(map(bool, [*flags, p.output_tsi, p.output_stm, p.output_pct, p.output_pol, p.output_tro, p.output_cao]))


def _sharing(cube: DataFrame, p: SeriesParameters, share_series: bool):
    def shared(tsi):
        if not share_series or _consumers(p) < 2:
            return tsi
        path = scratch_path(cube.sparkSession, "series")
        tsi.write.parquet(path)
        return cube.sparkSession.read.schema(tsi.schema).parquet(path)
    return shared


def _sums_rows(cube: DataFrame, p: SeriesParameters, input_resolution) -> bool:
    """Whether nothing but the quality word is joined, so that rows need not meet before they are summed up."""
    return not (p.use_l2_improphe or p.spectral_adjust or _is_coarser(p, input_resolution)) and dict(cube.dtypes)["date"] == "date"


def analyse_series(cube: DataFrame, sensor_bands=None, materials=None, endmembers=None, input_resolution=None,
                   share_series=False, **parameters) -> dict[str, DataFrame]:
    """Requested products of every index, keyed ``<index>_<product>``; nothing runs until one is used.

    ``cube`` is long: ``pixel_id, tile_x, tile_y, x, y, date, sensor, product,
    qai`` and band columns.  With ``share_series`` and several products, the
    interpolated series is written once to the shared folder and read by all.
    """
    p = read_parameters(SeriesParameters, parameters)
    if _sums_rows(cube, p, input_resolution):
        observations, daily = select_rows(cube, p, sensor_bands), index_series_of_rows
    else:
        observations, daily = select_observations(cube, p, sensor_bands, materials, input_resolution), index_series
    products = {}
    for name in p.index:
        if name == "SMA":
            if not endmembers:
                raise ValueError("SMA needs endmembers")
            named = {f"SMA-{e}": daily(observations, name, p, e, endmembers) for e in endmembers}
        else:
            named = {name: daily(observations, name, p)}
        for label, tss in named.items():
            for product, df in _products(tss, p, _sharing(cube, p, share_series)).items():
                products[f"{label}_{product}"] = df
    return products


def analyse_together(cube: DataFrame, sensor_bands=None, materials=None, endmembers=None, input_resolution=None,
                     share_series=False, **parameters) -> dict[str, DataFrame]:
    """The products of ``analyse_series`` as one long table each, for all indices and metrics at once.

    Products are keyed by their name alone and have the columns ``pixel_id,
    index``, for seasonal metrics also ``metric``.  The cube is scanned once for
    a product, whatever the number of indices and metrics; pixel and index
    together name a series, so a shuffle spreads more evenly than by pixel.
    """
    p = read_parameters(SeriesParameters, parameters)
    if "SMA" in p.index and not endmembers:
        raise ValueError("SMA needs endmembers")
    once = _sums_rows(cube, p, input_resolution)
    rows = select_rows(cube, p, sensor_bands) if once else select_observations(cube, p, sensor_bands, materials, input_resolution)
    keep = ("pixel_id", "date", "sensor", "product", "qai") if once else ("pixel_id", "date", "qai")
    values = []
    wide = rows
    for name in p.index:
        for e in endmembers if name == "SMA" else (None,):
            label = name if e is None else f"SMA-{e}"
            # every index is computed from the bands, then they become rows
            values.append(F.struct(F.lit(label).alias("index"), F.col(f"_v_{label}").cast("double").alias("value")))
            wide = wide.withColumn(f"_v_{label}", _value_column(rows, name, e, endmembers))
    long = wide.select(*keep, F.explode(F.array(*values)).alias("_iv"))
    # rows of the quality product have no values but the flags of every index
    long = long.select(F.struct("pixel_id", "_iv.index").alias("pixel_id"), *keep[1:], F.col("_iv.value").alias("value"))
    tss = _screened((_days_of_rows if once else _days_of_observations)(long, p), p)
    out = _products(tss, p, _sharing(cube, p, share_series), together=True)
    return {name: df.select("pixel_id.*", *[c for c in df.columns if c != "pixel_id"]) for name, df in out.items()}


def write_products(products: dict[str, DataFrame], pixels: DataFrame, base: str, p: SeriesParameters) -> dict[str, str]:
    """Write every product by tile below ``base/<name>``; returns their paths.

    ``pixels`` gives the tile of every ``pixel_id``.  Series products are
    written as one row per date, or as one list per pixel unless exploded.
    """
    root = f"{base.rstrip('/')}/{cube_name(p.name)}"
    paths = {}
    for label, df in products.items():
        stacked = label.split("_")[-1] in ("TSS", "TSI") and not p.output_explode
        keys = [c for c in ("pixel_id", "index") if c in df.columns]
        shaped = series.time_series_stack(df, keys) if stacked else df
        tiled = shaped.join(pixels.select("pixel_id", "tile_x", "tile_y"), "pixel_id")
        path = write_cube(tiled, root, label)
        if p.fail_if_empty:
            select.check_nonempty(df.sparkSession.read.parquet(path), fail=True).head()
        paths[label] = path
    return paths
