"""Parameters of the two analysis plans, with their defaults and checks."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pixelfold.functions import indices, qai, statistics
from pixelfold.operators import interpolate, merge, polar, resample, series
from pixelfold.functions.kernels import HALF_TAPS
from pixelfold.functions.student import TAILS

# Accepted sensors and formats (fixed values).
SENSORS = ("SEN2A", "SEN2B", "SEN2C")
TARGETS = (*SENSORS, "SEN2L")
FORMATS = ("GTiff", "COG", "parquet")
INDEX_CHOICES = (*indices.RAW_BANDS, "SMA", *indices.INDEX_NAMES)


def _one_of(name, value, allowed):
    if value not in allowed:
        raise ValueError(f"{name} must be one of {tuple(allowed)}, not {value!r}")


def _all_of(name, values, allowed):
    for v in values:
        _one_of(name, v, allowed)


def read_parameters(kind, values: dict):
    """Parameters from a dict; unknown names are an error."""
    known = {f.name for f in fields(kind)}
    unknown = sorted(set(values) - known)
    if unknown:
        raise ValueError(f"unknown parameters {unknown}")
    return kind(**values)


@dataclass(frozen=True)
class SeriesParameters:
    """Time-series analysis."""

    date_range: tuple[str, str]
    name: str | None = None
    doy_range: tuple[int, int] = (1, 366)
    x_tile_range: tuple[int, int] = (-999, 9999)
    y_tile_range: tuple[int, int] = (-999, 9999)
    file_tile: list[str] | None = None
    chunk_size: tuple[int, int] | None = None
    resolution: int = 20
    reduce_psf: bool = False
    use_l2_improphe: bool = False
    sensors: tuple[str, ...] = SENSORS
    target_sensor: str = "SEN2L"
    product_type_main: str = "BOA"
    product_type_quality: str | None = "QAI"
    spectral_adjust: bool = False
    screen_qai: tuple[str, ...] = qai.DEFAULT_SCREEN
    above_noise: float = 0
    below_noise: float = 0
    index: tuple[str, ...] = ("NDVI",)
    standardize_tss: str = "NONE"
    output_tss: bool = False
    interpolate: str = "NONE"
    moving_max: int = 16
    rbf_sigma: tuple[int, ...] = (8, 16, 32)
    rbf_cutoff: float = 0.95
    harmonic_trend: bool = True
    harmonic_modes: int = 3
    harmonic_fit_range: tuple[str, str] | None = None
    output_nrt: bool = False
    int_day: int = 16
    standardize_tsi: str = "NONE"
    output_tsi: bool = False
    output_stm: bool = False
    stm: tuple[str, ...] = ()
    fold_type: str = "AVG"
    standardize_fold: str = "NONE"
    output_fby: bool = False
    output_fbq: bool = False
    output_fbm: bool = False
    output_fbw: bool = False
    output_fbd: bool = False
    output_try: bool = False
    output_trq: bool = False
    output_trm: bool = False
    output_trw: bool = False
    output_trd: bool = False
    output_cay: bool = False
    output_caq: bool = False
    output_cam: bool = False
    output_caw: bool = False
    output_cad: bool = False
    pol_start_threshold: float = 0.2
    pol_mid_threshold: float = 0.5
    pol_end_threshold: float = 0.8
    pol_adaptive: bool = False
    pol: tuple[str, ...] = ()
    standardize_pol: str = "NONE"
    output_pct: bool = False
    output_pol: bool = False
    output_tro: bool = False
    output_cao: bool = False
    trend_tail: str = "TWO"
    trend_conf: float = 0.95
    change_penalty: bool = False
    output_format: str = "parquet"
    output_explode: bool = False
    fail_if_empty: bool = False

    def __post_init__(self):
        _all_of("sensors", self.sensors, SENSORS if not self.spectral_adjust else series.ADJUSTABLE)
        _one_of("target_sensor", self.target_sensor, TARGETS)
        _all_of("screen_qai", self.screen_qai, qai.LAYOUT)
        _all_of("index", self.index, INDEX_CHOICES)
        for n in ("standardize_tss", "standardize_tsi", "standardize_fold", "standardize_pol"):
            _one_of(n, getattr(self, n), series.STANDARDIZE)
        _one_of("interpolate", self.interpolate, interpolate.METHODS)
        _one_of("harmonic_modes", self.harmonic_modes, (1, 2, 3))
        statistics.check_names(self.stm, statistics.STM_NAMES)
        _one_of("fold_type", self.fold_type, statistics.FOLD_NAMES)
        _all_of("pol", self.pol, polar.METRICS)
        _one_of("trend_tail", self.trend_tail, TAILS)
        _one_of("output_format", self.output_format, FORMATS)
        polar.check_thresholds(self.pol_start_threshold, self.pol_mid_threshold, self.pol_end_threshold)
        if self.chunk_size is not None and 0 in tuple(self.chunk_size):
            raise ValueError("chunk_size may not be 0")
        if self.output_nrt and (self.interpolate != "HARMONIC" or not self.harmonic_fit_range):
            raise ValueError("output_nrt needs harmonic interpolation and harmonic_fit_range")
        if (self.output_pol or self.output_tro or self.output_cao) and not self.pol:
            raise ValueError("seasonal outputs need metrics in pol")
        if self.output_stm and not self.stm:
            raise ValueError("output_stm needs metrics in stm")


@dataclass(frozen=True)
class SceneParameters:
    """Preparation of scenes for analysis."""

    name: str | None = None
    aoi: str | dict | None = None
    tile_size: int = 30000
    block_size: int = 3000
    origin_lon: float = -25.0
    origin_lat: float = 60.0
    resolution: int = 20
    projection: str = "GLANCE7"
    resampling: str = "CC"
    dem: str | None = "Copernicus_30m"
    do_atmo: bool = True
    do_topo: bool = True
    do_brdf: bool = True
    do_adjacency: bool = True
    do_multi_scattering: bool = True
    do_aod: bool = True
    erase_clouds: bool = False
    max_cloud_cover_frame: float = 99
    max_cloud_cover_tile: float = 99
    cloud_buffer: int = 300
    cirrus_buffer: int = 0
    shadow_buffer: int = 90
    snow_buffer: int = 30
    cloud_threshold: float = 0.225
    shadow_threshold: float = 0.02
    res_merge: str = "IMPROPHE"
    impulse_noise: bool = True
    buffer_nodata: bool = False
    output_format: str = "parquet"
    output_dst: bool = False
    output_aod: bool = False
    output_wvp: bool = False
    output_vzn: bool = False
    output_hot: bool = False
    output_ovv: bool = False

    def __post_init__(self):
        if not self.projection:
            raise ValueError("projection needs a grid name or the name of the projection of px, py")
        _one_of("resampling", self.resampling, (*HALF_TAPS, *resample.AGGREGATES))
        _one_of("res_merge", self.res_merge, merge.METHODS)
        _one_of("output_format", self.output_format, FORMATS)
        if self.do_topo and not self.dem:
            raise ValueError("do_topo needs a dem")


PERIOD_OUTPUTS = {"Y": "y", "Q": "q", "M": "m", "W": "w", "D": "d"}

__all__ = ["PERIOD_OUTPUTS", "SceneParameters", "SeriesParameters", "read_parameters"]
