"""Spectral indices as column expressions over band roles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Band numbers of each role (fixed values).
ROLES = {
    "BLUE": "B2", "GREEN": "B3", "RED": "B4", "RE1": "B5", "RE2": "B6",
    "RE3": "B7", "BNIR": "B8", "NIR": "B8A", "SWIR1": "B11", "SWIR2": "B12",
}
RAW_BANDS = ("B1", "B2", "B3", "B4", "B5", "B6", "B7", "B8", "B8A", "B9", "B10", "B11", "B12")

# Centre wavelengths in 0.1 micrometre (fixed values).
WAVELENGTH = {"BNIR": 8.328, "SWIR1": 16.137, "SWIR2": 22.024}

# Tasseled-cap weights (fixed values).
TASSELED_CAP = {
    "TC-BRIGHT": {"BLUE": 0.2043, "GREEN": 0.4158, "RED": 0.5524, "BNIR": 0.5741, "SWIR1": 0.3124, "SWIR2": 0.2303},
    "TC-GREEN": {"BLUE": -0.1603, "GREEN": -0.2819, "RED": -0.4934, "BNIR": 0.7940, "SWIR1": -0.0002, "SWIR2": -0.1446},
    "TC-WET": {"BLUE": 0.0315, "GREEN": 0.2021, "RED": 0.3102, "BNIR": 0.1594, "SWIR1": -0.6806, "SWIR2": -0.6109},
}


def ratio(top: Column, bottom: Column) -> Column:
    """Division that gives NULL on a zero denominator."""
    return top / F.nullif(bottom, F.lit(0.0))


def normalized(a: Column, b: Column) -> Column:
    return ratio(a - b, a + b)


def _tasseled(name, b):
    total = None
    for role, weight in TASSELED_CAP[name].items():
        term = b[role] * F.lit(weight)
        total = term if total is None else total + term
    return total


def _msr(b, nir):
    q = ratio(b[nir], b["RE1"])
    return ratio(q - 1, F.when(q + 1 > 0, F.sqrt(q + 1)))


def _resistant_red(b):
    return b["RED"] * 2 - b["BLUE"]


def _continuum(b, wl):
    slope = (b["SWIR2"] - b["BNIR"]) / F.lit(wl["SWIR2"] - wl["BNIR"])
    return ratio(b["SWIR1"], b["BNIR"] + slope * F.lit(wl["SWIR1"] - wl["BNIR"]))


def index_column(name: str, bands: dict[str, Column], wavelengths=WAVELENGTH) -> Column:
    """Expression of index ``name``; ``bands`` maps a role to its column."""
    b = bands
    simple = {
        "NDVI": ("BNIR", "RED"), "NBR": ("BNIR", "SWIR2"), "NDTI": ("SWIR1", "SWIR2"),
        "NDBI": ("SWIR1", "BNIR"), "NDWI": ("GREEN", "BNIR"), "MNDWI": ("GREEN", "SWIR1"),
        "NDSI": ("GREEN", "SWIR1"), "NDMI": ("BNIR", "SWIR1"), "NDRE1": ("RE2", "RE1"),
        "NDRE2": ("RE3", "RE1"), "NDVIre1": ("BNIR", "RE1"), "NDVIre2": ("BNIR", "RE2"),
        "NDVIre3": ("BNIR", "RE3"), "NDVIre1n": ("NIR", "RE1"), "NDVIre2n": ("NIR", "RE2"),
        "NDVIre3n": ("NIR", "RE3"), "CCI": ("GREEN", "RED"),
    }
    if name in simple:
        first, second = simple[name]
        return normalized(b[first], b[second])
    if name in TASSELED_CAP:
        return _tasseled(name, b)
    special = {
        "EVI": lambda: ratio((b["BNIR"] - b["RED"]) * 2.5, b["BNIR"] + b["RED"] * 6 - b["BLUE"] * 7.5 + 1),
        "EVI2": lambda: ratio((b["BNIR"] - b["RED"]) * 2.4, b["BNIR"] + b["RED"] + 1),
        "ARVI": lambda: normalized(b["BNIR"], _resistant_red(b)),
        "SAVI": lambda: ratio((b["BNIR"] - b["RED"]) * 1.5, b["BNIR"] + b["RED"] + 0.5),
        "SARVI": lambda: ratio((b["BNIR"] - _resistant_red(b)) * 1.5, b["BNIR"] + _resistant_red(b) + 0.5),
        "TC-DI": lambda: _tasseled("TC-BRIGHT", b) - (_tasseled("TC-GREEN", b) + _tasseled("TC-WET", b)),
        "kNDVI": lambda: F.tanh(F.pow(normalized(b["BNIR"], b["RED"]), F.lit(2.0))),
        "CIre": lambda: ratio(b["RE3"], b["RE1"]) - 1,
        "MSRre": lambda: _msr(b, "BNIR"),
        "MSRren": lambda: _msr(b, "NIR"),
        "ContRemSWIR": lambda: _continuum(b, wavelengths),
    }
    if name not in special:
        raise ValueError(f"unknown index {name}")
    return special[name]()


# Names of the indices (fixed values).
INDEX_NAMES = (
    "NDVI", "EVI", "NBR", "NDTI", "ARVI", "SAVI", "SARVI", "TC-BRIGHT", "TC-GREEN", "TC-WET",
    "TC-DI", "NDBI", "NDWI", "MNDWI", "NDMI", "NDSI", "kNDVI", "NDRE1", "NDRE2", "CIre",
    "NDVIre1", "NDVIre2", "NDVIre3", "NDVIre1n", "NDVIre2n", "NDVIre3n", "MSRre", "MSRren",
    "CCI", "EVI2", "ContRemSWIR",
)


def role_columns(columns) -> dict[str, Column]:
    """Find every role among ``columns``, by role name or by band number."""
    present = set(columns)
    found = {}
    for role, band in ROLES.items():
        if role in present:
            found[role] = F.col(role)
        elif band in present:
            found[role] = F.col(band)
        elif band[0] + band[1:].zfill(2) in present:
            found[role] = F.col(band[0] + band[1:].zfill(2))
    return found
