"""Bit-packed quality flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed layout: name -> (first bit, bit mask, state).  Two-bit fields hold a
# state, so they are compared for equality.
LAYOUT = {
    "NODATA": (0, 1, 1),
    "CLOUD_BUFFER": (1, 3, 1),
    "CLOUD_OPAQUE": (1, 3, 2),
    "CLOUD_CIRRUS": (1, 3, 3),
    "CLOUD_SHADOW": (3, 1, 1),
    "SNOW": (4, 1, 1),
    "WATER": (5, 1, 1),
    "AOD_INT": (6, 3, 1),
    "AOD_HIGH": (6, 3, 2),
    "AOD_FILL": (6, 3, 3),
    "SUBZERO": (8, 1, 1),
    "SATURATION": (9, 1, 1),
    "SUN_LOW": (10, 1, 1),
    "ILLUMIN_LOW": (11, 3, 1),
    "ILLUMIN_POOR": (11, 3, 2),
    "ILLUMIN_NONE": (11, 3, 3),
    "SLOPED": (13, 1, 1),
    "WVP_NONE": (14, 1, 1),
}

# Conditions screened by default (fixed values).
DEFAULT_SCREEN = (
    "NODATA", "CLOUD_OPAQUE", "CLOUD_BUFFER", "CLOUD_CIRRUS",
    "CLOUD_SHADOW", "SNOW", "SUBZERO", "SATURATION",
)


def has_flag(name: str, qai="qai") -> Column:
    bit, mask, state = LAYOUT[name]
    field = F.shiftright(F.col(qai), bit).bitwiseAND(F.lit(mask))
    return field == state


def any_flag(names, qai="qai") -> Column:
    unknown = [n for n in names if n not in LAYOUT]
    if unknown:
        raise ValueError(f"unknown quality flags {unknown}")
    return reduce(lambda a, b: a | b, (has_flag(n, qai) for n in names), F.lit(False))


def is_screened(names=DEFAULT_SCREEN, qai="qai") -> Column:
    """True where an observation carries any of ``names``; NULL counts as clear."""
    return F.coalesce(any_flag(names, qai), F.lit(False))


def packed(states: dict[str, Column]) -> Column:
    """The quality word of named conditions; of the states of one field the first that holds counts."""
    fields: dict[int, Column] = {}
    for name, holds in reversed(states.items()):
        bit, _, state = LAYOUT[name]
        fields[bit] = F.when(F.coalesce(holds, F.lit(False)), state << bit).otherwise(fields.get(bit, F.lit(0)))
    return reduce(lambda a, b: a + b, fields.values(), F.lit(0)).cast("int")
