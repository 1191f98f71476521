"""Building series of analysed values.

A series has one row per key and date.  That bounds every per-series window by
the number of days, so a pixel that supplies most of the raw rows is merged by
``daily_series`` (map-side combine) before anything is grouped by pixel.
"""

from __future__ import annotations

import itertools
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelfold.functions import indices

KEY = ("pixel_id",)


def daily_series(df: DataFrame, keys=KEY, date="date", value="value") -> DataFrame:
    """Mean value and combined quality word per key and date."""
    aggs = [F.avg(value).alias("value")]
    if "qai" in df.columns:
        aggs.append(F.bit_or("qai").alias("qai"))
    return df.groupBy(*keys, F.col(date).cast("date").alias("date")).agg(*aggs)


def band_column(columns, band: str) -> str:
    """The column that holds a band, its number with or without a leading zero."""
    wanted = {band, band[:1] + band[1:].zfill(2)}
    chosen = next((c for c in columns if c in wanted), None)
    if chosen is None:
        raise ValueError(f"no band {band}")
    return chosen


def band_values(df: DataFrame, band: str) -> DataFrame:
    """A single band as the analysed ``value``; the other bands are dropped."""
    chosen = band_column(df.columns, band)
    known = set(indices.RAW_BANDS) | {b[:1] + b[1:].zfill(2) for b in indices.RAW_BANDS} | set(indices.ROLES)
    others = [c for c in df.columns if c not in known]
    return df.select(*others, F.col(chosen).alias("value"))


def spectral_index(df: DataFrame, names=("NDVI",), keep=None) -> DataFrame:
    """Named indices as columns; ``keep`` limits the other columns."""
    bands = indices.role_columns(df.columns)
    columns = df.columns if keep is None else list(keep)
    return df.select(*columns, *[indices.index_column(n, bands).alias(n) for n in names])


def _unmixing(endmembers: dict[str, list[float]], bands) -> tuple[np.ndarray, np.ndarray]:
    """The matrix of endmembers and its pseudo-inverse, computed once per plan."""
    matrix = np.array(list(endmembers.values()), dtype=float).T
    if matrix.shape != (len(bands), len(endmembers)):
        raise ValueError("every endmember needs one value per band")
    return matrix, np.linalg.pinv(matrix)


def _total(terms) -> Column:
    return reduce(lambda a, b: a + b, terms)


def fraction(endmember: str, endmembers: dict[str, list[float]], bands) -> Column:
    """Least-squares fraction of one endmember, a linear expression of the bands."""
    weights = _unmixing(endmembers, bands)[1][list(endmembers).index(endmember)]
    return _total([F.col(b) * float(w) for b, w in zip(bands, weights, strict=True)])


def sma(df: DataFrame, endmembers: dict[str, list[float]], bands, prefix="frac_") -> DataFrame:
    """Least-squares fraction of every endmember and the model RMSE."""
    matrix, _ = _unmixing(endmembers, bands)
    out = df.withColumns({f"{prefix}{n}": fraction(n, endmembers, bands) for n in endmembers})
    errors = []
    for j, b in enumerate(bands):
        modelled = _total([F.col(f"{prefix}{n}") * float(matrix[j, i]) for i, n in enumerate(endmembers)])
        errors.append((F.col(b) - modelled) * (F.col(b) - modelled))
    return out.withColumn("sma_rmse", F.sqrt(_total(errors) / len(bands)))


# Endmembers of a constrained unmixing at most; every subset of them is tried.
MOST_ENDMEMBERS = 6


def _on_support(matrix: np.ndarray, support: list[int], sum_to_one: bool) -> tuple[np.ndarray, np.ndarray] | None:
    """(weights, offsets) of the least-squares fractions on some endmembers; None where they are not unique."""
    m = matrix[:, support]
    k = len(support)
    if not k:
        return np.zeros((0, len(matrix))), np.zeros(0)
    if np.linalg.matrix_rank(np.vstack([m, np.ones(k)]) if sum_to_one else m) < k:
        return None
    if not sum_to_one:
        return np.linalg.pinv(m), np.zeros(k)
    system = np.block([[m.T @ m, np.ones((k, 1))], [np.ones((1, k)), np.zeros((1, 1))]])
    inverse = np.linalg.inv(system)
    return inverse[:k, :k] @ m.T, inverse[:k, k]


def sma_constrained(df: DataFrame, endmembers: dict[str, list[float]], bands, prefix="frac_", sum_to_one=True) -> DataFrame:
    """Fractions that are not negative and, by default, sum up to one, with the model RMSE.

    The best such fractions are the free least-squares ones on those endmembers
    that take part.  Every choice of these is one set of linear expressions; of
    the choices without a negative fraction the one with the smallest error
    counts.  Exact, and without leaving column expressions.  A NULL band gives
    NULL fractions.
    """
    matrix, _ = _unmixing(endmembers, bands)
    names, n = list(endmembers), len(endmembers)
    if n > MOST_ENDMEMBERS:
        raise ValueError(f"at most {MOST_ENDMEMBERS} endmembers")
    choices = []
    for size in range(0 if not sum_to_one else 1, n + 1):
        for support in map(list, itertools.combinations(range(n), size)):
            solved = _on_support(matrix, support, sum_to_one)
            if solved is None:
                continue
            weights, offsets = solved
            part = {i: _total([F.col(b) * float(w) for b, w in zip(bands, row, strict=True)]) + float(c) for i, row, c in zip(support, weights, offsets, strict=True)}
            fractions = [part.get(i, F.lit(0.0)) for i in range(n)]
            errors = [(F.col(b) - _total([f * float(matrix[j, i]) for i, f in enumerate(fractions)])) for j, b in enumerate(bands)]
            feasible = reduce(lambda a, b: a & b, [part[i] >= -1e-12 for i in support], F.lit(True))
            choices.append(F.when(feasible, F.struct(_total([e * e for e in errors]).alias("error"), F.array(*fractions).alias("fractions"))))
    known = reduce(lambda a, b: a & b, [F.col(b).isNotNull() for b in bands])
    best = df.withColumn("_best", F.when(known, F.array_min(F.array(*choices))))
    return best.withColumns({
        **{f"{prefix}{name}": F.greatest(F.get("_best.fractions", F.lit(i)), F.when(known, 0.0)) for i, name in enumerate(names)},
        "sma_rmse": F.sqrt(F.col("_best.error") / len(bands))}).drop("_best")


# Sensors that can be adjusted (fixed values).
ADJUSTABLE = (
    "SEN2A", "SEN2B", "SEN2C", "SEN2D", "LND04", "LND05", "LND07", "LND08", "LND09", "MOD01", "MOD02",
)


def spectral_adjust(df: DataFrame, materials: list[dict], bands, outputs=None, sensor="sensor") -> DataFrame:
    """Material-specific harmonisation to the target sensor.

    ``materials``: ``name``, ``spectrum`` (value per band) and ``transfer``
    (output band -> (offset, {band: weight})).  A pixel takes the material with
    the smallest spectral angle; outputs may include bands the input lacks.
    """
    outputs = outputs or list(bands)
    total = lambda terms: reduce(lambda a, b: a + b, terms)
    norm = F.sqrt(total([F.col(b) * F.col(b) for b in bands]))
    allowed = df.where(F.col(sensor).isin(list(ADJUSTABLE))).withColumn("_norm", norm)
    likeness = []
    for i, m in enumerate(materials):
        length = float(np.sqrt(sum(s * s for s in m["spectrum"])))
        dot = total([F.col(b) * float(s) for b, s in zip(bands, m["spectrum"])])
        # the largest cosine is the smallest angle; ties take the first material
        likeness.append(F.struct((dot / F.nullif(F.col("_norm") * length, F.lit(0.0))).alias("cosine"), F.lit(-i).alias("order")))
    chosen = allowed.withColumn("_m", -F.array_max(F.array(*likeness))["order"])
    out = {}
    for o in outputs:
        column = F.lit(None).cast("double")
        for i, m in enumerate(materials):
            offset, weights = m["transfer"][o]
            mapped = F.lit(float(offset)) + total([F.col(b) * float(w) for b, w in weights.items()])
            column = F.when(F.col("_m") == i, mapped).otherwise(column)
        out[o] = column
    names = F.array(*[F.lit(m["name"]) for m in materials])
    others = [c for c in df.columns if c not in bands and c not in outputs]
    return chosen.select(*others, F.get(names, F.col("_m")).alias("material"), *[c.alias(o) for o, c in out.items()])


def time_series_stack(df: DataFrame, keys=KEY, date="date", value="value") -> DataFrame:
    """One ordered list of (date, value) per key; a list holds at most one entry per day."""
    entry = F.struct(F.col(date).alias("date"), F.col(value).alias("value"))
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("stack"))


STANDARDIZE = ("NONE", "CENTER", "NORMALIZE")


def standardize(df: DataFrame, mode="NONE", keys=KEY, value="value") -> DataFrame:
    """Centre on, or also scale by, the mean and standard deviation of the key.

    The key's rows are a series (one per date or step), so the window is bounded.
    """
    if mode not in STANDARDIZE:
        raise ValueError(f"mode must be one of {STANDARDIZE}")
    if mode == "NONE":
        return df
    whole = Window.partitionBy(*keys)
    centred = F.col(value) - F.avg(value).over(whole)
    if mode == "CENTER":
        return df.withColumn(value, centred)
    return df.withColumn(value, centred / F.nullif(F.stddev_samp(value).over(whole), F.lit(0.0)))


def pivot_stack(df: DataFrame, layers, layer="layer", keys=KEY, value="value") -> DataFrame:
    """One row per key with one column per layer, in the given order."""
    return df.groupBy(*keys).pivot(layer, list(layers)).agg(F.max(value))


def explode_stack(df: DataFrame, layers, keys=KEY, layer="layer", value="value") -> DataFrame:
    """One record per key and layer; empty layers are left out."""
    layers = list(layers)
    return df.unpivot(list(keys), layers, layer, value).where(F.col(value).isNotNull())
