"""Hollows of a raster filled to their rims, across blocks of any number."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelfold.operators import focal
from pixelfold.session import cut_lineage

# Sides of a block and the step to the neighbour there.
SIDES = {"north": (0, -1), "south": (0, 1), "west": (-1, 0), "east": (1, 0)}
OPPOSITE = {"north": "south", "south": "north", "west": "east", "east": "west"}


def _edge(levels: np.ndarray, side: str) -> np.ndarray:
    return {"north": levels[0], "south": levels[-1], "west": levels[:, 0], "east": levels[:, -1]}[side]


def settle(values: np.ndarray, outside: dict[str, np.ndarray | None]) -> np.ndarray:
    """Water levels of one block, NaN where it has no pixel.

    ``outside`` gives the levels beyond each side (NaN: no pixel there, water
    runs off; None: no block).  Water runs off wherever a pixel is missing.
    Levels sink from above in sweeps over rows and columns until nothing changes.
    """
    here = ~np.isnan(values)
    ground = np.where(here, values, np.inf)
    level = np.full_like(ground, np.inf)
    missing = np.pad(~here, 1, constant_values=False)
    for side in SIDES:
        beyond = outside.get(side)
        beyond = np.full(len(ground), np.nan) if beyond is None else beyond
        _edge(missing[:, 1:-1] if side in ("north", "south") else missing[1:-1], side)[:] = np.isnan(beyond)
        rim = _edge(level, side)
        rim[:] = np.minimum(rim, np.maximum(_edge(ground, side), np.where(np.isnan(beyond), -np.inf, beyond)))
    off = missing[:-2, 1:-1] | missing[2:, 1:-1] | missing[1:-1, :-2] | missing[1:-1, 2:]
    level = np.where(off & here, ground, level)
    while True:
        before = level.copy()
        for lv, gr in ((level, ground), (level[::-1], ground[::-1]), (level.T, ground.T), (level.T[::-1], ground.T[::-1])):
            for i in range(1, len(lv)):
                np.maximum(gr[i], np.minimum(lv[i], lv[i - 1]), out=lv[i])
        if np.array_equal(before, level):
            return np.where(here, level, np.nan)


def _packed(keys: list[str], block: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        values = np.full((block, block), np.nan)
        values[(rows["y"] - first["_by"] * block).to_numpy(int), (rows["x"] - first["_bx"] * block).to_numpy(int)] = rows["_v"].to_numpy(float)
        start = np.where(np.isnan(values), np.nan, np.inf)
        named = {k: [rows[k].iloc[0]] for k in (*keys, "_bx", "_by")}
        return pd.DataFrame({**named, "values": [values.tobytes()], **{s: [_edge(start, s).tobytes()] for s in SIDES}})
    return run


def _array(data: bytes | None) -> np.ndarray | None:
    return None if data is None else np.frombuffer(data, float)


def _levels(row, block: int) -> np.ndarray:
    return settle(np.frombuffer(row.values_, float).reshape(block, block), {s: _array(getattr(row, f"in_{s}")) for s in SIDES})


def _round(keys: list[str], block: int):
    """Levels at the sides of every block whose surroundings changed; the others keep theirs."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                named = [getattr(row, k) for k in (*(f"k{i}" for i in range(len(keys))), "bx", "by")]
                old = [getattr(row, s) for s in SIDES]
                new = old
                if row.stirred:
                    levels = _levels(row, block)
                    new = [_edge(levels, s).tobytes() for s in SIDES]
                out.append([*named, *new, new != old])
            yield pd.DataFrame(out, columns=[*keys, "_bx", "_by", *SIDES, "changed"])
    return run


def _drained(keys: list[str], block: int, name: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                levels = _levels(row, block)
                y, x = np.nonzero(~np.isnan(levels))
                named = {k: [getattr(row, f"k{i}")] * len(x) for i, k in enumerate(keys)}
                yield pd.DataFrame({**named, "x": x + row.bx * block, "y": y + row.by * block, name: levels[y, x]})
    return run


def fill_holes(grid: DataFrame, value: str, keys=("scene_id",), block=focal.BLOCK, name="filled") -> DataFrame:
    """(keys, x, y, ``name``): every value raised to the lowest level at which water on it would run off.

    Water moves to the four neighbours and runs off at the border of the raster
    and at pixels that are missing or NULL; those get no row.  Of repeated pixels
    one counts.  Pixels are packed into blocks once and stay where they are.
    What travels afterwards are the levels along the sides of the blocks: every
    round settles the blocks next to a changed side, until no side changes, so a
    hollow may wind through any number of blocks.
    """
    keys = list(keys)
    spark = grid.sparkSession
    at = [*keys, "_bx", "_by"]
    number = lambda c: F.floor(F.col(c) / F.lit(float(block))).cast("int")
    pixels = grid.select(*keys, F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.col(value).cast("double").alias("_v"))
    pixels = pixels.where(F.col("_v").isNotNull() & ~F.isnan("_v")).withColumns({"_bx": number("x"), "_by": number("y")})
    kinds = T.StructType([pixels.schema[c] for c in at])
    sides = T.StructType([T.StructField(s, T.BinaryType()) for s in SIDES])
    packed = pixels.groupBy(*at).applyInPandas(_packed(keys, block), T.StructType([*kinds, T.StructField("values", T.BinaryType()), *sides]))
    # kept by block, so that only sides are exchanged from here on; lost parts are computed again
    blocks = packed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *at).persist(StorageLevel.DISK_ONLY)

    def joined(rims: DataFrame) -> DataFrame:
        sent = F.inline(F.array(*[F.struct((F.col("_bx") + dx).alias("_tx"), (F.col("_by") + dy).alias("_ty"), F.lit(OPPOSITE[s]).alias("side"),
                                           F.col(s).alias("level")) for s, (dx, dy) in SIDES.items()]))
        got = rims.select(*keys, "changed", sent).groupBy(*keys, F.col("_tx").alias("_bx"), F.col("_ty").alias("_by")).agg(
            F.bool_or("changed").alias("stirred"),
            *[F.max(F.when(F.col("side") == s, F.col("level"))).alias(f"in_{s}") for s in SIDES])
        both = blocks.drop(*SIDES).join(rims.drop("changed"), at).join(got, at, "left")
        return both.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col("_bx").alias("bx"), F.col("_by").alias("by"),
                           F.col("values").alias("values_"), F.coalesce("stirred", F.lit(False)).alias("stirred"), *SIDES,
                           *[f"in_{s}" for s in SIDES])

    # every block is settled once, also one without neighbours
    rims = blocks.select(*at, *SIDES).withColumn("changed", F.lit(True))
    rim_type = T.StructType([*kinds, *sides, T.StructField("changed", T.BooleanType())])
    while True:
        rims = cut_lineage(joined(rims).mapInPandas(_round(keys, block), rim_type))
        if rims.where("changed").isEmpty():
            break
    out = T.StructType([*[pixels.schema[k] for k in keys], T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType()),
                        T.StructField(name, T.DoubleType())])
    filled = cut_lineage(joined(rims).mapInPandas(_drained(keys, block, name), out))
    blocks.unpersist()
    return filled
