"""Neighbourhoods of raster pixels with one shuffle.

Rows go to square blocks; rows near a block edge are copied to the blocks
beside it, about 2 % more rows for 256-pixel blocks and one pixel of reach.
After that single exchange every step below works within blocks, without another
shuffle.  A block holds at most ``block`` squared pixels plus its rim, however
large the scene; blocks with few pixels are worked many at a time, so that their
number costs nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelfold.operators.runs import whole_runs

BLOCK = 256
SCENE = ("scene_id",)


def _blocks(coordinate: str, reach: int, size: int) -> Column:
    c = F.col(coordinate)
    low = F.floor((c - reach) / F.lit(float(size))).cast("int")
    high = F.floor((c + reach) / F.lit(float(size))).cast("int")
    return F.explode(F.sequence(low, high))


def blocked(df: DataFrame, reach: int, keys=SCENE, block=BLOCK, copies: Column | None = None) -> DataFrame:
    """Rows in block partitions ``_bx, _by``; ``_home`` marks the row's own block.

    ``copies`` limits which rows are copied to neighbouring blocks.
    """
    spread = df.withColumn("_bx", _blocks("x", reach, block)).withColumn("_by", _blocks("y", reach, block))
    own = (F.floor(F.col("x") / F.lit(float(block))) == F.col("_bx")) & (F.floor(F.col("y") / F.lit(float(block))) == F.col("_by"))
    spread = spread.withColumn("_home", own)
    if copies is not None:
        spread = spread.where(F.col("_home") | copies)
    return spread.repartition(*keys, "_bx", "_by")


def _within(coordinate: Column, number: str, block: int) -> Column:
    start = F.col(number) * block
    return (coordinate >= start) & (coordinate < start + block)


def sweep(rows: DataFrame, axis: str, reach: int, keys, block, aggregates, carry, active: Column | None = None) -> DataFrame:
    """One pass along an axis of blocked rows.

    Every row contributes at the positions up to ``reach`` away; ``aggregates``
    combine the contributions, which see the offset as ``_d``.  ``carry``
    columns are those of the home row at offset 0.  Rows that are not
    ``active`` only contribute to their own position.
    """
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    if active is not None:
        steps = F.when(active, steps).otherwise(F.array(F.lit(0)))
    moved = rows.withColumn("_d", F.explode(steps)).withColumn("_t", F.col(axis) + F.col("_d"))
    moved = moved.where(_within(F.col("_t"), "_bx" if axis == "x" else "_by", block))
    other = "y" if axis == "x" else "x"
    kept = [F.expr(f"max(CASE WHEN _d = 0 AND _home THEN `{c}` END) AS `{c}`") for c in carry]
    home = F.expr("max(_d = 0 AND _home) AS _home")
    return (
        moved.groupBy(*keys, "_bx", "_by", F.col("_t"), F.col(other))
        .agg(home, *kept, *aggregates)
        .withColumnRenamed("_t", axis)
    )


def _by_block(rows: DataFrame, keys, work: Callable[[pa.Table, np.ndarray], pa.Table], schema: T.StructType) -> DataFrame:
    """``work`` on the blocks of ``blocked`` rows; a task holds one block and one batch at a time."""
    at = [*keys, "_bx", "_by"]
    return rows.sortWithinPartitions(*at).mapInArrow(whole_runs(at, work), schema)


def _merged(rows: pa.Table, first: np.ndarray, cols) -> pa.Table:
    """One row a pixel from rows in the order of pixels: the largest value of every column, NaN above all."""
    begin = np.flatnonzero(first)
    size = np.diff(np.append(begin, rows.num_rows))
    out = rows.take(pa.array(begin))
    many = np.flatnonzero(size > 1)
    for c in cols:
        kind = rows.schema.field(c).type
        largest = []
        for i in many:
            known = [v for v in rows[c].slice(int(begin[i]), int(size[i])).to_pylist() if v is not None]
            largest.append(max(known, key=lambda v: (v != v, v), default=None))
        place = np.arange(len(begin))
        place[many] = len(begin) + np.arange(len(many))
        both = pa.concat_arrays([out[c].combine_chunks(), pa.array(largest, kind)])
        out = out.set_column(out.schema.get_field_index(c), c, both.take(pa.array(place)))
    return out


def _around(cols: list[str], kept: list[str], block: int):
    def run(rows: pa.Table, group: np.ndarray) -> pa.Table:
        side = block + 2
        x, y = _places(rows, 1, block)
        place = (group * side + y) * side + x
        order = np.argsort(place, kind="stable")
        rows, place = rows.take(pa.array(order)), place[order]
        first = np.append(True, place[1:] != place[:-1])
        if not first.all():
            rows, place = _merged(rows, first, dict.fromkeys([*kept, *cols])), place[first]
        home = rows["_home"].to_numpy()
        out = rows.filter(rows["_home"]).select(kept)
        at = place[home]
        for i in range(9):
            wanted = at + (i // 3 - 1) * side + i % 3 - 1
            near = np.minimum(np.searchsorted(place, wanted), len(place) - 1)
            near = pa.array(near, mask=place[near] != wanted)
            for c in cols:
                out = out.append_column(f"{c}_{i}", rows[c].take(near))
        return out.select([*kept, *[f"{c}_{i}" for c in cols for i in range(9)]])
    return run


def windows3(df: DataFrame, cols, keys=SCENE, block=BLOCK, carry=()) -> DataFrame:
    """The 3x3 window of every column, as ``<col>_0`` .. ``<col>_8`` row by row from (x-1, y-1).

    A missing neighbour is NULL.  Columns in ``carry`` are kept, others dropped.
    Neighbours are looked up among the ordered pixels of a block; no row is
    multiplied.  Rows of one pixel count as one with their largest values.
    """
    cols = list(cols)
    kept = list(dict.fromkeys([*keys, "x", "y", *carry]))
    rows = blocked(df.select(*dict.fromkeys([*kept, *cols])), 1, keys, block)
    kinds = T.StructType([T.StructField(c, rows.schema[c].dataType) for c in kept]
                         + [T.StructField(f"{c}_{i}", rows.schema[c].dataType) for c in cols for i in range(9)])
    return _by_block(rows, keys, _around(cols, kept, block), kinds)


def window3(df: DataFrame, col: str, keys=SCENE, block=BLOCK, carry=()) -> DataFrame:
    """The 3x3 window of one column as ``n0`` .. ``n8``."""
    gathered = windows3(df, [col], keys, block, carry)
    return gathered.withColumnsRenamed({f"{col}_{i}": f"n{i}" for i in range(9)})


def _places(rows: pa.Table, reach: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and rows of the pixels in their blocks, counted with ``reach`` more on every side."""
    number = lambda c: rows[c].to_numpy().astype(np.int64)
    return tuple(number(c) - (number(n) * block - reach) for c, n in (("x", "_bx"), ("y", "_by")))


def _squared(x: np.ndarray, y: np.ndarray, reach: int, limit: int, block: int) -> np.ndarray:
    """Squared distance of a block's pixels to the nearest of the places, -1 beyond ``limit`` on an axis."""
    side = block + 2 * reach
    far = np.int64(1) << 60
    marked = np.zeros((side, side), bool)
    marked[y, x] = True
    step = np.arange(side)[:, None]
    last = np.maximum.accumulate(np.where(marked, step, -side), axis=0)
    following = np.minimum.accumulate(np.where(marked, step, 2 * side)[::-1], axis=0)[::-1]
    up = np.minimum(step - last, following - step)[reach:reach + block]
    up = np.where(up <= limit, up * up, far)
    best = np.full((block, block), far)
    for d in range(limit + 1):
        # nothing as far off on this axis can come nearer
        if d * d >= best.max():
            break
        for shift in {reach - d, reach + d}:
            np.minimum(best, up[:, shift:shift + block] + d * d, out=best)
    return np.where(best < far, best, -1)


def _searched(at: np.ndarray, marks: np.ndarray, limit: int, side: int) -> np.ndarray:
    """``_squared`` of pixels and mask pixels numbered row by row, by looking up both neighbours in every row in reach."""
    far = np.int64(1) << 60
    marks = np.concatenate([[-far], np.unique(marks), [far]])
    best = np.full(len(at), far)
    for d in range(limit + 1):
        # nothing as far off on this axis can come nearer
        left = np.flatnonzero(best > d * d)
        if not len(left):
            break
        for shift in {-d, d}:
            wanted = at[left] + shift * side
            after = np.searchsorted(marks, wanted)
            # rows end ``limit`` or more beside every pixel, so no neighbour this near is of another row
            across = np.minimum(marks[after] - wanted, wanted - marks[after - 1])
            best[left] = np.minimum(best[left], np.where(across <= limit, across * across + d * d, far))
    return np.where(best < far, best, -1)


def _nearest(reaches: dict[str, int], kept: list[str], block: int):
    reach = max(reaches.values())
    side = block + 2 * reach

    def run(rows: pa.Table, group: np.ndarray) -> pa.Table:
        x, y = _places(rows, reach, block)
        place = (group * side + y) * side + x
        home = rows["_home"].to_numpy()
        out = rows.filter(rows["_home"]).select(kept)
        size = np.bincount(group)
        begin = np.append(0, np.cumsum(size))
        for name, limit in reaches.items():
            hit = rows[f"_m_{name}"].to_numpy()
            d2 = np.full(len(home), -1, np.int64)
            marked = np.bincount(group, hit) > 0
            # a scan costs the same for any number of pixels, a search grows with it
            full = marked & (size * (2 * limit + 1) > side * side // 2)
            asked = home & (marked & ~full)[group]
            if asked.any():
                d2[asked] = _searched(place[asked], place[hit & ~full[group]], limit, side)
            for g in np.flatnonzero(full):
                own = slice(begin[g], begin[g + 1])
                here, its = home[own], hit[own]
                found = _squared(x[own][its], y[own][its], reach, limit, block)
                d2[own][here] = found[y[own][here] - reach, x[own][here] - reach]
            d2 = d2[home]
            out = out.append_column(f"d2_{name}", pa.array(d2, pa.int64(), mask=d2 < 0))
        return out
    return run


def nearest_each(df: DataFrame, masks: dict[str, tuple[Column, int]], keys=SCENE, block=BLOCK, carry=()) -> DataFrame:
    """Squared pixel distance to the nearest pixel of every mask, as ``d2_<name>``.

    ``masks`` maps a name to (condition, reach per axis).  Exact and separable:
    a full block, with the mask pixels around it, is scanned once up and down for
    the nearest mask pixel of every column, and the columns in reach are then
    compared.  In sparse blocks every pixel looks up its neighbours among the
    ordered mask pixels instead, so the cost follows the pixels, not the area.
    No row is multiplied, whatever the reach, and all masks share the one
    shuffle.  No mask in reach gives NULL.
    """
    reaches = {n: r for n, (_, r) in masks.items()}
    kept = list(dict.fromkeys([*keys, "x", "y", *carry]))
    marked = df.select(*kept, *[F.coalesce(c, F.lit(False)).alias(f"_m_{n}") for n, (c, _) in masks.items()])
    anything = reduce(lambda a, b: a | b, [F.col(f"_m_{n}") for n in masks])
    rows = blocked(marked, max(reaches.values()), keys, block, anything)
    kinds = T.StructType([rows.schema[c] for c in kept] + [T.StructField(f"d2_{n}", T.LongType()) for n in masks])
    return _by_block(rows, keys, _nearest(reaches, kept, block), kinds)


def nearest_squared(df: DataFrame, mask: Column, reach: int, keys=SCENE, block=BLOCK, carry=()) -> DataFrame:
    """``nearest_each`` for one mask, as ``_d2``."""
    return nearest_each(df, {"mask": (mask, reach)}, keys, block, carry).withColumnRenamed("d2_mask", "_d2")


def square_stat(df: DataFrame, cols, reach: int, stat: str, keys=SCENE, block=BLOCK, carry=()) -> DataFrame:
    """``avg`` or ``max`` of every column over the (2r+1)-pixel square, as ``<col>_env``."""
    carry = list(dict.fromkeys([*carry, *cols]))
    rows = blocked(df.select(*keys, "x", "y", *carry), reach, keys, block)
    if stat == "max":
        first = [F.max(c).alias(f"_s_{c}") for c in cols]
        second = [F.max(f"_s_{c}").alias(f"_s_{c}") for c in cols]
        final = [F.col(f"_s_{c}").alias(f"{c}_env") for c in cols]
    elif stat == "avg":
        first = [a for c in cols for a in (F.sum(c).alias(f"_s_{c}"), F.count(c).alias(f"_n_{c}"))]
        second = [a for c in cols for a in (F.sum(f"_s_{c}").alias(f"_s_{c}"), F.sum(f"_n_{c}").alias(f"_n_{c}"))]
        final = [(F.col(f"_s_{c}") / F.nullif(F.col(f"_n_{c}"), F.lit(0))).alias(f"{c}_env") for c in cols]
    else:
        raise ValueError("stat must be avg or max")
    pass1 = sweep(rows, "x", reach, keys, block, first, carry)
    pass2 = sweep(pass1, "y", reach, keys, block, second, carry)
    return pass2.where("_home").select(*keys, "x", "y", *carry, *final)


def _box_sums(cols: list[str], kept: list[str], reach: int, block: int):
    def run(rows: pa.Table, group: np.ndarray) -> pa.Table:
        x, y = _places(rows, reach, block)
        home = rows["_home"].to_numpy()
        out = rows.filter(rows["_home"]).select(kept)
        begin = np.append(0, np.cumsum(np.bincount(group)))
        values = {c: rows[c].cast(pa.float64(), safe=False).to_numpy() for c in cols}
        means = {c: np.zeros(len(home)) for c in cols}
        counts = {c: np.zeros(len(home)) for c in cols}
        for a, b in zip(begin, begin[1:]):
            here = home[a:b]
            if not here.any():
                continue
            # only columns and rows that hold pixels take part
            (across, at_x), (down, at_y) = (np.unique(v[a:b], return_inverse=True) for v in (x, y))
            lo_x, lo_y = (np.searchsorted(u, v[a:b][here] - reach) for u, v in ((across, x), (down, y)))
            hi_x, hi_y = (np.searchsorted(u, v[a:b][here] + reach, "right") for u, v in ((across, x), (down, y)))
            for c in cols:
                own = values[c][a:b]
                known = ~np.isnan(own)
                # taken from the block's mean, so that sums of large values do not swallow small ones
                middle = own[known].mean() if known.any() else 0.0
                table = np.zeros((2, len(down) + 1, len(across) + 1))
                np.add.at(table, (0, at_y + 1, at_x + 1), np.where(known, own - middle, 0.0))
                np.add.at(table, (1, at_y + 1, at_x + 1), known)
                table = table.cumsum(axis=1).cumsum(axis=2)
                # the window of a pixel is four corners of the table
                total, n = table[:, hi_y, hi_x] - table[:, lo_y, hi_x] - table[:, hi_y, lo_x] + table[:, lo_y, lo_x]
                n = np.rint(n)
                means[c][a:b][here] = total / np.maximum(n, 1) + middle
                counts[c][a:b][here] = n
        for c in cols:
            out = out.append_column(f"{c}_env", pa.array(means[c][home], pa.float64(), mask=counts[c][home] < 1))
        return out
    return run


def box_means(df: DataFrame, cols, reach: int, keys=SCENE, block=BLOCK, carry=()) -> DataFrame:
    """Mean of every column over the (2r+1)-pixel square, as ``<col>_env``, at a cost that does not grow with the reach.

    Each block, with its rim, is summed up once along both axes; a window is then
    four corners of that table.  NULLs do not count; a window without values
    gives NULL.  Columns in ``carry`` are kept.
    """
    cols = list(cols)
    kept = list(dict.fromkeys([*keys, "x", "y", *carry]))
    rows = blocked(df.select(*dict.fromkeys([*kept, *cols])), reach, keys, block)
    kinds = T.StructType([rows.schema[c] for c in kept] + [T.StructField(f"{c}_env", T.DoubleType()) for c in cols])
    return _by_block(rows, keys, _box_sums(cols, kept, reach, block), kinds)
