"""User functions on scattered units, and the gather of their results.

Only Python functions passed by the caller are run.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pixelfold.operators.runs import whole_runs


def scatter_parts(df: DataFrame, keys, parts=1, spread=None) -> DataFrame:
    """Add ``part``: each key is cut into ``parts`` pieces by a hash of its rows.

    The caller states the number; it does not depend on the size of the data, so
    the calls of a user function do not either.  Copies of one row are spread by
    the input partition, which is the same when a task is retried.
    """
    if parts == 1:
        return df.withColumn("part", F.lit(0))
    place = F.xxhash64(F.spark_partition_id(), *(spread or df.columns))
    return df.withColumn("part", F.pmod(place, F.lit(int(parts))).cast("int"))


def apply_user_fn(df: DataFrame, keys, fn: Callable, schema: str, context: dict | None = None, *,
                  parts: int, spread=None) -> DataFrame:
    """Run ``fn(frame, context)`` on every scatter unit and gather one table.

    The caller states in how many ``parts`` a key is cut.  With 1 a unit is a
    whole key and must fit a task; else ``frame`` holds one piece and a later
    gather merges the results.
    """
    context = dict(context or {})

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return fn(frame, context)

    return scatter_parts(df, keys, parts, spread).groupBy(*keys, "part").applyInPandas(run, schema)


def map_user_fn(df: DataFrame, fn: Callable, schema: str, context: dict | None = None) -> DataFrame:
    """Run ``fn(frame, context)`` on every Arrow batch, without grouping."""
    context = dict(context or {})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield fn(frame, context)

    return df.mapInPandas(run, schema)


# Results of a row function that are passed on at a time.
MOST_RESULTS = 10_000


def expand_user_fn(df: DataFrame, fn: Callable, schema: str, columns) -> DataFrame:
    """Run a generator ``fn(*columns)`` per row as a table function; the row is kept beside each result.

    Rows reach ``fn`` by the batch; a row without results is dropped.
    """
    results = T.StructType.fromDDL(schema)
    places = [df.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(results)

        def table(batch: pa.RecordBatch, rows: list[int], found: list[tuple]) -> pa.RecordBatch:
            made = zip(*found, strict=True)
            columns = [pa.array(v, kind, from_pandas=True) for v, kind in zip(made, kinds.types, strict=True)]
            return pa.RecordBatch.from_arrays([*batch.take(pa.array(rows)).columns, *columns], names=[*batch.schema.names, *kinds.names])

        for batch in batches:
            rows, found = [], []
            for i, values in enumerate(zip(*[batch.column(p).to_pylist() for p in places], strict=True)):
                for result in fn(*values):
                    rows.append(i)
                    found.append(tuple(result))
                    if len(rows) == MOST_RESULTS:
                        yield table(batch, rows, found)
                        rows, found = [], []
            if rows:
                yield table(batch, rows, found)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *results.fields]))


# Rows that a task looks at together, and how many of them a key needs to be merged there.
LOOKED_AT, FREQUENT = 1 << 17, 16


def _merged_batches(keys: list[str], fn: Callable, most: int):
    """One value per frequent key and task, or a few if a task sees more than ``most`` of them; rows of rare keys as they are."""
    def table(values: dict, schema: pa.Schema) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in values], schema.field(i).type) for i in range(len(keys))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(list(values.values()), schema.field(len(keys)).type)], schema=schema)

    def merge(rows: pa.Table, held: dict) -> pa.Table:
        """Frequent keys go to ``held``, the other rows are returned."""
        # one code per different key; the keys themselves never pass through floating point
        codes = np.zeros(rows.num_rows, np.int64)
        for k in keys:
            own = rows[k].combine_chunks().dictionary_encode("encode").indices.to_numpy().astype(np.int64)
            codes = np.unique(codes * (own.max() + 1) + own, return_inverse=True)[1]
        size = np.bincount(codes)
        often = size >= FREQUENT
        order = np.argsort(codes, kind="stable")
        ends = np.cumsum(size)
        values = rows[rows.schema.names[len(keys)]].to_pandas()
        for code in np.flatnonzero(often):
            at = order[ends[code] - size[code]:ends[code]]
            key, merged = tuple(rows[k][int(at[0])].as_py() for k in keys), fn(values.iloc[at].reset_index(drop=True))
            held[key] = fn(pd.Series([held[key], merged])) if key in held else merged
        return rows.filter(pa.array(~often[codes]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, object] = {}
        waiting: list[pa.RecordBatch] = []
        schema = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                schema = batch.schema
                waiting.append(batch)
            if waiting and (batch is None or sum(b.num_rows for b in waiting) >= LOOKED_AT):
                rows, waiting = pa.Table.from_batches(waiting), []
                if rows.num_rows:
                    yield from merge(rows, held).to_batches()
            if held and (batch is None or len(held) > most):
                yield table(held, schema)
                held = {}
    return run


def _merged_runs(fn: Callable, column: str):
    """One row for every run, with its values merged."""
    def work(rows: pa.Table, number: np.ndarray) -> pa.Table:
        size = np.bincount(number)
        ends = np.cumsum(size)
        values = rows[column].to_pandas()
        merged = [fn(values.iloc[e - n:e].reset_index(drop=True)) for e, n in zip(ends, size, strict=True)]
        at = rows.schema.get_field_index(column)
        return rows.take(pa.array(ends - size)).set_column(at, column, pa.array(merged, rows.schema.field(at).type, from_pandas=True))
    return work


def agg_user_fn(df: DataFrame, keys, fn: Callable, column: str, returns="double", parts=(16,), name="result", held_keys=100_000) -> DataFrame:
    """User-supplied gather: one result per key from a function of a value series.

    ``fn`` must be associative and commutative (its result can be its input
    again).  Every task merges the rows of keys that are frequent in it before
    anything is shuffled and holds one value for each, so a hot key leaves a task
    as one value (or as one each time ``held_keys`` keys are exceeded) and the
    few rows of stretches in which it was rare.  Rows of rare keys are shuffled,
    as merging them in a task would take a call for almost every row.  Each level
    of ``parts`` then merges that many pieces of a key; the last merge sees one
    value per piece.  The calls grow with the keys, not with the rows.
    """
    keys = list(keys)
    slim = df.select(*keys, F.col(column).cast(returns).alias("_v"))
    current = slim.mapInArrow(_merged_batches(keys, fn, held_keys), slim.schema)
    current = current.withColumn("_h", F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id()))

    def gathered(rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(whole_runs(by, _merged_runs(fn, "_v")), rows.schema)

    for pieces in parts:
        # a piece of this level lies wholly in one piece of the next if the next number divides this one
        current = gathered(current.select(*keys, "_v", F.pmod("_h", F.lit(int(pieces))).alias("_h")), [*keys, "_h"])
    return gathered(current.select(*keys, "_v"), keys).withColumnRenamed("_v", name)
