"""Exact duplicates by sorting content."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelfold.llm.shared import SPACES, cut_lineage

# Characters of a text that take part in splitters; the rest of the order is a hash of the whole text.
HEAD = 64


def normalised(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"{SPACES}+", " ")


def _sorted(docs: DataFrame, id_col: str, text_col: str, carry: bool) -> DataFrame:
    """Rows in content order: equal texts adjacent, the smallest identifier first, null identifiers last.

    Splitters are sampled from (first characters, hash of the whole text,
    identifier), so they stay small whatever the length of the texts, and a
    group of copies of any size is cut between partitions.
    """
    body = F.struct(F.struct("*").alias("row")) if carry else F.struct(normalised(text_col).alias("norm"))
    keyed = docs.select(
        body.alias("body"), F.substring(normalised(text_col), 1, HEAD).alias("head"),
        F.xxhash64(normalised(text_col)).alias("mark"), F.col(id_col).cast("long").alias("id"))
    order = ["head", "mark", F.asc_nulls_last("id")]
    ranged = keyed.repartitionByRange(*order)
    if carry:
        ranged = ranged.select("id", "head", "mark", F.col("body.row").alias("row"),
                               normalised(f"body.row.`{text_col}`").alias("norm"))
    else:
        ranged = ranged.select("id", "head", "mark", "body.norm")
    ordered = ranged.sortWithinPartitions("head", "mark", "norm", F.asc_nulls_last("id"))
    return ordered.select("id", "norm", *(["row"] if carry else []))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], pa.RecordBatch, list[int]]]:
    """Each batch with the offsets at which its text differs from the row before."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        norm = batch.column(batch.schema.get_field_index("norm"))
        starts = []
        if last is None or norm[0].as_py() != last:
            starts.append(0)
        if batch.num_rows > 1:
            differs = pc.not_equal(norm.slice(1), norm.slice(0, batch.num_rows - 1))
            starts += [int(i) + 1 for i in pc.indices_nonzero(differs).to_pylist()]
        last = norm[batch.num_rows - 1].as_py()
        yield [norm[i].as_py() for i in starts], batch, starts


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row its run's smallest identifier, size and digest; ``edge`` marks runs that may go on in another partition."""
    part = TaskContext.get().partitionId()
    names = ["id", "keep", "size", "first", "edge", "part", "sha"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.string()]

    def emit(runs, ends):
        ids, keep, size, first, edge, sha = [], [], [], [], [], []
        for text_sha, members, at_start in runs:
            n = len(members)
            ids += members
            keep += [members[0]] * n
            size += [n] * n
            first += [True] + [False] * (n - 1)
            edge += [at_start or ends] * n
            sha += [text_sha] * n
        columns = [ids, keep, size, first, edge, [part] * len(ids), sha]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    open_run, n = None, 0
    for texts, batch, starts in _runs(batches):
        ids = batch.column(batch.schema.get_field_index("id")).to_pylist()
        closed = []
        if not starts or starts[0] > 0:
            open_run[1].extend(ids[:starts[0]] if starts else ids)
        for i, (text, begin) in enumerate(zip(texts, starts, strict=True)):
            if open_run is not None:
                closed.append(open_run)
            end = starts[i + 1] if i + 1 < len(starts) else len(ids)
            open_run = (_digest(text), ids[begin:end], n == 0)
            n += 1
        if closed:
            yield emit(closed, False)
    if open_run is not None:
        yield emit([open_run], True)


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: (id, keep_id, group_size, kept, text_sha256).

    Texts are equal when they are identical after every run of ASCII white space
    became one space; null counts as empty.  Sampled splitters partition the
    normalised text by range, Spark's external sort puts equals next to each
    other, and neighbours are compared in full.  Of a group the smallest
    identifier stays (null only if all are null); of rows that repeat it, the
    first.  A group that crosses partitions is completed from the runs at
    partition edges, two a partition.  An empty table gives an empty result.
    Other columns are not looked at.
    """
    schema = "id long, keep long, size long, first boolean, edge boolean, part int, sha string"
    rows = cut_lineage(_sorted(docs, id_col, text_col, carry=False).mapInArrow(_decide, schema))
    kept = F.col("first")
    alone = rows.where("not edge").select(
        "id", F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), kept.alias("kept"), "sha")
    crossing = (rows.where("edge and first").groupBy("sha")
                .agg(F.min("keep").alias("keep_id"), F.sum("size").alias("group_size"),
                     F.min_by("part", F.struct(F.col("keep").isNull(), "keep", "part")).alias("home")))
    # at most two rows per partition of the sort
    edges = rows.where("edge").join(F.broadcast(crossing), "sha").select(
        "id", "keep_id", "group_size", (kept & (F.col("part") == F.col("home"))).alias("kept"), "sha")
    return alone.union(edges).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of every run."""
    part = TaskContext.get().partitionId()
    held = None

    def emit(row, id_, sha, edge):
        n = len(id_)
        return pa.RecordBatch.from_arrays(
            [row, id_, pa.array(sha, pa.string()), pa.array(edge, pa.bool_()), pa.array([part] * n, pa.int32())],
            names=["row", "id", "sha", "edge", "part"])

    n = 0
    for texts, batch, starts in _runs(batches):
        if not starts:
            continue
        at = pa.array(starts, pa.int64())
        row = batch.column(batch.schema.get_field_index("row")).take(at)
        ids = batch.column(batch.schema.get_field_index("id")).take(at)
        shas = [_digest(t) for t in texts]
        if held is not None:
            yield emit(*held[:3], held[3])
        # the last run of the batch may be the last of the partition: hold it back
        cut = len(starts) - 1
        if cut:
            yield emit(row.slice(0, cut), ids.slice(0, cut), shas[:cut], [n == 0 and i == 0 for i in range(cut)])
        held = (row.slice(cut), ids.slice(cut), shas[cut:], [n == 0 and cut == 0])
        n += len(starts)
    if held is not None:
        yield emit(*held[:3], [True])


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``mark_copies`` keeps, with their columns.

    Whole rows travel through the sort; heads of runs are written to the shared
    folder once, and only those at partition edges are compared again.
    """
    ordered = _sorted(docs, id_col, text_col, carry=True)
    schema = T.StructType([ordered.schema["row"]]).add("id", "long").add("sha", "string").add("edge", "boolean").add("part", "integer")
    heads = cut_lineage(ordered.mapInArrow(_heads, schema))
    first = (heads.where("edge").groupBy("sha")
             .agg(F.min_by("part", F.struct(F.col("id").isNull(), "id", "part")).alias("home")))
    again = heads.join(F.broadcast(first.withColumn("edge", F.lit(True))), ["sha", "edge"], "left")
    return again.where("not edge or part = home").select("row.*")
