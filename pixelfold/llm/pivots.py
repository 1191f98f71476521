"""Embedding near-duplicates through an index of pivot permutations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelfold.llm.components import connected_components
from pixelfold.llm.shared import cut_lineage, flipped

THRESHOLD = 0.93
# Reference points, at most.
PIVOTS = 128
# Vectors they are drawn from, at most, and the cosine from which two are too close.
SAMPLE = 2048
APART = 0.7
# Nearest pivots that describe a vector.
PREFIX = 6
# Shared pivots from which a pair is verified.
SHARED = 2
# Rows of a list compared at a time; longer lists are compared block by block.
BLOCK = 1024
# Lists up to this length are compared many at a time, longer ones by matrix products.
SHORT_LIST = 64
# Pairs looked at together.
PAIRS = 1 << 16


def _unit(values: list | None, size: int | None) -> np.ndarray | None:
    """The vector divided by its length in double precision; null for vectors that link with nothing."""
    if values is None or not len(values) or None in values or (size is not None and len(values) != size):
        return None
    v = np.asarray(values, np.float64)
    if not np.isfinite(v).all():
        return None
    peak = np.abs(v).max()
    if peak == 0:
        return None
    v = v / peak
    return v / np.sqrt((v * v).sum())


def _units(id_col: str, vector_col: str, label_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            label = batch.column(names.index(label_col))
            vectors = batch.column(names.index(vector_col)).to_pylist()
            units = [None if no_label else _unit(v, None) for v, no_label in zip(vectors, label.is_null().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(names.index(id_col)), label, pa.array([None if u is None else u.tobytes() for u in units], pa.binary())],
                names=["id", "label", "vec"])
    return run


def choose_pivots(classes: DataFrame, count: int = PIVOTS, sample: int = SAMPLE, apart: float = APART) -> dict[int, np.ndarray]:
    """At most ``count`` reference points far from each other, by number of components.

    They come from at most ``sample`` vectors chosen by hash: the next point is the one
    whose nearest point so far is farthest, until all are nearer than ``apart`` (cosine).
    So a large group of near copies supplies one point, not most of them.
    """
    rows = classes.select("vec", F.length("vec").alias("n")).orderBy(F.xxhash64("vec"), "vec").limit(sample).collect()
    by_size: dict[int, list] = {}
    for r in rows:
        by_size.setdefault(r["n"], []).append(np.frombuffer(bytes(r["vec"])))
    out = {}
    for n, vectors in by_size.items():
        drawn = np.array(vectors)
        chosen, nearest = [0], drawn @ drawn[0]
        while len(chosen) < count and nearest.min() < apart:
            chosen.append(int(nearest.argmin()))
            nearest = np.maximum(nearest, drawn @ drawn[chosen[-1]])
        out[n] = drawn[chosen]
    return out


def permutation(unit: np.ndarray, pivots: np.ndarray, prefix: int = PREFIX) -> np.ndarray:
    """Numbers of the nearest pivots, nearest first; one row a vector."""
    near = unit @ pivots.T
    return np.argsort(-near, axis=1, kind="stable")[:, :prefix]


def _entries(pivots: dict[int, np.ndarray], prefix: int):
    """Entries of the inverted lists: one for every two of a vector's nearest pivots, which ``near`` holds in number order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column(batch.schema.names.index("vec"))
            sizes = np.array([len(v.as_py()) for v in vecs], np.int64)
            rows, a, b, near = [], [], [], []
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                unit = np.frombuffer(b"".join(vecs[int(i)].as_py() for i in at)).reshape(len(at), -1)
                # vectors of a size that no pivot has share one list
                order = permutation(unit, pivots.get(int(n), np.zeros((1, unit.shape[1]))), prefix)
                ranked = np.full((len(at), prefix), -1, np.int16)
                ranked[:, :order.shape[1]] = np.sort(order, axis=1)
                used = order.shape[1]
                for i, j in [(0, 0)] if used == 1 else [(i, j) for i in range(used) for j in range(i + 1, used)]:
                    rows.append(at)
                    a.append(ranked[:, i])
                    b.append(ranked[:, j])
                    near.append(ranked)
            if not rows:
                continue
            take = pa.array(np.concatenate(rows))
            out = [batch.column(batch.schema.names.index(c)).take(take) for c in ("label", "id", "copies", "vec")]
            near_bytes = np.ascontiguousarray(np.concatenate(near), "<i2").tobytes()
            near_column = pa.Array.from_buffers(
                pa.binary(2 * prefix), len(take), [None, pa.py_buffer(near_bytes)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*out, pa.array(np.concatenate(a).astype(np.int32)), pa.array(np.concatenate(b).astype(np.int32)), near_column],
                names=["label", "id", "copies", "vec", "a", "b", "near"])
    return run


def _counts_here(near_x: np.ndarray, near_y: np.ndarray, a: np.ndarray, b: np.ndarray, shared: int) -> np.ndarray:
    """Whether pairs share enough pivots and their two smallest common pivots are those of the list."""
    common = ((near_x[:, :, None] == near_y[:, None, :]) & (near_x >= 0)[:, :, None]).any(axis=2)
    enough = common.sum(axis=1) >= np.minimum(shared, (near_x >= 0).sum(axis=1))
    return enough & ((common & (near_x < b[:, None])).sum(axis=1) == (a < b))


def _short_lists(starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs inside lists, by their distance."""
    for d in range(1, int(lengths.max(initial=0))):
        has = lengths > d
        count = lengths[has] - d
        left = np.repeat(starts[has] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        for i in range(0, len(left), PAIRS):
            yield left[i:i + PAIRS], left[i:i + PAIRS] + d


def link_lists(rows: dict[str, np.ndarray], starts: np.ndarray, threshold: float, shared: int = SHARED) -> dict[str, np.ndarray]:
    """Verified links inside lists: (id, links, root), links weighted with copies, root connected in the same list.

    ``rows`` has id, copies, vec (units), near, a, b, i, j, own; a list begins at every
    of ``starts``.  In a meeting of two blocks only pairs across them count.  A pair
    counts in the list of its two smallest common pivots, so only once.
    """
    n = len(rows["id"])
    lengths = np.diff(np.append(starts, n))
    short = lengths <= SHORT_LIST
    found = []

    def verified(x, y):
        keep = (rows["own"][x] != rows["own"][y]) | (rows["i"][x] == rows["j"][x])
        x, y = x[keep], y[keep]
        keep = _counts_here(rows["near"][x], rows["near"][y], rows["a"][x], rows["b"][x], shared)
        x, y = x[keep], y[keep]
        keep = np.einsum("ij,ij->i", rows["vec"][x], rows["vec"][y]) >= threshold
        return x[keep], y[keep]

    for x, y in _short_lists(starts[short], lengths[short]):
        found.append(verified(x, y))
    for start, length in zip(starts[~short], lengths[~short], strict=True):
        for i in range(start, start + length, SHORT_LIST):
            # vectors above the threshold first: one matrix product for a stripe of the list
            stripe = slice(i, min(i + SHORT_LIST, start + length))
            near = np.argwhere(rows["vec"][stripe] @ rows["vec"][i:start + length].T >= threshold - 1e-9)
            near = near[near[:, 0] < near[:, 1]] + i
            for k in range(0, len(near), PAIRS):
                found.append(verified(near[k:k + PAIRS, 0], near[k:k + PAIRS, 1]))
    x, y = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    links = np.bincount(x, rows["copies"][y], n) + np.bincount(y, rows["copies"][x], n)
    root = np.arange(n)
    while True:
        before = root
        least = np.minimum(root[x], root[y])
        root = root.copy()
        np.minimum.at(root, x, least)
        np.minimum.at(root, y, least)
        root = root[root]
        if (root == before).all():
            break
    at = np.flatnonzero(links)
    return {"id": rows["id"][at], "links": links[at].astype(np.int64), "root": rows["id"][root[at]]}


def _verify(threshold: float, width: int):
    """Lists of rows sorted by list; the rows of a list may span batches."""
    keys = ["code", "a", "b", "i", "j"]

    def arrays(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        column = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
        out = {n: column[n].to_numpy(zero_copy_only=False) for n in [*keys, "id", "copies", "own"]}
        out["near"] = np.frombuffer(b"".join(column["near"].to_pylist()), "<i2").reshape(-1, width)
        out["vec"] = column["vec"].to_pylist()
        return out

    def solve(rows: dict) -> pa.RecordBatch:
        changes = np.zeros(len(rows["id"]) - 1, bool)
        for k in keys:
            changes |= rows[k][1:] != rows[k][:-1]
        starts = np.append(0, np.flatnonzero(changes) + 1)
        out = []
        # all vectors of a list have one size, so one matrix holds a run of lists
        size = np.array([len(v) for v in rows["vec"]])
        cuts = [0, *(starts[np.flatnonzero(np.diff(size[starts])) + 1]).tolist(), len(size)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = {k: rows[k][a:b] for k in rows if k != "vec"}
            part["vec"] = np.frombuffer(b"".join(rows["vec"][a:b])).reshape(b - a, -1)
            out.append(link_lists(part, starts[(starts >= a) & (starts < b)] - a, threshold))
        return pa.RecordBatch.from_pydict({k: np.concatenate([o[k] for o in out]) for k in ("id", "links", "root")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = arrays(batch)
            if held is not None:
                rows = {k: held[k] + rows[k] if k == "vec" else np.concatenate([held[k], rows[k]]) for k in rows}
            n = len(rows["id"])
            # hold the last list back until its end is seen
            open_ = np.ones(n, bool)
            for k in keys:
                open_ &= rows[k] == rows[k][-1]
            at = n - int(open_.sum())
            held = {k: rows[k][at:] for k in rows}
            if at:
                yield solve({k: rows[k][:at] for k in rows})
        if held is not None:
            yield solve(held)
    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 threshold: float = THRESHOLD, pivots: int = PIVOTS, prefix: int = PREFIX, block: int = BLOCK) -> DataFrame:
    """One row per row: (id, n_links, component_id, kept).

    Only vectors of equal label that is not null are compared, by cosine in double
    precision.  A vector that is null, empty, zero, or holds a null or a number that
    is not finite links with nothing, nor does one without a label.  Vectors of
    different length never link.  Equal vectors (up to a factor) form one class, which
    stands for its copies; classes that share two of their nearest pivots meet in the
    list of these two and are verified there.  Links below the threshold are never
    reported; of those above, the share found is a property of the index (README).
    ``n_links`` counts other rows, ``component_id`` is the smallest identifier
    reachable, ``kept`` holds for it.  A null identifier links with nothing.  Rows that
    repeat an identifier with its vector are copies of each other.  An empty table gives
    an empty result.  Other columns are not looked at.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias(id_col), F.col(label_col), F.col(vector_col).cast("array<double>"))
    label_type = rows.schema[label_col].dataType.simpleString()
    units = cut_lineage(rows.mapInArrow(_units(id_col, vector_col, label_col), f"id long, label {label_type}, vec binary"))
    live = units.where("vec is not null and id is not null").withColumn("sha", F.sha2("vec", 256))
    classes = cut_lineage(live.groupBy("label", "sha").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec")))
    points = choose_pivots(classes, pivots)
    entry = f"label {label_type}, id long, copies long, vec binary, a int, b int, near binary"
    entries = classes.select("label", "id", "copies", "vec").mapInArrow(_entries(points, prefix), entry)
    entries = entries.withColumn("n", F.length("vec"))
    lists = ["label", "n", "a", "b"]
    sizes = entries.groupBy(*lists).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sizes = cut_lineage(sizes.withColumn("blocks", F.ceil(F.col("size") / block).cast("int")).withColumn(
        "code", F.monotonically_increasing_id()))
    placed = entries.join(sizes, lists).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # every two blocks of a list meet once; a row goes to each meeting of its block
    meet = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(
        F.least(F.col("own"), o).alias("i"), F.greatest(F.col("own"), o).alias("j")))
    keys = ["code", "a", "b", "i", "j"]
    dealt = placed.withColumn("m", F.explode(meet)).select(
        "code", "a", "b", F.col("m.i").alias("i"), F.col("m.j").alias("j"), "own", "id", "copies", "vec", "near")
    sorted_lists = dealt.repartition(*keys).sortWithinPartitions(*keys, "id")
    found = cut_lineage(sorted_lists.mapInArrow(_verify(threshold, prefix), "id long, links long, root long"))
    reach = connected_components(found, "id", "root")
    counts = found.groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "rep")
    reach = reach.withColumnRenamed("node", "rep")
    kind = live.schema["sha"].dataType
    named = (classes.select(F.col("id").alias("rep"), "label", "sha", "copies").join(counts, "rep", "left").join(reach, "rep", "left")
             .select("label", flipped("sha", kind).alias("k"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                     F.coalesce("component", "rep").alias("component_id")))
    linked = live.withColumn("k", flipped("sha", kind)).join(named, ["label", "k"]).select(F.col("id"), "n_links", "component_id")
    alone = units.where("vec is null or id is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id",
                                      F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
