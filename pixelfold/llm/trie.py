"""Prefix trie of conversations over sorted shards, joined by the skeleton of their splitters."""

from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelfold.llm.shared import cut_lineage

# Bytes of a turn's digest; a path is the digests of its turns one after another, so paths sort with their prefixes together.
STEP = 16
# Conversations a shard holds at most, about; and sampled paths a shard.
SHARD_ROWS = 50_000
SAMPLED = 16
# Turns of a sampled path that are looked at.  Splitters, and with them the skeleton, are no deeper, whatever the data.
DEEP = 256
# Rows a local shard hands over at a time.
BATCH = 10_000

NODES = ("conv_id long, depth long, parent_conv_id long, parent int, node int, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, ends string, chars long, shard int")
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(),
          pa.int64(), pa.int32()]
_NAMES = [field.split()[0] for field in NODES.split(", ")]
_LAST = 1 << 63


def turn_lists(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
               text_col: str = "text") -> DataFrame:
    """(conv_id, digests, chars): per conversation a digest and the code points of the text for each turn, in order.

    Texts stay where they are; 32 hexadecimal digits of a SHA-256 travel.  Turns
    are ordered by number, null first, ties by digest; null roles and texts are
    empty; rows without a conversation belong to none and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * STEP)
    turn = F.struct(F.col(turn_col).isNotNull().alias("known"), F.col(turn_col).cast("long").alias("turn"),
                    digest.alias("digest"), F.char_length(text).alias("chars"))
    held = (turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), turn.alias("t"))
            .groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns")))
    return held.select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.chars").alias("chars"))


def grafted(lists: DataFrame, family: int = 100, most: int = 6) -> DataFrame:
    """Every conversation rebuilt on its family's first member, conv_id - conv_id % family.

    The first h turns come from there (all if it has fewer, none if there is no
    such conversation), then follow the own turns after the first h; h is the
    CRC-32 of the decimal conv_id modulo ``most``.
    """
    base = F.col("conv_id") - F.col("conv_id") % family
    heads = lists.where(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("base"), *[F.slice(c, 1, most - 1).alias(f"base_{c}") for c in ("digests", "chars")])
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    own = lists.select("*", base.alias("base"), h.alias("h"))

    def graft(c: str, kind: str) -> Column:
        head = F.coalesce(F.slice(f"base_{c}", F.lit(1), F.col("h")), F.array().cast(kind))
        return F.concat(head, F.slice(c, F.col("h") + 1, F.size(c))).alias(c)

    return own.join(heads, "base", "left").select("conv_id", graft("digests", "array<string>"), graft("chars", "array<int>"))


class Skeleton:
    """The prefixes that may lie in more than one shard: those of the splitters.  Node 0 is the root."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.splitters = splitters
        self.parent, self.depth, self.children = [-1], [0], [0]
        self.steps: dict[tuple[int, bytes], int] = {}
        for path, _ in splitters:
            at = 0
            for i in range(0, len(path), STEP):
                at = self._step(at, path[i:i + STEP])

    def _step(self, at: int, digest: bytes) -> int:
        found = self.steps.get((at, digest))
        if found is None:
            found = self.steps[at, digest] = len(self.parent)
            self.parent.append(at)
            self.depth.append(self.depth[at] + 1)
            self.children.append(0)
            self.children[at] += 1
        return found

    def shard(self, path: bytes, conv: int) -> int:
        return bisect.bisect_right(self.splitters, (path, conv))


def splitters(sample: list[tuple[bytes, int]], shards: int) -> list[tuple[bytes, int]]:
    """At most ``shards`` - 1 splitters of (path, conv_id), each cut to the shortest prefix that still parts its neighbours.

    Copies of one path are parted by identifier.
    """
    sample = sorted(set(sample))
    found = []
    for k in range(1, shards):
        at = k * len(sample) // shards
        if at == 0:
            continue
        (before, _), (path, conv) = sample[at - 1], sample[at]
        if before == path:
            cut = (path, conv)
        else:
            n = 0
            while before[n:n + STEP] == path[n:n + STEP]:
                n += STEP
            cut = (path[:n + STEP], -_LAST)
        if not found or found[-1] < cut:
            found.append(cut)
    return found


class _Node:
    __slots__ = ("chars", "children", "depth", "ends", "first", "leaves", "n", "pending", "saved", "skeleton")

    def __init__(self, depth: int, chars: int, skeleton: int):
        self.depth, self.chars, self.skeleton = depth, chars, skeleton
        self.n = self.children = self.leaves = self.saved = 0
        self.first = _LAST
        self.ends: list[str] = []
        # direct children that wait for this node's smallest member
        self.pending: list[list] = []


class _Shard:
    """Closes the nodes of sorted paths one by one; holds the open path and the direct children of its nodes."""

    def __init__(self, skeleton: Skeleton, shard: int):
        self.skeleton, self.shard = skeleton, shard
        self.open = [_Node(0, 0, 0)]
        self.path: list[bytes] = []
        self.rows: list[list] = []

    def add(self, conv: int, path: bytes, chars: list[int]) -> None:
        steps = [path[i:i + STEP] for i in range(0, len(path), STEP)]
        same = 0
        for a, b in zip(self.path, steps, strict=False):
            if a != b:
                break
            same += 1
        self.close(same)
        for d in range(same, len(steps)):
            top = self.open[-1].skeleton
            known = self.skeleton.steps.get((top, steps[d]), -1) if top >= 0 else -1
            self.open.append(_Node(d + 1, chars[d], known))
        self.path = steps
        node = self.open[-1]
        node.n += 1
        node.first = min(node.first, conv)
        node.ends.append(str(conv))

    def close(self, depth: int) -> None:
        """Close all open nodes below ``depth``; -1 closes the root too."""
        while len(self.open) > depth + 1:
            node = self.open.pop()
            above = self.open[-1] if self.open else None
            for row in node.pending:
                row[2] = node.first
                self.rows.append(row)
            ends = ",".join(node.ends)
            if node.skeleton >= 0:
                # a part of a node that other shards may share
                self.rows.append([node.first, node.depth, None, None, node.skeleton, node.n, node.children, node.leaves, node.saved,
                                  ends, node.chars, self.shard])
            else:
                leaves = node.leaves or 1
                saved = node.saved + (node.n - 1) * node.chars
                row = [node.first, node.depth, None, None, None, node.n, node.children, leaves, saved,
                       hashlib.sha256(ends.encode()).hexdigest(), node.chars, self.shard]
                above.children += 1
                above.leaves += leaves
                above.saved += saved
                if above.skeleton >= 0:
                    row[3] = above.skeleton
                    self.rows.append(row)
                else:
                    above.pending.append(row)
            if above is not None:
                above.n += node.n
                above.first = min(above.first, node.first)

    def taken(self, least: int) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            columns = zip(*self.rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=_NAMES)
            self.rows = []


def _assign(skeleton):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = [skeleton.value.shard(p, c) for c, p in zip(batch["conv_id"].to_pylist(), batch["path"].to_pylist(), strict=True)]
            yield batch.append_column("shard", pa.array(where, pa.int32()))
    return run


def _build(skeleton):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = None
        for batch in batches:
            for conv, path, chars, shard in zip(*(batch[c].to_pylist() for c in ("conv_id", "path", "chars", "shard")), strict=True):
                if local is None or local.shard != shard:
                    if local is not None:
                        local.close(-1)
                        yield from local.taken(1)
                    local = _Shard(skeleton.value, shard)
                local.add(conv, path, chars)
                yield from local.taken(BATCH)
        if local is not None:
            local.close(-1)
            yield from local.taken(1)
    return run


def _digest_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest a node over its shards' identifiers, which arrive in order."""
    node, digest, done = None, None, []

    def emit():
        return pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.int32()), pa.array([d for _, d in done], pa.string())],
                                          names=["node", "sha"])

    for batch in batches:
        for n, ends in zip(batch["node"].to_pylist(), batch["ends"].to_pylist(), strict=True):
            if n != node:
                if node is not None:
                    done.append((node, digest.hexdigest()))
                node, digest = n, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ends.encode())
    if node is not None:
        done.append((node, digest.hexdigest()))
    if done:
        yield emit()


def _finished(skeleton: Skeleton, parts: list) -> list[tuple]:
    """Skeleton nodes from the sums of their parts, children before parents: (node, conv_id, depth, parent's conv_id, ...)."""
    m = len(skeleton.parent)
    leaves, saved = [0] * m, [0] * m
    own = {r["node"]: r for r in parts}
    for node in range(m - 1, -1, -1):
        r = own[node]
        leaves[node] += r["n_leaves"]
        saved[node] += r["saved_tokens"] + (r["n_convs"] - 1) * r["chars"]
        if not r["n_children"] + skeleton.children[node]:
            leaves[node] = 1
        if node:
            leaves[skeleton.parent[node]] += leaves[node]
            saved[skeleton.parent[node]] += saved[node]
    return [(n, own[n]["conv_id"], skeleton.depth[n], own[skeleton.parent[n]]["conv_id"] if n else None, own[n]["n_convs"],
             own[n]["n_children"] + skeleton.children[n], leaves[n], saved[n]) for n in range(m)]


def prefix_trie(lists: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row a node of the trie over (conv_id, digests, chars), as ``turn_lists`` gives them, one row a conversation.

    Returns (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256): a node's smallest member, its depth (0: root),
    the smallest member of its parent (root: null), members, children, childless
    nodes in its subtree, the sum over its subtree of (members - 1) times the
    code points of the last text, and the SHA-256 of the members that end
    there, ascending, comma-joined.

    Splitters sampled from all paths range-partition (path, conv_id), so copies
    of one path, however many, are dealt over shards.  The trie of the splitters
    is broadcast: only its nodes can reach over a shard's end.  A sorted shard
    closes every other node by itself and hands over sums of its part of skeleton
    nodes, which are added up.  The skeleton has at most DEEP nodes for each
    splitter, SAMPLED paths a shard are drawn, and the driver holds no more.
    An empty table has no nodes, not even a root.
    """
    spark: SparkSession = lists.sparkSession
    path = F.unhex(F.array_join("digests", "")).alias("path")
    paths = cut_lineage(lists.select("conv_id", path, "chars"))
    total = paths.count()
    shards = max(math.ceil(total / shard_rows), int(spark.conf.get("spark.sql.shuffle.partitions")))
    # a bounded share of all rows, chosen by hash: reruns draw the same
    share = min(1.0, shards * SAMPLED / max(total, 1))
    drawn = paths.where(F.pmod(F.xxhash64("conv_id"), F.lit(1 << 30)) < math.ceil(share * (1 << 30)))
    sample = drawn.select(F.substring("path", 1, DEEP * STEP).alias("path"), "conv_id").collect()
    frame = Skeleton(splitters([(bytes(r["path"]), r["conv_id"]) for r in sample], shards))
    skeleton = spark.sparkContext.broadcast(frame)

    placed = paths.mapInArrow(_assign(skeleton), "conv_id long, path binary, chars array<int>, shard int")
    ordered = placed.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id")
    nodes = cut_lineage(ordered.mapInArrow(_build(skeleton), NODES))

    parts = nodes.where("node is not null").groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    # as many rows as the skeleton has nodes
    rows = _finished(frame, parts.collect()) if total else []
    done = spark.createDataFrame(rows, "node int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
                                       "n_leaves long, saved_tokens long")
    chunks = nodes.where("node is not null and ends != ''").select("node", "shard", "ends")
    ends = chunks.repartition("node").sortWithinPartitions("node", "shard").mapInArrow(_digest_ends, "node int, sha string")

    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    above = F.broadcast(done.select(F.col("node").alias("parent"), F.col("conv_id").alias("above")))
    local = nodes.where("node is null").join(above, "parent", "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "above").alias("parent_conv_id"), *columns[3:], F.col("ends").alias("ends_sha256"))
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return local.union(F.broadcast(done).join(ends, "node", "left").select(*columns, F.coalesce("sha", nothing).alias("ends_sha256")))
