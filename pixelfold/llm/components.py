"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelfold.llm.shared import cut_lineage, flipped


def _star(neighbours: DataFrame, keep_larger: bool) -> DataFrame:
    """Move the neighbours of every node to the smallest of them.

    ``neighbours`` has (x, y).  The minimum is combined before the shuffle; the
    join may be split by adaptive execution where a node has very many
    neighbours.
    """
    kind = neighbours.schema["x"].dataType
    least = neighbours.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
    least = least.select(flipped("x", kind).alias("k"), "m")
    joined = neighbours.withColumn("k", flipped("x", kind)).join(least, "k")
    if keep_larger:
        return joined.where(F.col("y") > F.col("x")).select(F.col("y").alias("x"), F.col("m").alias("y"))
    return joined.select(F.col("y").alias("x"), F.col("m").alias("y")).union(
        joined.select("x", F.col("m").alias("y")))


def _seal(edges: DataFrame) -> tuple[DataFrame, tuple]:
    edges = cut_lineage(edges.where(F.col("x") != F.col("y")).dropDuplicates(["x", "y"]))
    mark = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("x", "y"))).first()
    return edges, tuple(mark)


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its smallest node.

    Nodes are integers or strings.  Edges with a null end and loops are
    ignored; repeated edges count once; no edges give no rows.  Each round is a
    large star followed by a small star and is written to the shared folder;
    rounds end when nothing changes, after a number that grows with the
    logarithm of the number of nodes.
    """
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    current, mark = _seal(ends.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")))
    while mark[0]:
        both = current.union(current.select(F.col("y").alias("x"), F.col("x").alias("y")))
        large = _star(both, keep_larger=True).dropDuplicates(["x", "y"])
        after, new = _seal(_star(large, keep_larger=False))
        current = after
        if new == mark:
            break
        mark = new
    roots = current.select(F.col("y").alias("node")).distinct()
    return current.select(F.col("x").alias("node"), F.col("y").alias("component")).union(
        roots.select("node", F.col("node").alias("component")))
