"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelfold.llm.budgets import cut_points
from pixelfold.llm.shared import SPACES, cut_lineage

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3


def source_key(source: str) -> Column:
    """Orders by code point, null last; never null."""
    return F.when(F.col(source).isNull(), F.lit("z")).otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))


def words(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(f"[^{SPACES[1:]}+")).cast("long")


def draw(id_col: str, text_col: str) -> Column:
    """60 hash bits of a document's identifier and text."""
    whole = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col), F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(key, source_size, target) from one row (key, source_size) per source.

    Sources in key order get ``weights`` in turn and share the sum of all
    sizes; no target passes ``most`` times its source's size, and what that
    leaves over is shared by weight among the others.  With the sources in order
    of the share at which they fill up, the common share follows from running
    sums, so one pass replaces repeated resharing.  The window spans the
    sources, one row each.
    """
    order = F.row_number().over(Window.orderBy("key")) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (order % len(weights)).cast("int") + 1)
    ranked = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    before = Window.orderBy(F.col("cap") / F.col("weight"), "key").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.col("cap") / F.col("weight"), "key").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    share = ((F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
             / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    shared = ranked.withColumn("share", share)
    fits = F.when(F.col("share") * F.col("weight") <= F.col("cap"), F.col("share"))
    common = F.first(fits, ignorenulls=True).over(every)
    return shared.withColumn("common", common).select(
        "key", "source_size", F.least(F.col("cap").cast("double"), F.col("common") * F.col("weight")).alias("target"))


def mixing_plan(items: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(key, source_size, target, whole, cut), one row per source.

    ``items`` has key, hash, weight and should be cheap to read repeatedly.
    Every document of a source is taken ``whole`` times, and once more if its
    hash is below ``cut`` (null: none).
    """
    plan = targets(items.groupBy("key").agg(F.sum("weight").alias("source_size")), weights, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = cut_lineage(plan.withColumn("whole", F.least(whole, F.lit(most)).cast("long")))
    budgets = plan.select("key", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"))
    # what is left over is below one source's size, so every source with words has a cut
    cuts = cut_points(items, budgets)
    # no document is taken more than ``most`` times, one without words neither
    cut = F.when(F.col("whole") < most, F.col("cut"))
    # written, so that a join with it stands directly on two exchanges and a hot source can be split
    return cut_lineage(plan.join(cuts, "key", "left").select("key", "source_size", "target", "whole", cut.alias("cut")))


def copies() -> Column:
    return (F.col("whole") + F.when(F.col("hash") < F.col("cut"), 1).otherwise(0)).cast("long")


def items_of(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), source_key(source_col).alias("key"),
                       draw(id_col, text_col).alias("hash"), words(text_col).alias("weight"))


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
           weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """How often the mix takes each document: (id, size, source_size, target, copies), one row per row.

    A null text has size 0, a null source is a source of its own, a document
    without words is taken like any other.  Equal rows (identifier and text)
    draw the same number and so are taken equally often.  An empty table gives
    an empty result.  Other columns are not looked at.
    """
    items = cut_lineage(items_of(docs, id_col, text_col, source_col))
    plan = mixing_plan(items.select("key", "hash", "weight"), weights, most)
    return items.join(plan, "key").select(
        F.col("id").alias(id_col), F.col("weight").alias("size"), "source_size", "target", copies().alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as ``assign`` takes it, with their columns."""
    items = cut_lineage(items_of(docs, id_col, text_col, source_col).select("key", "hash", "weight"))
    plan = mixing_plan(items, weights, most).select("key", "whole", "cut")
    carried = docs.select(F.struct("*").alias("row"), source_key(source_col).alias("key"), draw(id_col, text_col).alias("hash"))
    taken = carried.join(plan, "key").withColumn("copies", copies()).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
