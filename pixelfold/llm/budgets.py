"""Selection under a budget by nested histograms of a hash, without sorting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelfold.llm.shared import cut_lineage

HASH_BITS = 60


def cut_points(items: DataFrame, budgets: DataFrame, bits: int = 10) -> DataFrame:
    """(key, cut): taking the items with ``hash`` below ``cut`` spends no more than the key's budget.

    ``items`` has key, hash (long, 60 bits) and weight (long, not negative);
    ``budgets`` has key and budget (number).  The weight is summed by key and
    the first ``bits`` bits of the hash; the bucket in which the budget runs out
    is refined by the next bits, and only its items are read again, until it
    holds a single hash.  Items of equal hash stand or fall together.  A larger
    budget selects a superset.  A key whose items all fit, or that has none, has
    no row.
    """
    if HASH_BITS % bits:
        raise ValueError("bits must divide 60")
    settled = None
    left = budgets.select("key", F.col("budget").cast("double").alias("budget"))
    pool = items.select("key", "hash", "weight")
    for shift in range(HASH_BITS - bits, -1, -bits):
        digit = F.shiftrightunsigned("hash", shift).bitwiseAND((1 << bits) - 1)
        cells = (pool.groupBy("key", digit.alias("digit"))
                 .agg(F.sum("weight").alias("w"), F.min("hash").alias("lo"), F.max("hash").alias("hi")))
        # at most 2 ** bits cells a key
        rows = cells.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("digit", "w", "lo", "hi"))).alias("cells"))
        cell = rows.schema["cells"].dataType.elementType
        state = F.aggregate(
            "cells", F.struct(F.lit(0.0).alias("spent"), F.lit(None).cast(cell).alias("hit")),
            lambda s, c: F.when(s["hit"].isNotNull(), s)
            .when(s["spent"] + c["w"] > F.col("budget"), F.struct(s["spent"].alias("spent"), c.alias("hit")))
            .otherwise(F.struct((s["spent"] + c["w"]).alias("spent"), s["hit"].alias("hit"))))
        open_ = (rows.join(left, "key").select("key", "budget", state.alias("s")).where("s.hit is not null")
                 .select("key", (F.col("budget") - F.col("s.spent")).alias("budget"), "s.hit.digit", "s.hit.lo", "s.hit.hi"))
        open_ = cut_lineage(open_)
        done = open_.where("lo = hi").select("key", F.col("lo").alias("cut"))
        settled = done if settled is None else settled.union(done)
        left = open_.where("lo < hi").select("key", "budget", F.col("digit").alias("at"))
        if left.isEmpty():
            break
        pool = pool.join(left.select("key", "at"), "key").where(digit == F.col("at")).select("key", "hash", "weight")
        pool = cut_lineage(pool)
        left = left.select("key", "budget")
    return settled
