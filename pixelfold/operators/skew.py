"""Helpers that keep hot groups spread over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 32
# Counting cells to a doubling of the value.
CELLS = 4096


def attach(df: DataFrame, facts: DataFrame, keys, spread, how="left", salts=SALTS) -> DataFrame:
    """Join one row per key of ``facts`` to every row of ``df``.

    ``facts`` is copied once per salt and ``df`` takes its salt from the
    columns in ``spread`` and the input partition (so that copies of one row
    spread as well).  A key that holds a large share of ``df`` is joined by
    ``salts`` tasks; adaptive execution splits further, and turns the join into
    a broadcast when ``facts`` measures small.  No hint is given because the
    number of keys grows with the data.
    """
    salted = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.hash(F.spark_partition_id(), *spread), F.lit(salts))
    return df.withColumn("_salt", salt).join(salted, [*keys, "_salt"], how).drop("_salt")


def _octave_cell(v: Column) -> Column:
    """Cells in the order of the values, ``CELLS`` to a doubling, whatever the scale of the values."""
    far = F.lit(1100 * CELLS)  # beyond the exponents of all finite values
    cell = F.floor(F.log2(F.abs(v)) * CELLS) + far
    return (F.when(F.isnan(v), F.lit(4) * far).when(v == 0, F.lit(0))
            .when(F.abs(v) == float("inf"), F.signum(v) * 3 * far).otherwise(F.signum(v) * cell).cast("long"))


def grouped_percentile(df: DataFrame, keys, value: str, p: float, name: str, buckets: int = 1 << 20) -> DataFrame:
    """Exact linear-interpolated percentile per key for groups of any size.

    Counts are combined before every shuffle, no value travels by itself.  First
    values are counted in cells of equal ratio, so outliers of any size do not
    widen the cell in which the wanted rank falls; then that cell's values are
    counted in ``buckets`` equal parts, and at last by value.  A double has 52
    bits below its exponent: with the default, at most some 10 ** 6 different
    values are left for the last step, whatever the size of the group.  NULLs do
    not count, NaN is the largest value.
    """
    keys = list(keys)
    v = F.col("_v")
    values = df.select(*keys, F.col(value).cast("double").alias("_v")).where(v.isNotNull())
    order = Window.partitionBy(*keys).orderBy("_slot")
    before = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hit = (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_n"))
    carried = ("_rank", "_frac", "_after")

    def counted(rows: DataFrame, slot: Column) -> DataFrame:
        known = [F.first(c).alias(c) for c in carried if c in rows.columns]
        cells = rows.groupBy(*keys, slot.alias("_slot")).agg(
            F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), *known)
        return cells.withColumns({"_before": before, "_next": F.lead("_lo").over(order)})

    position = F.lit(float(p)) * (F.sum("_n").over(Window.partitionBy(*keys)) - 1)
    first = counted(values, _octave_cell(v)).withColumns({
        "_rank": F.floor(position), "_frac": position - F.floor(position), "_after": F.lit(None).cast("double")})

    def focus(cells: DataFrame) -> DataFrame:
        return cells.where(hit).select(
            *keys, "_lo", "_hi", (F.col("_rank") - F.col("_before")).alias("_rank"), "_frac",
            F.coalesce("_next", "_after").alias("_after"))

    def inside(cells: DataFrame) -> DataFrame:
        return attach(values, focus(cells), keys, ["_v"], "inner").where(v.between(F.col("_lo"), F.col("_hi")))

    share = (v - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    part = F.least(F.lit(buckets - 1), F.coalesce(F.floor(share * buckets), F.lit(0))).cast("int")
    last = counted(inside(counted(inside(first), part)), v)
    following = F.coalesce(F.col("_next"), F.col("_after"), F.col("_lo"))
    high = F.when(F.col("_rank") + 1 < F.col("_before") + F.col("_n"), F.col("_lo")).otherwise(following)
    return last.where(hit).select(*keys, (F.col("_lo") + F.col("_frac") * (high - F.col("_lo"))).alias(name))
