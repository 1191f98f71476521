"""Small helpers of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelfold.session import cut_lineage, scratch_path

__all__ = ["SPACES", "cut_lineage", "flipped", "let", "row_key", "scratch_path", "sums_before", "table"]

# The six ASCII white space characters.
SPACES = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def flipped(name: str, kind: T.DataType) -> Column:
    """A one-to-one image of a join key.

    Joining on the image instead of the key gives a side that was grouped by
    the key an exchange of its own, directly below the join, which is what
    adaptive execution needs to split a hot key.
    """
    return F.reverse(F.col(name)) if isinstance(kind, T.StringType) else F.bitwise_not(F.col(name))


def row_key(id_col: str, text_col: str) -> Column:
    """Names a row by its identifier and its text, both of which may be null."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("none")),
                             F.when(F.col(text_col).isNull(), F.lit("null")).otherwise(F.lit("text")),
                             F.coalesce(F.col(text_col), F.lit(""))).cast("binary"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where ``body`` uses it many times or inside of lambdas."""
    return F.transform(F.array(value), body)[0]


def sums_before(sizes: Column, block: int = 256) -> Column:
    """For every entry of an array of longs the sum of those before it.

    Sums are taken within blocks first and then over blocks, so the arrays that
    an aggregate appends to stay short.
    """
    def growing(xs: Column) -> Column:
        start = F.array(F.lit(0).cast("long"))
        return F.aggregate(xs, start, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def joined(inner: Column) -> Column:
        base = growing(F.transform(inner, lambda s: F.element_at(s, -1)))
        return F.flatten(F.zip_with(inner, F.slice(base, 1, F.size(inner)), lambda s, b: F.transform(
            F.slice(s, 1, F.size(s) - 1), lambda v: v + b)))

    def blocks(xs: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int")),
                          lambda k: growing(F.slice(xs, k * block + 1, F.lit(block))))
        return F.when(F.size(xs) > 0, let(cut, joined)).otherwise(xs)

    return let(sizes, blocks)
