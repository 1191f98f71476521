"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelfold.llm.components import connected_components
from pixelfold.llm.shared import cut_lineage, flipped, row_key

BITS = 64
SEED = 42
# Buckets up to this size compare their members directly.
SMALL_BUCKET = 32
# Shingles counted at a time, so that a very long text needs little memory.
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash over the word shingles of a text, as an unsigned number; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, SEED) for g in grams), dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[i:i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), shingle) for t in batch.column(2)]
            signed = np.array(prints, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(signed)], names=["id", "key", "fp"])
    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, key, fp): fp is the fingerprint as a signed long, key names the row by identifier and text."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("key"),
                       F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints(shingle), "id long, key string, fp long")


def covering_masks(radius: int) -> list[int]:
    """Masks such that any ``radius`` bits are all left out by at least one of them.

    Every bit position gets a nonzero vector over GF(2) of ``radius`` + 1
    entries; the mask of a nonzero vector v keeps the positions whose vector has
    an odd product with v.  ``radius`` vectors never span the whole space, so
    some v is orthogonal to all of them.
    """
    vectors = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(BITS) if (v & (i % vectors + 1)).bit_count() % 2) for v in range(1, vectors + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _pairs(buckets: DataFrame, radius: int) -> DataFrame:
    """Pairs of each bucket's ``members`` within the radius; buckets have a bounded size."""
    one = buckets.select("members", F.explode("members").alias("x"))
    near = F.filter("members", lambda y: (y > F.col("x")) & (F.bit_count(y.bitwiseXOR(F.col("x"))) <= radius))
    return one.select("x", F.explode(near).alias("y"))


def _balls(members: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """Buckets around every value within half the radius of a member, differing where the mask is blind.

    Two fingerprints are within the radius exactly if such balls meet, and a
    ball holds a bounded number of different fingerprints however many share the
    mask.
    """
    flips = [F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(BITS) if not m >> i & 1]) for m in masks]
    blind = F.element_at(F.array(*flips), F.col("t") + 1)
    out = members.select("t", "bucket", "fp", F.col("fp").alias("near"))
    for _ in range((radius + 1) // 2):
        step = out.select("t", "bucket", "fp", "near", F.explode(blind).alias("flip"))
        out = step.select("t", "bucket", "fp", F.col("near").bitwiseXOR(F.col("flip")).alias("near")).distinct()
    return out.groupBy("t", "bucket", "near").agg(F.collect_set("fp").alias("members")).where(F.size("members") > 1)


def links(prints: DataFrame, radius: int = 2, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """Pairs (x, y), x < y, of different fingerprints at most ``radius`` bits apart; ``prints`` has distinct fp.

    No pair is missed: every pair within the radius shares a bucket of some
    mask.  Buckets are counted first; those above ``small_bucket`` are split
    further by balls instead of being compared pair by pair.
    """
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bucket"))
                       for t, m in enumerate(masks)])
    keys = prints.select("fp", F.explode(tables).alias("b")).select("fp", "b.t", "b.bucket")
    sizes = keys.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = sizes.select("t", F.bitwise_not("bucket").alias("k"), "n")
    shared = cut_lineage(keys.withColumn("k", F.bitwise_not("bucket")).join(sizes, ["t", "k"]).select("t", "bucket", "fp", "n"))
    small = shared.where(F.col("n") <= small_bucket).groupBy("t", "bucket").agg(F.collect_list("fp").alias("members"))
    pairs = _pairs(small, radius).union(_pairs(_balls(shared.where(F.col("n") > small_bucket), masks, radius), radius))
    return pairs.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    radius: int = 2) -> DataFrame:
    """One row per row: (id, key, fp, component_id, kept).

    Words are runs without ASCII white space, lower-cased in A-Z.  A text of
    fewer words than a shingle is one shingle; without words, or null, its
    fingerprint is 0 and links like any other.  Rows of equal fingerprint are one
    class; links join different classes.  ``component_id`` is the smallest
    identifier reachable (null only if all are null).  Of a component the rows
    of its smallest identifier, and of these the smallest ``key``, are kept, so
    only rows equal in identifier and text stay together.  An empty table gives
    an empty result.  Other columns are not looked at.
    """
    rows = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    first = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("key").alias("key"))
    classes = cut_lineage(rows.groupBy("fp").agg(F.min(first).alias("least")))
    reach = connected_components(links(classes.select("fp"), radius), "x", "y")
    rooted = (classes.join(reach.withColumnRenamed("node", "fp"), "fp", "left")
              .select("fp", "least", F.coalesce("component", "fp").alias("root")))
    # components of one class, the rule, need no further exchange of their own
    best = rooted.groupBy("root").agg(F.min("least").alias("best"))
    kind = rows.schema["fp"].dataType
    named = (rooted.select("fp", flipped("root", kind).alias("k"))
             .join(best.select(flipped("root", kind).alias("k"), "best"), "k")
             .select(flipped("fp", kind).alias("k"), "best"))
    return rows.withColumn("k", flipped("fp", kind)).join(named, "k").select(
        F.col("id").alias(id_col), "key", "fp", F.col("best.id").alias("component_id"),
        (F.col("key") == F.col("best.key")).alias("kept"))


def hexadecimal(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                         radius: int = 2) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with their columns."""
    kept = near_duplicates(docs, id_col, text_col, shingle, radius).where("kept").select("key").distinct()
    rows = docs.select(F.struct("*").alias("row"), row_key(id_col, text_col).alias("key"))
    return rows.join(kept, "key", "left_semi").select("row.*")
