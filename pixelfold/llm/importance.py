"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelfold.llm.budgets import HASH_BITS, cut_points
from pixelfold.llm.shared import cut_lineage
from pixelfold.llm.words import slices, split_words

# Buckets of the hashed models; a model is this many numbers whatever the corpus.
BUCKETS = 1 << 15
# Labelled rows used, at most: half to fit the target model, half to place the cut.
MOST_LABELS = 20_000
# Distinct rank of the repeated word among word shapes.
AGAIN = np.uint64(0x51AFD7ED558CCD)

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


def word_shape(word: str) -> str:
    """Letters and digits by class, other characters as they are, runs shortened to one sign."""
    classes = "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word[:24])
    return re.sub(r"(.)\1+", r"\1+", classes)[:8]


def _hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    own = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
    shape = np.fromiter((xxhash.xxh64_intdigest(word_shape(w), 1) for w in words), np.uint64, len(words))
    return own, shape


def features(own: np.ndarray, shape: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the n-grams of one text: words and pairs of words, shapes, pairs and triples of shapes.

    A word that repeats the one before has a shape of its own, so that mere
    repetition shows whatever is repeated.
    """
    shape = shape.copy()
    shape[1:][own[1:] == own[:-1]] = AGAIN
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    pair = shape[:-1] * _STEP + shape[1:]
    grams = [own * _STEP, (own[:-1] * _STEP + own[1:]) * _MIX, shape * _STEP + _MIX, (pair ^ _MIX) * _MIX,
             (pair[:-1] * _STEP + shape[2:]) * _MIX]
    return (np.concatenate(grams) >> shift).astype(np.int64)


def _texts(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    codes, offsets, words = split_words(batch.column(batch.schema.get_field_index("text")))
    own, shape = _hashes(words.to_pylist())
    for a, b in zip(offsets, offsets[1:], strict=False):
        at = codes[a:b]
        yield features(own[at], shape[at])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task: all texts, and those of the target."""
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in slices(batches, "text"):
        wanted = batch.column(batch.schema.get_field_index("target")).to_pylist()
        for grams, is_target in zip(_texts(batch), wanted, strict=True):
            counts = np.bincount(grams, minlength=BUCKETS)
            raw += counts
            if is_target:
                target += counts
    used = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(raw[used]), pa.array(target[used])],
                                     names=["bucket", "raw", "target"])


@dataclass(frozen=True)
class Model:
    """Log ratio of the two n-gram models by bucket, and the weight from which a document is worth keeping."""

    ratio: np.ndarray
    cut: float = float("-inf")


def _uniform(ids: list[int | None], seed: int) -> np.ndarray:
    """A number in (0, 1) for every identifier, the same wherever it is drawn."""
    drawn = np.fromiter((xxhash.xxh64_intdigest(str(i), seed) for i in ids), np.uint64, len(ids))
    return ((drawn >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def order_code(keys: np.ndarray) -> np.ndarray:
    """60-bit numbers that fall as the keys rise."""
    bits = keys.astype(np.float64).view(np.int64)
    rising = np.where(bits < 0, ~bits, bits | np.int64(-1 << 63)).view(np.uint64)
    return ((~rising) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def _score(ratio: np.ndarray, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            weight = np.fromiter((ratio[g].sum() for g in _texts(batch)), np.float64, batch.num_rows)
            ids = batch.column(batch.schema.get_field_index("id")).to_pylist()
            key = weight - np.log(-np.log(_uniform(ids, seed)))
            rest = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "text"]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(weight), pa.array(key), pa.array(order_code(key))],
                                             names=[*names, "weight", "key", "code"])
    return run


def scored(docs: DataFrame, model: Model, id_col: str, text_col: str, seed: int, *carry) -> DataFrame:
    """Log importance weight, Gumbel key and its order code, beside ``id`` and the carried columns."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *carry)
    schema = T.StructType([f for f in rows.schema.fields if f.name != "text"])
    schema = schema.add("weight", "double").add("key", "double").add("code", "long")
    return rows.mapInArrow(_score(model.ratio, seed), schema)


def sample_labels(labels: DataFrame, most: int = MOST_LABELS, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(id, good, fit): at most ``most`` labelled identifiers, chosen by hash; contradicting labels count as good."""
    clean = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label")).where(
        "id is not null and label is not null")
    one = clean.groupBy("id").agg((F.max("label") > 0).alias("good"))
    draw = F.xxhash64("id")
    return one.select("id", "good", (F.pmod(draw, F.lit(2)) == 0).alias("fit"), draw.alias("draw")).orderBy(
        "draw", "id").limit(most).drop("draw")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        most_labels: int = MOST_LABELS, seed: int = 0) -> Model:
    """Models from the whole corpus (raw) and from good labelled documents (target).

    The raw counts cover every text.  The target model and the cut use at most
    ``most_labels`` labelled rows, one half each; the sample is small enough to
    be broadcast.  The cut separates the weights of the good from the others
    with the fewest errors of both kinds; without both kinds of label nothing
    is rejected.
    """
    sample = cut_lineage(sample_labels(labels, most_labels, label_col=label_col))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    target = rows.join(F.broadcast(sample), "id", "left").select(
        "text", (F.coalesce("good", F.lit(False)) & F.coalesce("fit", F.lit(False))).alias("target"))
    counts = target.mapInArrow(_count, "bucket int, raw long, target long").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()  # BUCKETS rows at most
    raw, good = np.ones(BUCKETS), np.ones(BUCKETS)
    for c in counts:
        raw[c["bucket"]] += c["raw"]
        good[c["bucket"]] += c["target"]
    ratio = np.log(good / good.sum()) - np.log(raw / raw.sum())
    if good.sum() == BUCKETS:
        return Model(np.zeros(BUCKETS))
    model = Model(ratio)
    held = docs.join(F.broadcast(sample.where("not fit").withColumnRenamed("id", "held_id")),
                     F.col(id_col).cast("long") == F.col("held_id"))
    # at most ``most_labels`` identifiers; rows that repeat one have one weight
    seen = scored(held, model, id_col, text_col, seed, "good").groupBy("id", "good").agg(F.max("weight").alias("weight"))
    seen = seen.select("weight", "good").collect()
    return Model(ratio, best_cut(np.array([s["weight"] for s in seen]), np.array([s["good"] for s in seen], bool)))


def best_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """The middle of the gap that best separates good from other weights; of equal gaps the lowest."""
    if not good.any() or good.all():
        return float("-inf")
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    # cutting before position i loses the good below it and keeps the others above it
    lost = np.concatenate([[0], np.cumsum(g)]) / g.sum()
    kept = 1 - np.concatenate([[0], np.cumsum(~g)]) / (~g).sum()
    at = int(np.argmin(lost + kept))
    if at == 0:
        return float("-inf")
    if at == len(w):
        return float(np.nextafter(w[-1], np.inf))
    return float((w[at - 1] + w[at]) / 2)


def _last_code(codes: DataFrame, k: int) -> int | None:
    """The order code below which the ``k`` largest keys lie; null if all do."""
    items = codes.select(F.lit(0).alias("key"), F.col("code").alias("hash"), F.lit(1).cast("long").alias("weight"))
    budget = codes.sparkSession.createDataFrame([(0, float(k))], "key int, budget double")
    found = cut_points(items, budget).first()
    return found["cut"] if found else None


def _selected(scores: DataFrame, cut: float, k: int | None) -> tuple[int, int | None]:
    if k is None:
        k = scores.where(F.col("weight") >= cut).count()
    return k, _last_code(scores, k)


def resample(docs: DataFrame, model: Model, k: int | None = None, id_col: str = "doc_id", text_col: str = "text",
             seed: int = 0) -> DataFrame:
    """The ``k`` documents with the largest log weight plus Gumbel noise: (id, weight, key).

    This draws ``k`` documents without replacement, in proportion to their
    importance weights.  ``k`` defaults to the number of documents whose weight
    reaches the model's cut.  The k-th key is found by nested histograms, not by
    sorting; keys that tie there stay out together.  Noise comes from the
    identifier, so reruns and repeated rows agree.  A null or empty text has
    weight 0.  An empty table gives an empty result.  Other columns are not
    looked at.
    """
    scores = cut_lineage(scored(docs, model, id_col, text_col, seed))
    _, last = _selected(scores, model.cut, k)
    taken = scores if last is None else scores.where(F.col("code") < last)
    return taken.select(F.col("id").alias(id_col), "weight", "key")


def resampled_rows(docs: DataFrame, model: Model, k: int | None = None, id_col: str = "doc_id", text_col: str = "text",
                   seed: int = 0) -> DataFrame:
    """The rows of ``docs`` that ``resample`` takes, with their columns."""
    scores = cut_lineage(scored(docs, model, id_col, text_col, seed).select("weight", "code"))
    _, last = _selected(scores, model.cut, k)
    if last is None:
        return docs
    rows = scored(docs, model, id_col, text_col, seed, F.struct("*").alias("row"))
    return rows.where(F.col("code") < last).select("row.*")
