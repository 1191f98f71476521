"""Spelling variants: words one edit apart, found by PartEnum signatures of their letters."""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelfold.llm.shared import cut_lineage, flipped

# A run of letters in a text that was encoded one byte a character; characters above 255 become question marks.
LETTERS = re.compile(rb"[a-z\xC0-\xFF]+")
# Bytes of a text looked at together, and different words counted before they are handed over.
PIECE = 1 << 22
HELD = 200_000
# Parts of a letter vector: two are left out at a time for words of one length, one for neighbouring lengths.
SAME_PARTS, NEXT_PARTS = 3, 2
# Groups of a signature up to this size compare their words directly.
SMALL_GROUP = 64


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces that no run crosses."""
    at = 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        rest = LETTERS.match(text, end)
        end = rest.end() if rest else end
        yield text[at:end]
        at = end


def runs(text: str) -> Counter:
    """Runs of letters, lower-cased in A-Z, as bytes with one byte a letter."""
    found = Counter()
    for piece in _pieces(text.encode("latin-1", "replace").lower()):
        found.update(LETTERS.findall(piece))
    return found


def spoiled(run: bytes, named: int, every: int) -> bytes:
    """The run, or the run without one letter if ``every`` divides the checksum; ``named`` is that of the document's name."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), named)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _count(least: int, every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def emit():
            words = [w.decode("latin-1") for w in held]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(held.values()), pa.int64())],
                                              names=["word", "n"])

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = runs(text.as_py())
                if every:
                    named, crc = zlib.crc32(f"{name}:".encode()), zlib.crc32
                    hit = [r for r in own if not r.isascii() or not crc(r, named) % every]
                    for r, n in [(r, own.pop(r)) for r in hit]:
                        own[spoiled(r, named, every)] += n
                for w, n in own.items():
                    if len(w) >= least:
                        held[w] += n
                if len(held) >= HELD:
                    yield emit()
                    held = Counter()
        if held:
            yield emit()
    return run


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_n: int = 3,
               every: int = 0) -> DataFrame:
    """(word, n): runs of Latin letters (A-Z, a-z, U+00C0 to U+00FF), lower-cased in A-Z, with their occurrences.

    With ``every`` above 0 a run loses one letter in the documents where
    ``every`` divides the CRC-32 of ``<id>:<run>``: code point CRC modulo length.
    A null identifier is named ``null``; null texts have no runs.  Words of
    ``least_length`` code points and ``least_n`` occurrences stay.  Whole texts
    are read, long ones in pieces; counts are combined in the task before they
    are shuffled.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("name"), F.col(text_col).cast("string").alias("text"))
    counted = rows.where("text is not null").mapInArrow(_count(least_length, every), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A hash of every entry, as unsigned numbers that wrap."""
    x = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(words: list[str]) -> np.ndarray:
    """One row of signatures a word, as ``signatures`` describes them."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(length) - length
    end = begin + length
    place = np.arange(len(codes)) - np.repeat(begin, length)

    def summed(values: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])

    # sums over any stretch of a word: letters by place from its start, from its end, and whatever their place, by part
    from_start = summed(_mixed(codes + (place.astype(np.uint64) << np.uint64(32)), 1))
    from_end = summed(_mixed(codes + ((np.repeat(length, length) - 1 - place).astype(np.uint64) << np.uint64(32)), 2))
    letter = _mixed(codes, 3)

    def family(short: np.ndarray, extra: np.ndarray, parts: int, left_out: int, salt: int) -> list[np.ndarray]:
        """Keys of words that count as ``short`` letters long, with ``extra`` letters in the half that differs."""
        half = short // 2
        by_part = [summed(np.where(codes % np.uint64(parts) == p, letter, 0).astype(np.uint64)) for p in range(parts)]
        found = []
        for side, equal, (lo, hi) in (
                (0, from_start[begin + half] - from_start[begin], (begin + half, end)),
                (1, from_end[end] - from_end[end - (short - half)], (begin, begin + half + extra))):
            for out in itertools.combinations(range(parts), left_out):
                rest = sum((by_part[p][hi] - by_part[p][lo] for p in range(parts) if p not in out), np.zeros(len(words), np.uint64))
                named = (short.astype(np.uint64) << np.uint64(8)) + np.uint64(2 * sum(1 << p for p in out) + side)
                found.append(_mixed(_mixed(equal, salt) + _mixed(rest, salt + 1) + _mixed(named, salt + 2), 0))
        return found

    none, one = np.zeros_like(length), np.ones_like(length)
    with np.errstate(over="ignore"):
        return np.stack(family(length, none, SAME_PARTS, 2, 10) + family(length, none, NEXT_PARTS, 1, 20)
                        + family(length - 1, one, NEXT_PARTS, 1, 20), axis=1).view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = _keys(batch["word"].to_pylist())
            again = pa.array(np.repeat(np.arange(batch.num_rows), keys.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), batch["word"].take(again), batch["n"].take(again)],
                                             names=["key", "word", "n"])


def signatures(words: DataFrame) -> DataFrame:
    """(key, word, n): the PartEnum signatures of every word.

    Two words one edit apart agree on their first or their last half.  The
    letters of the other half are a binary vector, one dimension for the first e,
    one for the second and so on, and the letters are dealt over parts.  With one
    letter replaced the lengths are equal and the vectors have Hamming distance
    2: they agree on all parts but some two.  With one letter inserted the
    lengths and the vectors differ by 1: they agree on all parts but one.  So
    words of one length meet under the equal half and every pair of parts left
    out, words of neighbouring lengths under the equal half, the shorter length
    and every single part left out.
    """
    return words.select("word", "n").mapInArrow(_signed, "key long, word string, n long")


def _compared(groups: DataFrame) -> DataFrame:
    """Pairs (x, y) of a group's ``members`` that are one edit apart; groups are small."""
    one = groups.select("members", F.explode("members").alias("x"))
    near = F.filter("members", lambda y: (y["word"] > F.col("x.word")) & (F.levenshtein(y["word"], F.col("x.word"), 1) == 1))
    return one.select("x", F.explode(near).alias("y"))


def _refined(words: DataFrame) -> DataFrame:
    """Groups of words that hold every pair one edit apart: by the word with one letter left out.

    A group holds one word for each letter that the place left out can have,
    however many words share a signature.
    """
    length = F.char_length("word")
    placed = words.select("word", "n", F.explode(F.sequence(F.lit(1), length)).alias("at"))
    before, after = F.substring("word", F.lit(1), F.col("at") - 1), F.substring("word", F.col("at") + 1, length)
    # replaced: equal around the place; inserted: the longer word without its letter is the shorter word whole
    blanked = placed.select("word", "n", F.explode(F.array(F.xxhash64(before, F.lit(0), after), F.xxhash64(F.concat(before, after)))).alias("part"))
    parts = blanked.union(words.select("word", "n", F.xxhash64("word").alias("part")))
    return parts.groupBy("part").agg(F.collect_set(F.struct("word", "n")).alias("members")).where(F.size("members") > 1)


def near_words(words: DataFrame, small_group: int = SMALL_GROUP) -> DataFrame:
    """Pairs (x, y), structs of (word, n) with x.word < y.word, exactly one inserted, deleted or replaced code point apart.

    ``words`` has distinct words.  Groups of a signature are counted first;
    the words of those above ``small_group`` are grouped anew before they are
    compared, so no large group is compared whole and no pair is lost.
    """
    keys = signatures(words)
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    kind = keys.schema["key"].dataType
    shared = cut_lineage(keys.withColumn("k", flipped("key", kind)).join(
        sizes.select(flipped("key", kind).alias("k"), "size"), "k").select("key", "word", "n", "size"))
    small = shared.where(F.col("size") <= small_group).groupBy("key").agg(F.collect_list(F.struct("word", "n")).alias("members"))
    large = _refined(shared.where(F.col("size") > small_group).select("word", "n").distinct())
    return _compared(small).union(_compared(large)).distinct()


def _rooted(forms: DataFrame) -> DataFrame:
    """(word, root) for every word with a form: the end of its chain of forms.

    Every round doubles how far a word sees; forms at least double in
    occurrences, so the rounds are few.
    """
    current = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        step = current.select(F.reverse("word").alias("k"), F.col("root").alias("further"))
        ahead = current.withColumn("k", F.reverse("root")).join(step, "k", "left")
        after = cut_lineage(ahead.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        current = after.select("word", "root")
        if after.where("moved").isEmpty():
            return current


def group_variants(words: DataFrame, ratio: int = 2, small_group: int = SMALL_GROUP) -> DataFrame:
    """One row a word of ``vocabulary``: (word, form, root, n, n_near, form_n).

    ``n_near`` counts the words one edit away.  The form is the one of them with
    the most occurrences, at equal counts the smallest in code-point order, if
    it has ``ratio`` times the word's or more, else null.  The root is where
    the chain of forms ends, the word itself if it has none.  An empty
    vocabulary gives an empty result.
    """
    words = cut_lineage(words.select("word", "n"))
    pairs = near_words(words, small_group)
    both = pairs.select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("p")).select("p.*")
    best = F.min(F.struct((-F.col("y.n")).alias("less"), F.col("y.word").alias("word")))
    near = both.groupBy(F.col("x.word").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = words.join(near, "word", "left")
    follows = -F.col("best.less") >= ratio * F.col("n")
    formed = cut_lineage(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                       F.when(follows, F.col("best.word")).alias("form"), F.when(follows, -F.col("best.less")).alias("form_n")))
    roots = _rooted(formed.where("form is not null"))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
