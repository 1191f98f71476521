"""Best-fit decreasing packing of token sequences."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelfold.llm.shared import cut_lineage
from pixelfold.llm.words import gather, numbered, slices

LENGTH = 1024
END_ID = 2
# Pieces that one task packs; more leave less room unused, see the README.
GROUP_PIECES = 8192
# White space of the pre-tokenizer.
_WHITE = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# Texts that may not be cut at spaces and line ends: longer runs of white space, or the mark used for cutting.
_UNCUT = f"{_WHITE}{{3}}|{_WHITE}{{2}}\\z|\\x00"
# Words that may not be encoded in one go with others, a line end between them.
_ALONE = f"\\A\\z|\n|{_WHITE}\\z|\\A{_WHITE}{{2}}"


def _byte_of() -> dict[str, int]:
    """The printable stand-ins for bytes that byte-level vocabularies use."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _encoder(path: str):
    """Encoder of a byte-level BPE file whose ids follow the order of its merges."""
    import tiktoken
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    byte = _byte_of()
    added = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    # the pre-tokenizer of byte-level BPE, without backtracking
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
    return tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sorted(added)


class Tokenizer:
    """Ids of whole texts, many at a time.

    A space or line end that no other white space precedes always begins a new
    pre-token, so texts are cut there and every different word is encoded once;
    texts with longer runs of white space are encoded whole.  Texts that hold an
    added token of the vocabulary are encoded by ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        encoder, added = _encoder(path)
        self.path, self.encode = path, encoder.encode_ordinary
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        (self.line_end,) = self.encode("\n")

    @cached_property
    def _reference(self):
        import tokenizers
        return tokenizers.Tokenizer.from_file(self.path)

    def _whole(self, text: str) -> np.ndarray:
        """Ids of a text that is not cut."""
        if self.added and self.added.search(text):
            return np.array(self._reference.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.encode(text), "<u4")

    def _pool(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, lengths) of words."""
        starts, lengths = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        alone = pc.match_substring_regex(words, _ALONE).to_numpy(zero_copy_only=False)
        together = np.flatnonzero(~alone)
        pools, used = [], 0
        if len(together):
            parts = words.take(pa.array(together))
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(parts)], pa.int32()), parts), "\n")
            ids = np.array(self.encode(joined[0].as_py()), "<u4")
            ends = np.append(np.flatnonzero(ids == self.line_end), len(ids))
            starts[together] = np.append(0, ends[:-1] + 1)
            lengths[together] = ends - starts[together]
            pools.append(ids)
            used = len(ids)
        for i in np.flatnonzero(alone):
            ids = np.array(self.encode(words[int(i)].as_py()), "<u4")
            starts[i], lengths[i] = used, len(ids)
            pools.append(ids)
            used += len(ids)
        return np.concatenate(pools) if pools else np.zeros(0, "<u4"), starts, lengths

    def ids(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of every text in order, unsigned 32-bit; null has none."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, _UNCUT)
        if self.added:
            whole = pc.or_(whole, pc.match_substring_regex(texts, self.added.pattern))
        cut = pc.if_else(whole, "", texts)
        cut = pc.replace_substring(pc.replace_substring(cut, " ", "\0 "), "\n", "\0\n\0")
        codes, offsets, words = numbered(pc.split_pattern(cut, "\0"))
        pool, starts, lengths = self._pool(words)
        for i, uncut in enumerate(whole.to_pylist()):
            if uncut:
                yield self._whole(texts[i].as_py())
            else:
                own = codes[offsets[i]:offsets[i + 1]]
                yield gather(pool, starts[own], lengths[own])


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def _pieces(path: str, length: int, end_id: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _tokenizer(path).ids
        for batch in slices(batches, "text"):
            rows, piece, start, size, crc, kept = [], [], [], [], [], []
            for r, ids in enumerate(ids_of(batch.column(1))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                n = len(ids)
                cuts = [0, *range(n % length or length, n, length), n]
                for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    part = ids[a:b]
                    rows.append(r)
                    piece.append(p)
                    start.append(a)
                    size.append(b - a)
                    crc.append(zlib.crc32(part.tobytes()))
                    if keep_ids:
                        kept.append(part.astype(np.int32))
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                       pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
            names = ["id", "piece", "start", "length", "crc"]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)
    return run


def tokenized_pieces(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id",
                     text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, crc[, ids]); only documents above ``length`` are cut, the first piece is the short one."""
    schema = "id long, piece int, start long, length long, crc long" + (", ids array<int>" if keep_ids else "")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_pieces(path, length, end_id, keep_ids), schema)


class OpenBins:
    """A segment tree over remaining capacities; leaf r holds the bins with r free places."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, free: int, bin_: int) -> None:
        self.bins[free].append(bin_)
        node = free + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove a tightest bin with at least ``need`` free places: (free, bin)."""
        node = need + self.leaves
        if not self.count[node]:
            # up to the first right neighbour that holds a bin, then down its left edge
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        free = node - self.leaves
        while node:
            self.count[node] -= 1
            node >>= 1
        return free, self.bins[free].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of every length."""
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    tree, opened = OpenBins(capacity), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        if found is None:
            found, opened = (capacity, opened), opened + 1
        free, bins[i] = found
        offsets[i] = capacity - free
        if free > lengths[i]:
            tree.add(free - lengths[i], bins[i])
    return bins, offsets


def pack(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id",
         text_col: str = "text", keep_ids: bool = False, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece: (id, piece, start, length, ids_crc32[, ids], sequence_id, offset).

    Documents are tokenized, closed by ``end_id`` and cut only if they are longer
    than ``length``.  Pieces that fill a sequence stand alone; the others are dealt
    evenly into groups of about ``group_pieces``, each packed by best-fit
    decreasing over a segment tree of remaining capacities.  A null or empty
    text is the end token alone.  Repeated rows are packed as often as they
    occur, ties in length are packed in any order.  An empty table gives an
    empty result.  Other columns are not looked at.
    """
    pieces = cut_lineage(tokenized_pieces(docs, path, length, end_id, id_col, text_col, keep_ids))
    # stable, as the pieces are written
    numbered = pieces.withColumn("row", F.monotonically_increasing_id())
    names = [F.col("id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"),
             *(["ids"] if keep_ids else []), "sequence_id", "offset"]
    full = numbered.where(F.col("length") == length).withColumn("sequence_id", F.col("row") * 2).withColumn(
        "offset", F.lit(0).cast("long"))
    rest = numbered.where(F.col("length") < length)
    groups = max(1, -(-rest.count() // group_pieces))

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        bins, offsets = best_fit_decreasing(frame["length"].tolist(), length)
        frame["sequence_id"] = (frame["deal"] * (1 << 32) + np.array(bins, np.int64)) * 2 + 1
        frame["offset"] = np.array(offsets, np.int64)
        return frame.drop(columns=["deal"])

    dealt = rest.withColumn("deal", F.pmod(F.xxhash64("row"), F.lit(groups)))
    schema = rest.schema.add("sequence_id", "long").add("offset", "long")
    packed = dealt.groupBy("deal").applyInPandas(place, schema)
    return full.select(*names).union(packed.select(*names))


def sequences(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(sequence_id, ids, documents): the packed sequences of ``pack(..., keep_ids=True)``, each bounded by the length."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", F.col(id_col).alias("id"))))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.flatten(F.col("p.ids")).alias("ids"), F.col("p.id").alias("documents"))
