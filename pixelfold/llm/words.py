"""Texts as runs of numbered words, for vectorised work inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text worked on at a time.
SLICE_BYTES = 24 << 20


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that ``text`` holds about ``most`` bytes in each; single texts stay whole."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        block = (np.cumsum(size) - size) // most
        at = np.flatnonzero(np.diff(block, prepend=-1)).tolist()
        for a, b in zip(at, [*at[1:], batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def numbered(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(codes, offsets, dictionary) of lists of strings; list i has codes[offsets[i]:offsets[i + 1]]."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), offsets - offsets[0], coded.dictionary


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Runs without ASCII white space of every text, numbered; null has none."""
    parts = pc.split_pattern_regex(pc.fill_null(texts, ""), r"[\x20\x09-\x0d]+")
    codes, offsets, words = numbered(parts)
    # leading and trailing white space leave empty strings
    empty = pc.index(words, "").as_py() if len(words) else -1
    if empty < 0:
        return codes, offsets, words
    keep = codes != empty
    before = np.concatenate([[0], np.cumsum(keep)])
    return codes[keep], before[offsets], words


def gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of pool[starts[i]:starts[i] + lengths[i]]."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    shift = np.repeat(starts - (ends - lengths), lengths)
    return pool[shift + np.arange(total)]
