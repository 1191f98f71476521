"""Groups of ordered rows, worked inside a task without a call of Python for each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def begins(rows: pa.Table, names) -> np.ndarray:
    """Marks the rows whose ``names`` differ from those of the row before."""
    out = np.zeros(rows.num_rows, bool)
    out[:1] = True
    for n in names:
        codes = rows[n].combine_chunks().dictionary_encode("encode").indices.to_numpy()
        out[1:] |= codes[1:] != codes[:-1]
    return out


def whole_runs(names, work: Callable[[pa.Table, np.ndarray], pa.Table]):
    """``work(rows, number of the run)`` on rows ordered by ``names``, some whole runs of equal ones at a time."""
    def done(pieces: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        rows = pa.concat_tables(pieces).combine_chunks()
        yield from work(rows, np.cumsum(begins(rows, names)) - 1).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            # the last row before tells whether the batch begins a run
            before = [held[-1].slice(held[-1].num_rows - 1)] if held else []
            new = np.flatnonzero(begins(pa.concat_tables([*before, rows]), names))[1:] - len(before)
            if len(new):
                last = int(new[-1])
                yield from done([*held, rows.slice(0, last)])
                held = [rows.slice(last)]
            else:
                held.append(rows)
        if held:
            yield from done(held)
    return run
