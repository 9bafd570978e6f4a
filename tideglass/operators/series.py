"""Whole series out of sorted Arrow batches, for kernels that run over many series at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def _same(a: pa.RecordBatch, i: int, b: pa.RecordBatch, j: int, keys: list[str]) -> bool:
    return all(a.column(k)[i].as_py() == b.column(k)[j].as_py() for k in keys)


def _starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Row numbers at which the key differs from the row before; 0 is always one."""
    change = np.zeros(batch.num_rows, dtype=bool)
    change[0] = True
    for k in keys:
        column = batch.column(k)
        if pa.types.is_string(column.type):
            column = column.dictionary_encode().indices
        codes = column.to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(change)


def whole_series(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table per series. Batches are sorted by ``keys`` (no nulls in them); a series may span batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        cuts = [*_starts(batch, keys), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(lo, hi - lo)
            if held and not _same(held[-1], held[-1].num_rows - 1, part, 0, keys):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def numbers(table: pa.Table, name: str) -> np.ndarray:
    """A column as float64, null as NaN."""
    return table.column(name).to_numpy().astype("float64", copy=False)


def longs(table: pa.Table, name: str) -> np.ndarray:
    """A column without nulls as int64."""
    return table.column(name).to_numpy().astype("int64", copy=False)
