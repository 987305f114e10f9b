"""Helpers for operators that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


_held: tuple[object, object] = (None, None)


def held(key: tuple, make: Callable[[], object]) -> object:
    """What a Python worker's tasks share: the last such object, so that one stage's caches don't outlive it in a later one."""
    global _held
    if _held[0] != key:
        _held = (None, None)
        _held = (key, make())
    return _held[1]


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of each text; a null text is empty."""
    return pc.fill_null(column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()), b"").to_pylist()


def word_counts(column: pa.Array) -> np.ndarray:
    """Number of [^\\x20\\x09-\\x0D]+ in each text, over the batch's bytes at once; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or data is None:
        return np.zeros(len(column), np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    begins = ~blank
    begins[1:] &= blank[:-1]
    some = at[:-1] < at[1:]
    first = at[:-1][some]
    begins[first] = ~blank[first]
    counts = np.zeros(len(column), np.int64)
    if len(first):
        counts[some] = np.add.reduceat(begins.view(np.int8), first, dtype=np.int64)
    return counts


def int_lists(parts: list[bytes], width: int = 4) -> pa.ListArray:
    """Lists of 32-bit integers from their little-endian bytes."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) // width for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def batch(columns: dict[str, object]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns.values()], list(columns))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Pieces of at most so many rows, to bound what a step holds."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
