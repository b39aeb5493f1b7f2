"""Small numpy/Arrow helpers shared by the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64


def flat_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Offsets (starting at 0), lengths and the flat values of a list column; null lists are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return offsets, lengths, column.flatten()


def ints(column: pa.Array, null: int = 0) -> np.ndarray:
    """An integer column as int64, nulls replaced."""
    return column.fill_null(null).to_numpy(zero_copy_only=False).astype(np.int64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The splitmix64 finaliser over uint64 values, with a seed; wraps around silently."""
    with np.errstate(over="ignore"):
        z = x.astype(U64) + U64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> U64(27))) * U64(0x94D049BB133111EB)
        return z ^ (z >> U64(31))


def group_sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in ascending order and the sum of each value column over them."""
    if not len(keys):
        return (keys, *values)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return (keys[at], *(np.add.reduceat(v[order], at) for v in values))


def rechunk(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Whole batches put together to tables of about ``rows`` rows, so that vector work pays."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
