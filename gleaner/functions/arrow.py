"""Arrow batches taken in pieces, so that Python holds few of their values as objects."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Values of lists that become Python objects at a time.
PIECE = 100_000


def lengths(lists: pa.ListArray) -> np.ndarray:
    """Of each list, 0 for a null."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def bounds(sizes: np.ndarray) -> np.ndarray:
    """Where parts of these sizes begin, and where the last one ends."""
    return np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def pieces(sizes: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of runs of rows; a run's sizes come to ``most``, or it is one row."""
    at = bounds(sizes)
    start = 0
    while start < len(sizes):
        end = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
        yield start, end - start
        start = end


def lists(column: pa.ListArray) -> list[list | None]:
    """The lists as Python's; faster than ``to_pylist``, which makes a scalar of each value."""
    flat, at = column.flatten().to_numpy(zero_copy_only=False).tolist(), bounds(lengths(column))
    return [flat[a:b] if there else None for a, b, there in zip(at, at[1:], column.is_valid().to_pylist())]


def by_pieces(made: Callable[[list, list], list | None], x: pa.ListArray, y: pa.ListArray, kind: pa.DataType) -> pa.Array:
    """``made`` of each two lists; null if either is."""
    parts = []
    for start, n in pieces(lengths(x) + lengths(y)):
        pairs = zip(lists(x.slice(start, n)), lists(y.slice(start, n)))
        parts.append(pa.array([None if a is None or b is None else made(a, b) for a, b in pairs], kind))
    return pa.concat_arrays(parts) if parts else pa.array([], kind)
