"""Groups of rows that stand side by side in a partition, read from Arrow batches, and spanning forests within them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each group, one table a group: neighbouring rows equal in the first ``keys`` columns. A group may go on in
    the next batch."""
    kept: pa.Table | None = None
    kept_id: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)], axis=1)
        starts = [*np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]).any(axis=1)])), batch.num_rows]
        for at, end in zip(starts, starts[1:], strict=False):
            own, this = pa.Table.from_batches([batch.slice(at, end - at)]), tuple(ids[at])
            if this == kept_id:
                kept = pa.concat_tables([kept, own])
                continue
            if kept is not None:
                yield kept
            kept, kept_id = own, this
    if kept is not None:
        yield kept


def forest(values: np.ndarray, linked: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links among rows of ``values``, as pairs of row numbers.

    ``linked`` tells which of some rows link to one. Rows reached leave the search, so close families cost little.
    """
    edges: list[tuple[int, int]] = []
    rest, stack = np.arange(1, len(values)), [0]
    while len(rest):
        if not stack:
            stack, rest = [int(rest[-1])], rest[:-1]
        one = stack.pop()
        hit = linked(values[rest], values[one])
        if hit.any():
            new = rest[hit].tolist()
            edges += [(one, x) for x in new]
            stack.extend(new)
            rest = rest[~hit]
    return edges


def edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    ends = np.array(edges, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], names=["u", "v"])
