"""Helpers that run inside tasks: state kept by a Python worker, and groups of sorted rows.

Modules of this subpackage whose functions run in tasks travel with the task (pickled by value), so
executors need no installed copy of the package.
"""

from __future__ import annotations

import sys
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS = 256


def once(key, make):
    """The value that this worker process keeps under `key`, made at first use; later tasks of the process find it."""
    held = sys.modules.setdefault("pagetable_worker_state", ModuleType("pagetable_worker_state")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def small(batches, rows: int = ROWS, size: int = 16 << 20):
    """Batches cut to at most `rows` rows and about `size` bytes, or one row."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield from _halved(batch.slice(start, rows), size)


def _halved(batch: pa.RecordBatch, size: int):
    if batch.num_rows > 1 and batch.nbytes > size:
        half = batch.num_rows // 2
        yield from _halved(batch.slice(0, half), size)
        yield from _halved(batch.slice(half), size)
    else:
        yield batch


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; NULL is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b if b is not None else b"" for b in column.cast(kind).to_pylist()]


def with_columns(batch: pa.RecordBatch, kept: list[str], /, **new) -> pa.RecordBatch:
    names = [*kept, *new]
    return pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *new.values()], names=names)


def whole_groups(batches, key: str, at_least: int = 1 << 14):
    """Tables of whole groups from rows sorted by `key` (a long), with the groups' bounds.

    Rows of a group that a batch cuts are carried on to the next batch, so memory is bounded by one batch and
    one group.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) < at_least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table.column(key).to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))
        if last:
            yield table.slice(0, last), _bounds(keys[:last])
        held = table.slice(last).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, _bounds(table.column(key).to_numpy())


def _bounds(keys: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def forest(n: int, left: np.ndarray, right: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the graph with these links between 0..n-1: as links to each tree's first node."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, left, root[right])
        np.minimum.at(low, right, root[left])
        low = low[low]
        if (low == root).all():
            break
        root = low
    child = np.flatnonzero(root != np.arange(n))
    return child.tolist(), root[child].tolist()
