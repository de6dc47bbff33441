"""Helpers that run in tasks."""

import numpy as np
import pyarrow as pa

from pagetable.llm.worker import forest, small, text_bytes, whole_groups


def test_batches_are_cut_by_rows_and_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (5, 5000, 10, 2000, 1, 1, 1)])], names=["t"])
    parts = list(small([batch], rows=3, size=1000))
    assert [v for p in parts for v in p.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert all(p.num_rows <= 3 and (p.num_rows == 1 or p.nbytes <= 1000) for p in parts)
    assert list(small([batch.slice(0, 0)])) == []


def test_null_texts_are_empty():
    assert text_bytes(pa.array(["é", None, ""])) == ["é".encode(), b"", b""]
    assert text_bytes(pa.array([None], pa.large_string())) == [b""]


def test_groups_are_whole():
    keys = np.sort(np.random.default_rng(0).integers(0, 40, 1000))
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[a : a + 7])], names=["g"]) for a in range(0, 1000, 7)]
    seen = []
    for table, bounds in whole_groups(batches, "g", 50):
        own = table.column("g").to_pylist()
        for a, b in zip(bounds[:-1], bounds[1:]):
            assert len(set(own[a:b])) == 1
            seen.append((own[a], int(b - a)))
    assert seen == [(int(k), int(n)) for k, n in zip(*np.unique(keys, return_counts=True))]
    assert list(whole_groups([], "g")) == []


def test_forest_connects_what_is_linked():
    draw = np.random.default_rng(1)
    left, right = draw.integers(0, 200, 150), draw.integers(0, 200, 150)
    child, root = forest(200, left, right)
    label = list(range(200))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in zip(left.tolist(), right.tolist()):
        x, y = find(a), find(b)
        label[max(x, y)] = min(x, y)
    assert dict(zip(child, root)) == {i: find(i) for i in range(200) if find(i) != i}
