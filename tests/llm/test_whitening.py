"""Whitening against a plain version in numpy and whole numbers."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetable.llm import queries, whitening
from tests.llm.helpers import SF


def check(got, rows, components=16):
    """Rows of whiten() against (vec_id, vector) rows."""
    x = [(d, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for d, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    told = defaultdict(list)
    for r in got:
        told[r.component, r.vec_id].append(r)
    assert len(got) == sum(min(components, len(v)) for _, v in x)
    for dim in {len(v) for _, v in x}:
        fit = sorted({v for _, v in x if len(v) == dim})
        n, sums = len(fit), [sum(col) for col in zip(*fit)]
        centred = np.array([[a - s / n for a, s in zip(v, sums)] for v in fit])
        values, vectors = np.linalg.eigh(centred.T @ centred / n)
        values, vectors = values[::-1], vectors[:, ::-1]
        for c in range(min(components, dim)):
            real = values[c] > dim * 4 * np.finfo(float).eps * max(values[0], 0) and values[c] > 0
            axis = vectors[:, c] / np.sqrt(values[c]) if real else np.zeros(dim)
            own = [(d, v) for d, v in x if len(v) == dim]
            want = np.array([np.array([a - s / n for a, s in zip(v, sums)]) @ axis for _, v in own])
            wanted = defaultdict(list)
            for (d, v), w in zip(own, want):
                wanted[d].append((sum((n * a - s) ** 2 for a, s in zip(v, sums)), w))
            signs = set()
            for d, some in wanted.items():
                mine = sorted([(r.deviation, r.whitened) for r in told[c + 1, d] if r.n == n])
                for (dev, w), (dev_want, w_want) in zip(mine, sorted(some)):
                    assert dev == (dev_want if dev_want < 1 << 63 else None)
                    assert abs(w) == pytest.approx(abs(w_want), abs=1e-8)
                    if abs(w) > 1e-6:
                        signs.add(np.sign(w) == np.sign(w_want))
            assert len(signs) <= 1
            shares = {r.explained for d, _ in own for r in told[c + 1, d] if r.n == n}
            assert max(shares) == pytest.approx(values[c] / values.sum() if real else 0, rel=1e-9)
    assert all(r.identity_error <= 1e-9 for r in got)


@pytest.mark.parametrize("entries", [1 << 16, 2000])
def test_table(spark, monkeypatch, entries):
    """Also with blocks of a few rows, so that there are many."""
    monkeypatch.setattr(whitening, "BLOCK_ENTRIES", entries)
    monkeypatch.setattr(whitening, "BLOCKS_PER_SPLIT", 3)
    df = spark.read.parquet(f"{SF}/embeddings.parquet").repartition(3)
    df = df.union(df.limit(40).select((F.col("vec_id") + 1000).alias("vec_id"), "embedding", "label"))  # copies
    check(whitening.whiten(df).collect(), [(r.vec_id, r.embedding) for r in df.collect()])


def test_query(spark):
    out = queries.op13_whitening(spark, SF)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(out.collect(), [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()])


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    draw = np.random.default_rng(3)
    rows = [(i, draw.normal(size=5).tolist()) for i in range(40)]
    rows += [(1, None), (2, []), (3, [1.0, None, 2.0, 3.0, 4.0]), (4, [nan] * 5), (5, [1.0, inf, 0.0, 0.0, 0.0]), (None, rows[0][1]), (7, rows[7][1])]
    rows += [(100, [1.0, 2.0, 3.0]), (101, [1.0, 2.0, 3.5]), (102, [1.0, 2.0, 3.5])]  # a length with little variance
    rows += [(200, [0.5, 0.25])]  # a length with one vector
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"X": F.lit(1), "n": F.lit(2), "Part": F.lit(3)})
    check(whitening.whiten(df).collect(), rows)
    assert whitening.whiten(df.where("false")).collect() == [] and whitening.whiten(df.where("embedding is null")).count() == 0


def test_wide_range(spark):
    """Sums and deviations beyond doubles and longs."""
    rows = [(1, [2.0**40, 3.0]), (2, [-(2.0**40), 5.0]), (3, [7.0, 1e300]), (4, [8.0, -2.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    x = {1: (2**46 + 10**6, 192 + 10**6), 2: (10**6 - 2**46, 320 + 10**6), 3: (448 + 10**6, 2**52 + 10**6), 4: (512 + 10**6, 10**6 - 128)}
    sums = [sum(v) for v in zip(*x.values())]
    for r in got:
        exact = sum((4 * a - s) ** 2 for a, s in zip(x[r.vec_id], sums))
        assert r.deviation == (exact if exact < 1 << 63 else None)
        assert r.identity_error < 1e-4
