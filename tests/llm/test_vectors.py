"""Near-duplicate vectors and connected components against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetable.llm import vectors
from pagetable.llm.components import components
from tests.llm.helpers import SF, as_set


def plain(rows, cosine=0.98):
    """(vec_id, links, component) per row from all pairs; only for rows with an id."""
    n = len(rows)
    fine = [
        v is not None and lab is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows
    ]
    links, root = [0] * n, list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    scaled = [np.array(v, float) / max(map(abs, v)) if ok else None for (_, v, _), ok in zip(rows, fine)]
    unit = [v / np.linalg.norm(v) if v is not None else None for v in scaled]
    for i in range(n):
        for j in range(i):
            if fine[i] and fine[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    members = {}
    for i in range(n):
        members.setdefault(find(i), []).append(rows[i][0])
    least = [min([d for d in members[find(i)] if d is not None], default=None) for i in range(n)]
    return [(rows[i][0], links[i], least[i], rows[i][0] is not None and rows[i][0] == least[i]) for i in range(n)]


@pytest.mark.parametrize("block", [4, 256])
def test_table(spark, block):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert as_set(vectors.near_vectors(df, block=block).collect()) == as_set(plain(rows))


def crowd(seed, n=500, dim=64):
    """Clusters with links near the limit, copies, and lone vectors."""
    draw = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if rows and draw.random() < 0.6:
            _, base, label = rows[draw.integers(len(rows))]
            v = np.array(base) + draw.normal(0, draw.choice([0.0, 0.01, 0.018, 0.022]), dim)
        else:
            v, label = draw.normal(0, 1, dim), int(draw.integers(3))
            v = v / np.linalg.norm(v)
        rows.append((i, [float(np.float32(x)) for x in v], label))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_recall(spark, seed):
    """No link is invented, and retrieval finds nearly all links of a set in which most lie near the limit."""
    rows = crowd(seed)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(df, block=16).collect()}
    want = {d: links for d, links, _, _ in plain(rows)}
    assert all(got[d] <= want[d] for d in want)
    assert sum(got.values()) >= 0.98 * sum(want.values()) > 0


@pytest.mark.parametrize("common", [0.0, 0.6, 0.72, 0.87])
def test_pairs_at_the_limit_meet(common):
    """Also on vectors with a common mean, whose subtraction widens the angle of a pair."""
    draw = np.random.default_rng(8)

    def rows(n):
        v = draw.standard_normal((n, 64))
        v = (1 - common**2) ** 0.5 * v / np.linalg.norm(v, axis=1, keepdims=True) + common * np.eye(64)[0]
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    model, a = vectors.Quantiser(rows(10_000)), rows(3000)
    aside = draw.standard_normal(a.shape)
    aside -= (aside * a).sum(axis=1, keepdims=True) * a
    b = 0.98 * a + (1 - 0.98**2) ** 0.5 * aside / np.linalg.norm(aside, axis=1, keepdims=True)
    assert (model.keys(a) == model.keys(b)).any(axis=1).mean() >= 0.98


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1), (7, [0.0, -0.0], 1),
        (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [None, 1.0], 1), (11, [1.0, 0.0, 0.0], 1), (2, [2.0, 0.0], 1), (None, [1.0, 0.01], 1),
        (12, [0.0, 5.0], 1), (13, [-0.0, 5.0], 1), (14, [1.0, 0.0, 0.1], 1), (None, [0.0, 1.0], 3), (15, [1e-30, 0.0], 1),
        (16, [1e-200, 0.0], 4), (17, [1e308, 1e308], 4), (18, [1e308, 0.99e308], 4), (19, [1e-320, 0.0], 4), (20, [5e-324, 5e-324], 4),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"v": F.lit(1), "n_links": F.lit(2), "g": F.lit(3)})
    assert as_set(vectors.near_vectors(df).collect()) == as_set(plain(rows))
    assert vectors.near_vectors(df.where("false")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed):
    draw = random.Random(seed)
    n = 300
    if seed == 0:
        pairs = [(i, i + 1) for i in range(n - 1)]  # a long chain
    elif seed == 1:
        pairs = [(0, i) for i in range(1, n)] + [(5, 5)]  # a star
    else:
        pairs = [(draw.randrange(n), draw.randrange(n)) for _ in range(n * (seed - 1) // 2)]
    pairs = [(a - 100, b - 100) for a, b in pairs]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
