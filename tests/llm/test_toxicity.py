"""Toxicity: parts of words, the scores of texts against a plain version, held-out accuracy."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from pagetable.llm import queries, toxicity
from tests.llm.helpers import CASES, SF, texts

MILD = "the and water house green walk under paper seven light over music again stone river".split()
HARSH = "horrid vilesome wretch".split()


def made(n, seed=1, harsh=HARSH):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        bad = i % 5 == 0
        words = [draw.choice(MILD) + draw.choice(["", "s", "ly", "x"]) for _ in range(draw.randint(8, 80))]
        for k in range(0, len(words), 12) if bad else ():
            words[k] = draw.choice(harsh)
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_parts_of_words():
    words = ["idiot", "x", "idiots", "ünï", "東京都", "w" * 500]
    parts, many = toxicity.subwords(words)
    for w, n in zip(words, many):
        marked = f"<{w}>"
        grams = sum(max(len(marked) - k + 1, 0) for k in (3, 4, 5)) - (len(marked) in (3, 4, 5))
        assert n == grams + 1, w
    at = np.cumsum(many) - many
    of = {w: parts[a : a + n].tolist() for w, a, n in zip(words, at, many)}
    assert len(set(of["idiot"]) & set(of["idiots"])) >= 6 and not set(of["x"]) & set(of["idiot"])
    alone, n = toxicity.subwords(["idiots"])
    assert alone.tolist() == of["idiots"] and n.tolist() == [len(alone)]
    assert [len(x) for x in toxicity.subwords([])] == [0, 0]


def test_bags_are_averages():
    for text in ("", "?!", "One word", "a b a c idiot a"):
        at, weights = toxicity.bag(text)
        want = Counter()
        words = toxicity.words_of(text)
        for w in words:
            own, _ = toxicity.subwords([w])
            for p in own.tolist():
                want[p] += 1 / len(words) / len(own)
        assert dict(zip(at.tolist(), weights)) == pytest.approx(dict(want), rel=1e-5)


def test_scores_and_unseen_spellings(spark):
    rows = made(600)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, bad) for i, _, bad in rows if i % 2], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all((got[i].predicted == 1) == bool(bad) for i, _, bad in rows if i % 2 == 0)
    table = model.of_parts
    for i, text, _ in rows[:50]:  # the plain version: through the bag
        at, weights = toxicity.bag(text)
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-(table[at] @ weights + model.base))), rel=1e-4)
    other = made(200, seed=2, harsh=["horridd", "vilesom", "wretchh"])
    told = toxicity.score(spark.createDataFrame([r[:2] for r in other], "doc_id long, text string"), model).collect()
    assert np.mean([r.predicted == other[r.doc_id][2] for r in told]) >= 0.95


def test_copies_and_order_do_not_matter(spark):
    rows = made(300)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, bad) for i, _, bad in rows], "doc_id long, toxic int")
    one, two = toxicity.learn(docs, labels), toxicity.learn(docs.union(docs).repartition(3), labels.repartition(3))
    assert np.array_equal(one.of_parts, two.of_parts) and one.base == two.base


def test_held_out_accuracy(spark):
    """On documents whose labels were not learnt; a few labels of the table are wrong by chance."""
    sf = SF.replace("0.001", "0.1")
    got = {r.doc_id: r for r in queries.op11_toxicity(spark, sf).collect()}
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(got[d].held_out for d, _ in labels) and 1500 < sum(r.held_out for r in got.values()) < 2500
    english = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en'").select("doc_id").collect()}
    clean, bad = [got[d] for d, t in labels if not t], [got[d] for d, t in labels if t and d in english]
    assert np.mean([r.predicted for r in clean]) <= 0.02 and np.mean([r.predicted for r in bad]) >= 0.85


def test_cases(spark):
    rows = made(200)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, bad) for i, _, bad in rows] + [(None, 1), (5, None), (7, 1), (7, 0), (10**6, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    given = texts(spark, CASES, _TEXT="q", toxic=1)
    out = toxicity.score(given, model)
    assert out.columns == [*given.columns, "score", "predicted"] and out.count() == len(CASES)
    got = {str(r.doc_id): r.score for r in out.collect()}
    assert got["7"] == got["3"] == got["5"] and all(0 <= s <= 1 for s in got.values())
    assert toxicity.score(texts(spark, []), model).count() == 0
    nothing = toxicity.learn(docs, labels.where("false"))
    assert nothing is None and {(r.score, r.predicted) for r in toxicity.score(given, nothing).collect()} == {(0.0, 0)}
    assert toxicity.learn(docs, labels.where("toxic = 0")) is None and toxicity.learn(docs.where("false"), labels) is None
    with pytest.raises(ValueError):
        toxicity.score(texts(spark, CASES, Score=1), model)


def test_training_holds_few_copies_of_the_bags():
    """The driver's memory: less than 40 bytes for each entry of 8 in the bags, when all buckets are trained."""
    import tracemalloc

    draw = np.random.default_rng(1)
    bags = [(np.sort(draw.choice(8000, 2500, replace=False)).astype(np.int32), np.full(2500, 1 / 2500, np.float32)) for _ in range(600)]
    ones = (np.arange(600) % 2).astype(float)
    tracemalloc.start()
    try:
        toxicity.train(bags, ones, 0.5, buckets=8000, penalty=0.0, turns=2)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 40 * 600 * 2500
