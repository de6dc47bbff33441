"""Repeated byte strings against a brute-force version."""

import random
from collections import Counter

from pyspark.sql import functions as F

from pagetable.llm import repeats


def plain(texts, length=200):
    """Per text (bytes, removed, spans, kept): every string of `length` bytes is counted."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in data for i in range(len(t) - length + 1))
    out = []
    for t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(t)) if gone[i] and (not i or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return out


def check(df, rows, length=200):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect())
    assert got == sorted((str(d), *w) for (d, _), w in zip(rows, plain([t for _, t in rows], length)))


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(repeats.drop_repeats(docs), [(r.doc_id, r.text) for r in docs.collect()])


def test_cases(spark):
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, copy = prose(60), prose(300)
    rows = [
        (1, None), (2, ""), (3, "x" * 199), (3, "x" * 199), (4, "y" * 201), (5, "z" * 200), (6, "z" * 200), (None, copy), (None, copy),
        (7, prose(50) + shared + prose(40)), (8, prose(70) + shared + prose(4)), (9, shared), (9, "q" + shared[:150]),
        (10, prose(20_000)), (11, "ab" * 3000), (12, copy[:400] + "!" + copy[400:]), (13, prose(30) + copy[100:300]),
        (14, prose(9) + copy[150:349] + "#"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rid", F.lit("r")).withColumn("spans", F.lit(0))
    out = repeats.drop_repeats(docs)
    check(out, rows)
    assert out.columns == ["doc_id", "text", "rid", "spans", "n_bytes", "n_removed", "n_spans", "kept"]


def test_empty(spark):
    assert repeats.drop_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_passage_in_many_texts(spark, monkeypatch):
    """A bucket of many blocks: the passage with other text around it, pairs that share a little more, in small blocks."""
    monkeypatch.setattr(repeats, "BLOCK", 4)
    draw = random.Random(5)
    prose = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    passage, edges = prose(260), [prose(40) for _ in range(20)]
    rows = [(i, prose(draw.randint(0, 300)) + edges[draw.randrange(20)] + passage + edges[draw.randrange(20)] + prose(200)) for i in range(80)]
    check(repeats.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_short_length(spark):
    draw = random.Random(6)
    rows = [(i, "".join(draw.choice("ab") for _ in range(draw.randint(0, 120)))) for i in range(60)]
    check(repeats.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=40), rows, 40)
