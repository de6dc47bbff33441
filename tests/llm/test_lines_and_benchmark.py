"""Line dedup and decontamination against brute force; their SQL is compared in test_contract."""

import hashlib
import random
import re

import pytest

from pagetable.llm import decontaminate, lines
from tests.llm.helpers import CASES, SF, as_set, texts

SPACE = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_lines(rows):
    first = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            key = lower(line.strip(SPACE))
            if len(key) >= 10 and d is not None:
                first[key] = min(first.get(key, d), d)
    out = []
    for d, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if d is None or len(k := lower(x.strip(SPACE))) < 10 or first[k] == d]
        out.append((d, len(own), len(own) - len(kept), "\n".join(kept)))
    return out


def check_lines(df, rows):
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in df.collect()]
    assert as_set(got) == as_set(plain_lines(rows))


@pytest.mark.parametrize("batches", [1, 2, 7])
def test_lines_of_documents(spark, batches):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_lines(lines.drop_repeated_lines(docs, batches=batches), [(r.doc_id, r.text) for r in docs.collect()])


def test_line_cases(spark):
    rows = CASES + [
        (20, "  A Shared Line of text \nown one here\nshort\n" + "same in here ten\n" * 3), (21, "a shared line of text\t\nshort\nsame in here TEN"),
        (15, "x\r\na shared LINE of text\r\n"), (30, "ÉÉÉÉÉÉÉÉÉÉ\néééééééééé"), (31, "éééééééééé\nÉÉÉÉÉÉÉÉÉ"),
    ]
    out = lines.drop_repeated_lines(texts(spark, rows, h="1", goes=2, doc_key=3, batch=4), batches=3)
    assert out.columns == ["doc_id", "text", "h", "goes", "doc_key", "batch", "n_lines", "n_dropped"]
    check_lines(out, rows)
    assert out.where("doc_id = 7").first().text is None
    assert lines.drop_repeated_lines(texts(spark, [])).count() == 0
    with pytest.raises(ValueError):
        lines.drop_repeated_lines(texts(spark, rows, N_Lines=1))


def test_runs_are_compacted(spark):
    runs = lines.LineRuns(spark, fanout=2)
    for batch in range(7):
        rows = [(hashlib.md5(str(k).encode()).digest(), batch) for k in range(batch, 40, batch + 1)]
        runs.add(spark.createDataFrame(rows, "h binary, first long"))
        assert all(len(level) < 2 for level in runs.levels)
    got = {bytes(r.h): r.first for r in runs.all().collect()}
    assert got == {hashlib.md5(str(k).encode()).digest(): min(b for b in range(7) if k in range(b, 40, b + 1)) for k in range(40)}
    assert runs.all().count() == 40
    runs.drop()


WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_hits(rows, items, window=10):
    windows = {}
    for i, t in items:
        w = WORDS.findall(lower(t or ""))
        for p in range(max(len(w) - window + 1, 1) if w else 0):
            windows.setdefault(tuple(w[p : p + window]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    out = []
    for d, t in rows:
        w = WORDS.findall(lower(t or ""))
        hit, found = set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in windows:
                    hit.update(range(p, p + n))
                    found |= windows[tuple(w[p : p + n])]
        out.append((d, len(w), len(hit), len(found), ",".join(sorted(found - {"None"})), bool(hit)))
    return out


def check_hits(df, rows, items, **options):
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r["items"]), r.contaminated) for r in df.collect()]
    assert as_set(got) == as_set(plain_hits(rows, items, **options))


def test_hits_of_documents(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    check_hits(decontaminate.hits(docs, bench), [(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])


@pytest.mark.parametrize("seed", range(3))
def test_random_words(spark, seed):
    """Few words, so that windows overlap, repeat and tie; items of every length."""
    draw = random.Random(seed)
    text = lambda n: " ".join(draw.choice("a b c".split()) for _ in range(n))
    items = [(i, text(draw.choice([0, 1, 3, 5, 9, 10, 11, 14]))) for i in range(8)]
    rows = [(i, text(draw.randint(0, 60)) + "! " + draw.choice(items)[1].upper()) for i in range(60)]
    got = decontaminate.hits(texts(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    check_hits(got, rows, items)


def test_benchmark_cases(spark):
    items = [(1, None), (2, ""), (10, "one line ONLY here"), (10, "one line only here"), (3, "東京都 ends"), (None, "word"), (4, "word " * 30), (5, "no such words at all in any text of these here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.hits(texts(spark, CASES, item=1, grams=2, text_key=3), bench)
    check_hits(got, CASES, items)
    docs = texts(spark, CASES, text_key=3, item="x")
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == ["12", "3", "5", "7"]
    nothing = bench.where("false")
    assert decontaminate.drop_contaminated(docs, nothing).count() == len(CASES)
    assert decontaminate.hits(texts(spark, []), bench).count() == 0


def test_items_without_id_contaminate(spark):
    """An item with a NULL id is matched and counted; only the list of ids lacks it."""
    passage = "a passage of ten words and more that has no id at all"
    rows = [(1, f"before {passage} after"), (2, "nothing of it"), (3, f"lone and {passage}"), (4, "lone")]
    bench = spark.createDataFrame([(None, passage), (8, "lone"), (None, passage)], "item_id long, text string")
    docs = texts(spark, rows)
    got = {r.doc_id: (r.n_hit, r.n_items, r["items"], r.contaminated) for r in decontaminate.hits(docs, bench).collect()}
    assert got == {1: (13, 1, [], True), 2: (0, 0, [], False), 3: (14, 2, ["8"], True), 4: (1, 1, ["8"], True)}
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()] == [2]
