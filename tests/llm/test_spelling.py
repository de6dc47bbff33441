"""Spelling variants against brute force over all pairs."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagetable.llm import queries, spelling
from tests.llm.helpers import CASES, SF, as_set, texts


def plain_words(rows):
    found = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def plain_near(words):
    """Words that share a wildcard spelling of one letter, or one letter's deletion."""
    by = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            by[w[:i] + "*" + w[i + 1 :]].add(w)
            by[w[:i] + w[i + 1 :], 1].add(w)
        by[w, 1].add(w)
    near = defaultdict(set)
    for key, own in by.items():
        for a in own:
            for b in own:
                if a != b and (isinstance(key, str) or len(a) != len(b)):
                    near[a].add(b)
    return near


def plain(rows):
    words = plain_words(rows)
    near = plain_near(words)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def test_near_and_bounds_hold_for_every_edit():
    """The method's promise: near words share as many grams as both bounds say, and a key."""
    draw = random.Random(5)
    for alphabet, share in (("ab", 0.2), ("abcdé", 0.05), ("abcdefghijklmnopqrstuvwxyzàÿ", 0.002), ("abc", 2.0)):
        words = ["".join(draw.choice(alphabet) for _ in range(draw.randint(6, 12))) for _ in range(400)]
        laid = spelling.Laid(words)
        counts = np.bincount(laid.two[laid.has_two], minlength=spelling.GRAMS) + np.bincount(laid.three[laid.has_three], minlength=spelling.GRAMS)
        grams = spelling.Dictionary(counts, share)
        for w in words:
            i, kind = draw.randint(0, len(w)), draw.choice("idr")
            other = w[:i] + (draw.choice(alphabet) if kind != "d" else "") + w[i + (kind != "i") :]
            if other == w or len(other) < 6:
                continue
            told, least = grams.shared_bounds([w, other])
            assert (least >= 1).all() and told[0] @ told[1] >= least.max(), (w, other)
            assert spelling.one_edit([w, other], np.array([0]), np.array([1]))[0]
            first = spelling._first_keys(grams, [w, other], np.array([0]), np.array([1]))
            assert len(first) == 1


def test_one_edit():
    words = ["abcdef", "abcdeg", "abcde", "abcdefg", "bacdef", "abcdeff", "xabcdef", "abdef", "a", ""]
    pairs = [(i, j) for i in range(len(words)) for j in range(i)]
    got = spelling.one_edit(words, np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    near = plain_near(words)
    assert [words[j] in near[words[i]] for i, j in pairs] == got.tolist()


@pytest.mark.parametrize("block", [3, 128])
def test_random_words(spark, block):
    """Few letters, so that most words have many near ones."""
    draw = random.Random(block)
    words = list({"".join(draw.choice("abcÿ") for _ in range(draw.randint(6, 9))) for _ in range(300)})
    rows = [(i, " ".join(w for w in draw.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=200))) for i in range(60)]
    got = spelling.spelling_groups(texts(spark, rows), block=block, frequent=0.02)
    assert as_set(got.collect()) == as_set(plain(rows))


def test_query(spark):
    sf = SF.replace("0.001", "0.01")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = queries.op12_spelling(spark, sf)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = as_set(out.collect())
    assert got == as_set(plain(rows)) and any(r[1] for r in got)


def test_cases(spark):
    rows = CASES + [(50, "naïveté Naïveté NAïVETé " * 9), (None, "naïvetés " * 60), (51, "a" * 3000 + " " + "a" * 3001)] * 5
    got = spelling.spelling_groups(texts(spark, rows, word="q", N=1, key=2))
    assert as_set(got.collect()) == as_set(plain(rows))
    assert spelling.spelling_groups(texts(spark, [])).count() == 0 and spelling.spelling_groups(texts(spark, [(1, None), (2, "")])).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_groups(texts(spark, rows), least_length=5)
