"""Quality, language and secret operators: planted cases, held-out accuracy, and brute force for fixed patterns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetable.llm import language, quality, queries, secrets
from tests.llm.helpers import CASES, SF, as_set, texts

SMALL = "/root/testdata/sf0.01"


# --- quality -------------------------------------------------------------------------------------


def labelled(spark, seed=0):
    """Plain prose, texts with bad words, and junk; labels for most; one host with junk only."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(900):
        text = [draw.choice(words) for _ in range(draw.randint(20, 60))]
        kind = draw.choice(["good"] * 6 + ["toxic", "junk"])
        host = f"h{i % 5}"
        if kind == "toxic":
            for bad in draw.sample(["vile", "nasty", "rotten", "awful"], 2):
                text.insert(draw.randrange(len(text)), bad)
        if kind == "junk":
            text = [w + "%%" for w in text]
        rows.append((i, " ".join(text), host, draw.choice(["a", "b", None]), kind))
        if i % 3:
            labels.append((i, 0 if kind == "junk" else 1, 1 if kind == "toxic" else 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, kind string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_documents_are_told_apart(spark):
    docs, labels = labelled(spark)
    judged = quality.judge(docs, quality.learn(docs, labels)).join(docs.select("doc_id", "kind"), "doc_id")
    held = judged.join(labels, "doc_id", "left_anti").collect()
    assert len(held) == 300
    assert all(r.keep == (r.kind == "good") for r in held)
    kept = quality.drop_rejected(docs, quality.learn(docs, labels))
    assert kept.columns == docs.columns and {r.kind for r in kept.collect()} == {"good"}


def test_words_of_copies_do_not_count(spark):
    """A toxic text with many copies: its other words mark nothing, so a clean text of the same words stays."""
    docs, labels = labelled(spark, 1)
    family = [(2000 + i, "special words of one family of copies vile nasty", "h0", "a", "toxic") for i in range(40)]
    clean = [(3000, "special words of one family of copies", "h1", "b", "good")]
    more = spark.createDataFrame(family + clean, docs.schema)
    told = labels.union(spark.createDataFrame([(2000 + i, 1, 1) for i in range(40)], labels.schema))
    judged = quality.judge(docs.union(more), quality.learn(docs.union(more), told))
    got = {r.doc_id: r.keep for r in judged.where("doc_id >= 2000").collect()}
    assert got.pop(3000) and not any(got.values())


def test_sites_are_shrunk(spark):
    """With equal evidence a bad host's page is worse off; a host of one page is drawn to the global rate."""
    evidence = quality.Evidence({"low": {b"bad": 6.0}, "toxic": {}}, {"low": -3.0, "toxic": -3.0}, {"low": 0.2, "toxic": 0.1})
    rows = [(i, "bad" if i % 10 else "x", "worst", None) for i in range(200)] + [(1000 + i, "bad" if i % 10 == 0 else "x", "best", None) for i in range(200)]
    rows += [(5000, "x", "lone", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r.doc_id: r.low_quality for r in quality.judge(docs, evidence).collect()}
    assert got[0] > got[5000] > got[1001] and got[1] > got[1000]


def test_quality_cases(spark):
    docs, labels = labelled(spark)
    evidence = quality.learn(docs, labels)
    cases = texts(spark, CASES, source="s", lang=None, host="x", low=1, text_key=2)
    judged = quality.judge(cases, evidence)
    assert judged.count() == len(CASES) and judged.where("keep is null").count() == 0
    assert quality.drop_rejected(cases, evidence).columns == cases.columns
    assert quality.judge(cases.where("false"), evidence).count() == 0
    blank = quality.learn(docs, labels.where("false"))
    assert quality.judge(docs, blank).where("not keep").count() == 0
    odd = labels.union(spark.createDataFrame([(None, 0, 1), (1, None, None), (2, None, 1)], labels.schema))
    assert quality.judge(docs, quality.learn(docs, odd)).count() == docs.count()


def test_penalised_regression():
    draw = np.random.default_rng(0)
    rows = [sorted(set(draw.integers(0, 30, 5).tolist())) for _ in range(400)]
    ones = np.array([float(3 in r or 7 in r) for r in rows])
    weights, _ = quality.fit(rows, ones, 30)
    assert set(np.argsort(-weights)[:2].tolist()) == {3, 7} and np.abs(np.delete(weights, [3, 7])).max() < 0.3 * weights[[3, 7]].min()


# --- language ------------------------------------------------------------------------------------


def plain_phrases(sample, text, piece=language.PIECE):
    """Greedy longest matches by substring search, in pieces."""
    n = 0
    for at in range(0, len(text), piece):
        part, i = text[at : at + piece], 0
        while i < len(part):
            k = 1
            while i + k <= len(part) and part[i : i + k] in sample:
                k += 1
            i += max(k - 1, 1)
            n += 1
    return n


def test_phrases_are_longest_matches():
    draw = random.Random(3)
    letters = "abcdeé "
    samples = {lang: "".join(draw.choice(letters[: 3 + i * 2]) for _ in range(300)) for i, lang in enumerate(["x", "y", "z"])}
    samples = {k: " ".join(v.split()) for k, v in samples.items()}
    automata = language.Automata(samples)
    docs = ["".join(draw.choice(letters + "q") for _ in range(draw.randint(1, 700))) for _ in range(25)] + ["q", "a", "qqq"]
    docs = [" ".join(t.split()) or "a" for t in docs]
    got = automata.phrases([automata.symbols(t) for t in docs])
    want = [[plain_phrases(samples[lang], t) for lang in automata.langs] for t in docs]
    assert got.tolist() == want


def test_held_out_languages(spark):
    out = queries.op8_language(spark, SMALL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang", "text")
    rows = out.join(docs, "doc_id").collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)


def test_predictions_see_the_text_only(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    samples = language.training_texts(docs.select("text", "lang"), "text", "lang")
    told = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, samples).collect()}
    other = docs.withColumns({"lang": F.lit("zz"), "source": F.lit(None)})
    assert {r.doc_id: (r.lang_pred, r.score) for r in language.identify(other, samples).collect()} == told
    again = language.training_texts(docs.repartition(5).select("text", "lang"), "text", "lang")
    assert again == samples


def test_language_cases(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    samples = language.training_texts(docs.select("text", "lang"), "text", "lang")
    rows = CASES + [(40, "12 34 !?"), (43, "½ ² Ⅷ ①"), (41, "東京"), (42, "the and of with this that")]
    out = language.identify(texts(spark, rows, lang="q", _TEXT="r"), samples)
    got = {str(r.doc_id): (r.lang_pred, r.score) for r in out.collect()}
    assert got["7"] == got["3"] == got["5"] == got["40"] == got["43"] == ("und", 0.0)
    assert got["42"][0] == "en" and got["41"][0] in samples
    assert {r.lang_pred for r in language.identify(texts(spark, rows), {}).collect()} == {"und"}
    assert language.training_texts(docs.where("false").select("text", "lang"), "text", "lang") == {}
    assert {r.lang_pred for r in language.identify(texts(spark, CASES[3:5]), {"only": "one line"}).collect()} == {"only"}
    assert language.identify(texts(spark, []), samples).count() == 0
    with pytest.raises(ValueError):
        language.identify(texts(spark, rows, Score=1), samples)


def test_copies_neither_thin_out_nor_fill_a_sample(spark):
    """A language of three texts with thousands of copies is learned, and a copied text counts once in a sample."""
    few = [(f"{word} blue river {i}", "few") for i, word in enumerate(["eins", "zwei", "drei"])]
    many = [(f"{'stone ' * 30}w{''.join(chr(97 + int(d)) for d in str(i))}", "many") for i in range(60)]
    rows = few * 4000 + many + many[:3] * 500
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    samples = language.training_texts(docs, "text", "lang", texts=40)
    assert sorted(samples) == ["few", "many"]
    assert sorted(samples["few"].split()) == sorted("eins zwei drei".split() + ["blue", "river"] * 3)
    rare = [w for w in samples["many"].split() if w != "stone"]
    assert len(rare) == len(set(rare)) == 40


def test_every_letter_of_the_samples_counts(spark):
    """Languages that share a script but not its letters, next to scripts that fill any short list of frequent letters."""
    draw = random.Random(5)

    def prose(letters, n):
        return " ".join("".join(draw.choice(letters) for _ in range(draw.randint(2, 6))) for _ in range(n))

    letters = {"la": range(0x61, 0x7B), "el": range(0x3B1, 0x3CA), "ru": range(0x430, 0x450), "be": range(0x450, 0x460)}
    letters |= {"zh": range(0x4E00, 0x4E00 + 900), "ja": range(0x5300, 0x5300 + 700), "xa": range(0x20000, 0x20000 + 80), "xb": range(0x20100, 0x20100 + 80)}
    letters = {k: [c for c in map(chr, v) if c.lower() == c and c.isalpha()] for k, v in letters.items()}
    samples = {k: prose(v, 1500 if k in ("la", "el", "ru") else 200) for k, v in letters.items()}
    automata = language.Automata(samples)
    mixed = [c for v in letters.values() for c in v[:40]]
    told = [(k, prose(v, 20)) for k, v in letters.items() for _ in range(3)]
    docs = [t for _, t in told] + [prose(mixed + ["\u0e01", "\U00030000"], 60) for _ in range(6)]
    got = automata.phrases([automata.symbols(t) for t in docs])
    assert got.tolist() == [[plain_phrases(samples[lang], t) for lang in automata.langs] for t in docs]
    out = language.identify(texts(spark, [(i, t) for i, (_, t) in enumerate(told)]), samples)
    assert {r.doc_id: r.lang_pred for r in out.collect()} == {i: k for i, (k, _) in enumerate(told)}


def test_pieces_come_from_the_whole_text(spark):
    """Long texts that open with the same lines: the sample holds what follows them."""
    word = lambda i: "".join(chr(97 + int(d)) for d in f"{i:05d}")
    rows = [("licence " * 50 + "12 34 " * 500 + " ".join(word(100 * i + j) for j in range(100)), "a") for i in range(100)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    sample = language.training_texts(docs, "text", "lang", symbols=4000, texts=50, shares=40)["a"]
    words = sample.split()
    assert 3500 < len(sample) <= 4000
    assert 0.2 < sum(w == "licence" for w in words) * 8 / len(sample) < 0.6
    assert len(language.training_texts(docs, "text", "lang", symbols=4000, texts=7, shares=40)["a"]) <= 7 * 101
    held = {w[:3] for w in words if len(w) == 5 and w != "licence"}
    assert len(held) >= 10


# --- secrets -------------------------------------------------------------------------------------

PATTERNS = [
    ("assign", re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def plain_base(text):
    found = [(m.start(), k, name, m.end()) for k, (name, rx, group, least) in enumerate(PATTERNS) for m in rx.finditer(text or "") if len(m[group]) >= least]
    return [(name, a, b) for a, _, name, b in sorted(found)]


def secret_rows(seed=0):
    draw = random.Random(seed)
    pick = lambda letters, n: "".join(draw.choice(letters) for _ in range(n))
    rows = []
    for i in range(300):
        parts = [pick("abcdefghijklmnopqrstuvwxyz", draw.randint(2, 22)) for _ in range(30)]
        for _ in range(draw.randint(0, 3)):
            secret = draw.choice(
                [
                    f"password={pick('0123456789abcdef', 18)}", f'Token : "{pick("0123456789abcdef", 40)}"', "AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16),
                    f"api_key='{pick('ABCDEFGHabcdefgh0123456789+/', 5)}'", "AKIAshort", pick("0123456789abcdef", 23), "secret=ſ tokKen=abcdefgh",
                ]
            )
            parts.insert(draw.randrange(len(parts)), secret)
        rows.append((i, draw.choice([" ", "\n", "é "]).join(parts)))
    return rows


def test_base_spans(spark):
    rows = secret_rows() + CASES
    docs = texts(spark, rows, kind=1, value=2)
    learned = secrets.infer(secrets.labelled_samples(docs))
    by_id = {}
    for r in secrets.scan(docs, learned).collect():
        by_id.setdefault((r.doc_id, r.text), []).append([(s.kind, s.start, s.end) for s in r.spans])
    for d, t in rows:
        for spans in by_id[(d, t)]:
            assert [s for s in spans if s[0] != "format"] == plain_base(t)


def test_query_digests(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op7_secrets(spark, SMALL).collect()}
    for r in docs:
        base, row = plain_base(r.text), got[r.doc_id]
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert row.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(b[0] == k for b in base) for k in ("assign", "access", "hex")]
        assert [s for s in row.spans.split(",") if s and not s.startswith("format")] == [f"{k}:{a}:{b}" for k, a, b in base]


def test_formats_are_inferred(spark):
    """Credentials of the learned formats without what the patterns look for; ordinary long words stay."""
    draw = random.Random(9)
    pick = lambda letters, n: "".join(draw.choice(letters) for _ in range(n))
    learned = secrets.infer(secrets.labelled_samples(texts(spark, secret_rows(1))))
    bare = [(i, "see " + pick("0123456789abcdef", 18) + " there") for i in range(100)]
    plain = [(200 + i, "see " + pick("abcdefghijklmnopqrstuvwxyz", draw.randint(16, 24)) + " there") for i in range(100)]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secrets.scan(texts(spark, bare + plain), learned).collect()}
    assert sum(got[i] == [("format", 4, 22)] for i in range(100)) >= 95
    assert sum(bool(got[200 + i]) for i in range(100)) <= 2


def test_runs_around_base_spans_are_scored(spark):
    """A longer key with 24 hex characters in a row inside is reported whole, beside the base span."""
    draw = random.Random(4)
    pick = lambda letters, n: "".join(draw.choice(letters) for _ in range(n))
    every = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    told = [(i, f"token={pick(every, 40)} {pick('abcdefghijklmnopqrstuvwxyz', 20)}") for i in range(400)]
    learned = secrets.infer(secrets.labelled_samples(texts(spark, told)))
    keys = [(i, f"see {pick(every, 15)}Z{pick('0123456789abcdef', 24)}Z{pick(every, 15)} there") for i in range(100)]
    inside = [(200 + i, f"token={pick(every, 40)} {pick('0123456789abcdef', 30)}") for i in range(20)]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secrets.scan(texts(spark, keys + inside), learned).collect()}
    assert all([s for s in got[i] if s[0] != "format"] == plain_base(t) for i, t in keys + inside)
    assert sum(("format", 4, 60) in got[i] for i in range(100)) >= 90
    assert not any(s[0] == "format" for i, _ in inside for s in got[i])


def test_scan_keeps_columns_named_like_its_own(spark):
    """The text travels under a spare name, also beside a kept column called _text."""
    docs = texts(spark, [(1, "password: hunter22"), (2, None)], _text="mine")
    learned = secrets.infer({k: [] for k in [*secrets.KINDS[:3], "other"]})
    got = secrets.scan(docs, learned, keep=["doc_id", "_text"]).collect()
    found = sorted((r["doc_id"], r["_text"], [(s.kind, s.start, s.end) for s in r.spans]) for r in got)
    assert found == [(1, "mine", [("assign", 0, 18)]), (2, "mine", [])]


def test_automata_merge_and_score():
    draw = random.Random(0)
    strings = ["".join(draw.choice("9f") for _ in range(12)) for _ in range(300)]
    same = secrets.Automaton(strings)
    assert len(same.states) < 60 < len(same.step)
    model = same.model()
    assert secrets.likelihood(model, "1a2b3c4d5e6f") > secrets.likelihood(model, "ZZZZ-ZZZZ-ZZ")
    assert secrets.format_score({"models": {}, "floors": {}}, "x" * 20) == float("-inf")


def test_secret_samples_do_not_depend_on_partitions(spark):
    docs = texts(spark, secret_rows(2))
    assert secrets.labelled_samples(docs, per_kind=20) == secrets.labelled_samples(docs.repartition(7), per_kind=20)
    nothing = secrets.infer(secrets.labelled_samples(texts(spark, [])))
    assert secrets.scan(texts(spark, CASES), nothing).where("size(spans) > 0").count() == 0
    assert secrets.scan(texts(spark, []), nothing).count() == 0
    with pytest.raises(ValueError):
        secrets.scan(texts(spark, CASES, spans=1), nothing)


def test_results_repeat(spark):
    """The same query twice gives the same rows."""
    for query in (queries.op5_quality, queries.op7_secrets, queries.op8_language):
        assert as_set(query(spark, SF).collect()) == as_set(query(spark, SF).collect())
