"""SimHash near-dedup against a brute-force version."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from pagetable.llm import simhash


def plain_fingerprint(text, words=3):
    tokens = [w for w in (text or "").translate({i: " " for i in range(9, 14)}).split(" ") if w]
    tokens = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in tokens]
    if not tokens:
        return 0
    grams = [" ".join(tokens[i : i + words]) for i in range(max(len(tokens) - words + 1, 1))]
    values = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(v >> b & 1 for v in values) * 2 > len(values))


def plain_components(prints, bits=3):
    """prints: (doc_id, fingerprint) pairs; all pairs are compared."""
    n = len(prints)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= bits:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i in range(n):
        least.setdefault(find(i), []).append(prints[i][0])
    return [min([d for d in least[find(i)] if d is not None], default=None) for i in range(n)]


def check(got, rows):
    prints = [(d, plain_fingerprint(t)) for d, t in rows]
    want = [(d, f"{p:016x}", c) for (d, p), c in zip(prints, plain_components(prints))]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted([tuple(r) for r in got], key=key) == sorted(want, key=key)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(simhash.near_duplicates(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_cases(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [
        (7, None), (3, ""), (5, " \n\t"), (9, "one"), (2, "One"), (None, "one"), (4, "one two"), (4, "one two"),
        (11, long), (12, long + " more"), (13, "a bİ c d"), (14, "x" * 10_000),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("first", F.lit(2))
    check(simhash.near_duplicates(docs).collect(), rows)
    kept = simhash.one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(
        {c for c in plain_components([(d, plain_fingerprint(t)) for d, t in rows if d is not None])}
    )


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.one_per_group(docs).count() == 0


def test_texts_under_one_id_keep_their_groups(spark):
    """Two texts of one doc_id in two components both stay; of copies under it one row, the first by its other columns."""
    a, b, c = ("alpha beta gamma delta", "one two three four five", "quite another text of other words")
    rows = [(1, a, "z"), (1, b, "y"), (2, a, "x"), (1, a, "w"), (1, a, None), (0, c, "v"), (1, c, "u"), (4, b, "t")]
    rows += [(7, t, "s") for t in ("same words here", "Same words here", "same  words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    kept = sorted(tuple(r) for r in simhash.one_per_group(docs).collect())
    assert [r for r in kept if r[0] != 7] == [(0, c, "v"), (1, a, "w"), (1, b, "y")]
    assert len(kept) == 4
    assert sorted(tuple(r) for r in simhash.one_per_group(docs.repartition(5)).collect()) == kept


@pytest.mark.parametrize("bits", [1, 2, 3, 4, 6])
def test_every_link_connects(spark, bits):
    """Dense and sparse fingerprints: the components of the links are those of all pairs, with small blocks too."""
    draw = random.Random(bits)
    prints = {draw.getrandbits(64) for _ in range(40)}
    for base in list(prints)[:20]:
        for _ in range(25):
            near = base
            for _ in range(draw.randint(1, bits + 2)):
                near ^= 1 << draw.randrange(64)
            prints.add(near)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = simhash.links(nodes, bits, block=8).collect()
    place = {p: i for i, p in enumerate(signed)}
    root = list(range(len(signed)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in found:
        a, b = place[r.a], place[r.b]
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert [find(i) for i in range(len(signed))] == plain_components(list(enumerate(prints)), bits)


def test_chain_keys_miss_no_pair():
    draw = random.Random(1)
    for bits in (1, 2, 3, 4, 5, 7):
        keys = simhash.chain_keys(bits)
        for _ in range(3000):
            differ = 0
            for b in draw.sample(range(64), draw.randint(0, bits)):
                differ |= 1 << b
            assert any(not differ & mask for _, mask in keys)
