"""The pipeline against the operators' brute-force versions, stage by stage, and its queries against their SQL."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from checks.compare import TABLES, rows_of
from pagetable.llm import quality, queries
from tests.llm.helpers import CASES, SF, as_set
from tests.llm.test_lines_and_benchmark import plain_hits, plain_lines
from tests.llm.test_simhash import plain_components, plain_fingerprint

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain_posteriors(rows, evidence):
    """Kept flags of (text, host, path) rows, with the rates of hosts and paths shrunk in plain Python."""
    keep = [True] * len(rows)
    for head in quality.HEADS:
        rate, weights = evidence.rates[head], evidence.weights[head]
        own = [min(evidence.base[head] + sum(w for f, w in weights.items() if f in quality.features((t or "").encode())), 30.0) for t, _, _ in rows]
        logit = math.log(rate) - math.log(1 - rate)
        p = [1 / (1 + math.exp(-(logit + e))) for e in own]

        def shrink(sites, prior):
            total = sum(len(v) for v in sites.values())
            chance = sum(len(v) * prior[k] * (1 - prior[k]) for k, v in sites.items()) / total
            spread = sum(len(v) * (sum(v) / len(v) - prior[k]) ** 2 for k, v in sites.items()) / total
            between = spread - chance * len(sites) / total
            weight = min(chance / between, 1e6) if between > 0 else 1e6
            return {k: (sum(v) + weight * prior[k]) / (len(v) + weight) for k, v in sites.items()}

        hosts, paths = {}, {}
        for (_, h, s), x in zip(rows, p):
            hosts.setdefault(h, []).append(x)
            paths.setdefault((h, s), []).append(x)
        host_rate = shrink(hosts, {h: rate for h in hosts})
        path_rate = shrink(paths, {k: host_rate[k[0]] for k in paths})
        for i, ((_, h, s), e) in enumerate(zip(rows, own)):
            r = path_rate[(h, s)]
            keep[i] &= 1 / (1 + math.exp(-(math.log(r) - math.log(1 - r) + e))) < 0.5
    return keep


def run_plain(rows, evidence, items):
    """rows: tuples of COLUMNS."""
    rows = [r for r, k in zip(rows, plain_posteriors([(r[1], r[3], r[2]) for r in rows], evidence)) if k]
    texts = {}
    for r, (_, _, _, text) in zip(rows, plain_lines([(r[0], r[1]) for r in rows])):
        texts[r[0]] = text
    rows = [(r[0], texts[r[0]]) for r in rows]
    prints = [(d, plain_fingerprint(t)) for d, t in rows]
    rows = [r for r, c in zip(rows, plain_components(prints)) if r[0] == c]
    rows = [r for r, h in zip(rows, plain_hits(rows, items)) if not h[5]]
    lib, out = Tokenizer.from_file(queries.tokenizer()), []
    for d, t in rows:
        ids = lib.encode(t, add_special_tokens=False).ids
        raw, back = np.array(ids, "<u4").tobytes(), lib.decode(ids, skip_special_tokens=False).encode()
        out.append((d, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back).hexdigest()))
    return out


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*COLUMNS)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    evidence = quality.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    want = run_plain([tuple(r) for r in docs.collect()], evidence, items)
    assert 0 < len(want) < docs.count()
    assert as_set(corpus_pipeline.run(spark, sf).collect()) == as_set(want)


def test_stages_take_odd_rows(spark):
    rows = [(d, t, None if i % 2 else "en", "s" if i % 3 else None, None) for i, (d, t) in enumerate(CASES)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, empty, SF)
        assert nothing.count() == 0
        docs = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == COLUMNS == nothing.columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert docs.count() > 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    res = con.execute(queries.SQL[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in res.description], res.fetchall())
