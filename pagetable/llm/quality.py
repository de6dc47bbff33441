"""Document quality: evidence from texts combined with host and path posteriors by hierarchical empirical Bayes."""

from __future__ import annotations

import math
import sys
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetable.llm.store import spare, stored
from pagetable.llm.worker import small, text_bytes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_LABELLED = 20_000
MAX_FEATURES = 4_000
LEAST_Z = 4.0
LEAST_ODDS = math.log(3)
PENALTY = 0.1
TURNS = 400
HEADS = ["low", "toxic"]

_BLANKED = bytes(b if b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))
_MARKS = frozenset(b for b in range(33, 127) if _BLANKED[b] == 32)
_UPPER = bytes(range(65, 91))


def features(data: bytes) -> set[bytes]:
    """What a text shows: its words (ASCII case ignored) and how they begin, its punctuation marks, and how far it goes in shares of
    capital letters, marks, words that repeat the one before and repeated words, and in the longest run of one word."""
    words = data.lower().translate(_BLANKED).split()
    found = set(words)
    repeated = len(words) - len(found)
    found.update([b"^" + w[:n] for w in found for n in _PREFIXES if len(w) > n])
    found.update(b"#%c" % b for b in _MARKS.intersection(data))
    n, size = max(len(words), 1), max(len(data), 1)
    capitals = size - len(data.translate(None, _UPPER))
    marks = size - len(data.translate(None, bytes(_MARKS)))
    like_last = bytes(map(eq, words, words[1:]))
    run = max(map(len, like_last.split(b"\0")))
    shares = ((b"capitals", capitals / size), (b"marks", marks / size), (b"doubled", sum(like_last) / n), (b"repeated", repeated / n))
    found.update(b"#%s %d" % (name, step) for name, share in shares for step in _STEPS if share * 100 >= step)
    found.update(b"#run %d" % step for step in (2, 3, 4, 6, 9) if run >= step)
    return found


_PREFIXES = (4, 5, 7)
_STEPS = (2, 5, 10, 20, 40, 60, 80)


def _logit(p: Column) -> Column:
    return F.log(p) - F.log(1 - p)


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


class Evidence:
    """Per head the weights of features, what every text weighs (`base`), and the global rate."""

    def __init__(self, weights: dict[str, dict[bytes, float]], base: dict[str, float], rates: dict[str, float]):
        self.weights, self.base, self.rates = weights, base, rates


def fit(rows: list[list[int]], ones: np.ndarray, n_features: int, penalty: float = PENALTY, turns: int = TURNS) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression with an absolute-value penalty, by accelerated proximal steps.

    The penalty leaves weight on the features that explain most documents: words that merely accompany them, as
    those of a text with many copies do, get none.
    """
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.fromiter((f for r in rows for f in r), np.int64, len(owner))
    weights = ahead = np.zeros(n_features + 1)
    # the gradient changes at most by this factor: power steps on the matrix
    v = np.ones(n_features + 1)
    for _ in range(20):
        u = np.bincount(owner, v[column], len(rows)) + v[-1]
        v = np.append(np.bincount(column, u[owner], n_features), u.sum())
        norm = float(np.linalg.norm(v))
        v /= norm
    step, speed = 4 / (norm * 1.05), 1.0
    for _ in range(turns):
        odds = np.bincount(owner, ahead[column], len(rows)) + ahead[-1]
        off = 1 / (1 + np.exp(-np.clip(odds, -30, 30))) - ones
        moved = ahead - step * np.append(np.bincount(column, off[owner], n_features), off.sum())
        moved[:-1] = np.sign(moved[:-1]) * np.maximum(np.abs(moved[:-1]) - step * penalty, 0)
        faster = (1 + math.sqrt(1 + 4 * speed * speed)) / 2
        ahead = moved + (speed - 1) / faster * (moved - weights)
        weights, speed = moved, faster
    return weights[:-1], float(weights[-1])


def learn(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", toxic: str = "toxic",
    max_labelled: int = MAX_LABELLED,
) -> Evidence:
    """Learns what marks low quality (quality 0) and toxic texts (toxic 1).

    Fitted on at most `max_labelled` labelled documents, chosen by a hash of their id: a bounded sample, so it is
    broadcast to find their texts. Features are counted by grouped aggregation; those whose log-odds are at least
    LEAST_ODDS and LEAST_Z standard errors, at most MAX_FEATURES, enter a logistic regression per head. NULL labels
    are left out of a head; of several labels of a document the worse counts.
    """
    own = labels.groupBy(F.col(doc_id).alias("key")).agg(
        (F.min(quality) == 0).cast("int").alias("low"), (F.max(toxic) == 1).cast("int").alias("toxic")
    )
    own = own.where("key is not null").orderBy(F.xxhash64("key"), "key").limit(max_labelled)
    found = docs.select(F.col(doc_id).alias("key"), F.col(text).alias("text")).join(F.broadcast(own), "key")

    def extract(batches):
        for batch in small(batches):
            shown = [sorted(features(t)) for t in text_bytes(batch.column(2))]
            columns = [batch.column(0), batch.column(1), pa.array(shown, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*HEADS, "shown"])

    sample = found.select(*HEADS, "text").mapInArrow(extract, "low int, toxic int, shown array<binary>")
    sample = stored(sample, "labelled")
    totals = sample.agg(*[F.count(h).alias(h) for h in HEADS], *[F.sum(h).alias(f"{h}_1") for h in HEADS]).first()
    counted = sample.select(*HEADS, F.explode("shown").alias("f")).groupBy("f")
    counted = counted.agg(*[F.count(h).alias(h) for h in HEADS], *[F.coalesce(F.sum(h), F.lit(0)).alias(f"{h}_1") for h in HEADS])
    counted = stored(counted.where("low + toxic > 8"), "features")
    weights, base, rates = {}, {}, {}
    for head in HEADS:
        n, ones = totals[head], totals[f"{head}_1"] or 0
        rates[head] = (ones + 0.5) / (n + 1) if ones else 1e-6
        weights[head], base[head] = {}, 0.0
        if not ones or ones == n:
            continue
        a, b = F.col(f"{head}_1") + 0.5, F.col(head) - F.col(f"{head}_1") + 0.5
        odds = F.log(a / (ones + 1)) - F.log(b / (n - ones + 1))
        picked = counted.select("f", odds.alias("w"), (odds / F.sqrt(1 / a + 1 / b)).alias("z"))
        picked = picked.where((F.col("w") >= LEAST_ODDS) & (F.col("z") >= LEAST_Z)).orderBy(F.desc("z"), "f")
        names = [bytes(r["f"]) for r in picked.limit(MAX_FEATURES).collect()]
        place = {f: i for i, f in enumerate(names)}

        def known(batches, head=head, place=place):
            for batch in batches:
                rows = [sorted(place[f] for f in shown if f in place) for shown in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["one", "rows"])

        chosen = sample.where(F.col(head).isNotNull()).select(head, "shown").mapInArrow(known, "one int, rows array<int>").toArrow()
        rows = chosen.column("rows").to_pylist()
        weight, intercept = fit(rows, chosen.column("one").to_numpy().astype(float), len(names))
        weights[head] = {f: float(w) for f, w in zip(names, weight) if w}
        base[head] = intercept - math.log(rates[head] / (1 - rates[head]))
    return Evidence(weights, base, rates)


def _shrunk(sites: DataFrame, heads: list[str]) -> DataFrame:
    """`sites` (n documents, s_<head> their expected cases, prior_<head>) with the posterior rates rate_<head>.

    Beta-binomial by moments: the prior counts as many documents as the spread between sites, beyond what chance
    gives, says; sites that barely differ are drawn almost wholly to the prior. One row comes to the driver.
    """
    mean = {h: F.col(f"s_{h}") / F.col("n") for h in heads}
    prior = {h: F.col(f"prior_{h}") for h in heads}
    seen = sites.agg(
        F.sum("n").alias("n"),
        F.count("*").alias("k"),
        *[F.sum(F.col("n") * (mean[h] - prior[h]) ** 2).alias(f"v_{h}") for h in heads],
        *[F.sum(F.col("n") * prior[h] * (1 - prior[h])).alias(f"b_{h}") for h in heads],
    ).first()
    rates = {}
    for h in heads:
        n = max(seen["n"] or 0, 1)
        chance = (seen[f"b_{h}"] or 0.0) / n
        between = (seen[f"v_{h}"] or 0.0) / n - chance * seen["k"] / n
        weight = min(chance / between, 1e6) if between > 0 else 1e6
        rates[f"rate_{h}"] = (F.col(f"s_{h}") + weight * prior[h]) / (F.col("n") + weight)
    return sites.withColumns(rates)


def judge(
    docs: DataFrame, evidence: Evidence, doc_id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang"
) -> DataFrame:
    """(doc_id, text_key, low_quality, toxic, keep) per row: posterior probabilities, and keep where both are under 1/2.

    The evidence of a text is the sum of its features' weights. Host rates are shrunk towards the global rate and path
    rates (host and path together) towards their host's, both estimated from all documents by grouped aggregation.
    A document's log-odds are those of its path's rate plus its evidence, so a site shifts the judgement of its
    documents by as much as it is known to differ.

    NULL and empty texts show no word; NULL hosts and paths are a site of their own; repeated rows count each and get
    equal results; a NULL doc_id stays; extra columns are ignored; an empty table gives an empty one. Without labels
    everything is kept.
    """
    weights, base = evidence.weights, evidence.base

    def weigh(batches):
        for batch in small(batches):
            scores = {h: [] for h in HEADS}
            for data in text_bytes(batch.column(batch.num_columns - 1)):
                shown = features(data)
                for head in HEADS:
                    own = weights[head].keys() & shown
                    scores[head].append(min(base[head] + math.fsum(map(weights[head].__getitem__, own)), 30.0))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array(scores[h], pa.float64()) for h in HEADS]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "host", "path", *HEADS])

    source = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(host).cast("string").alias("host"),
        F.col(path).cast("string").alias("path"), F.col(text).alias("text"),
    )
    kind = source.schema["doc_id"].dataType.simpleString()
    weighed = stored(
        source.mapInArrow(weigh, f"doc_id {kind}, text_key long, host string, path string, low double, toxic double"), "evidence"
    )
    first = {h: _sigmoid(_logit(F.lit(evidence.rates[h])) + F.col(h)) for h in HEADS}
    paths = weighed.groupBy("host", "path").agg(F.count("*").alias("n"), *[F.sum(first[h]).alias(f"s_{h}") for h in HEADS])
    paths = stored(paths, "paths")
    hosts = paths.groupBy(F.col("host").alias("_host")).agg(F.sum("n").alias("n"), *[F.sum(f"s_{h}").alias(f"s_{h}") for h in HEADS])
    hosts = _shrunk(hosts.withColumns({f"prior_{h}": F.lit(evidence.rates[h]) for h in HEADS}), HEADS)
    hosts = hosts.select("_host", *[F.col(f"rate_{h}").alias(f"prior_{h}") for h in HEADS])
    paths = _shrunk(paths.join(hosts, paths["host"].eqNullSafe(hosts["_host"])), HEADS)
    paths = paths.select(F.col("host").alias("_host"), F.col("path").alias("_path"), *[f"rate_{h}" for h in HEADS])
    out = weighed.join(paths, weighed["host"].eqNullSafe(paths["_host"]) & weighed["path"].eqNullSafe(paths["_path"]))
    odds = {h: _sigmoid(_logit(F.col(f"rate_{h}")) + F.col(h)) for h in HEADS}
    judged = out.select("doc_id", "text_key", odds["low"].alias("low_quality"), odds["toxic"].alias("toxic"))
    return judged.withColumn("keep", (F.col("low_quality") < 0.5) & (F.col("toxic") < 0.5))


def drop_rejected(docs: DataFrame, evidence: Evidence, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`docs` without the rows that `judge` does not keep; parameters and cases as there."""
    bad = judge(docs, evidence, doc_id, text, **options).where(~F.col("keep"))
    bad = bad.select(F.col("doc_id").alias("_bad"), F.col("text_key").alias("_key")).distinct()
    key = spare("text_key", docs.columns)
    marked = docs.withColumn(key, F.xxhash64(text))
    good = marked.join(bad, marked[doc_id].eqNullSafe(bad["_bad"]) & (marked[key] == bad["_key"]), "left_anti")
    return good.select(*docs.columns)
