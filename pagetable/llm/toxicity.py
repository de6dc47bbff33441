"""Toxicity: bags of subword embeddings, averaged into a linear softmax, trained together in numpy."""

from __future__ import annotations

import re
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetable.llm.store import spare, stored
from pagetable.llm.worker import small, text_bytes, with_columns

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_PER_CLASS = 2_000
BUCKETS = 1 << 17
DIM = 4
GRAMS = (3, 4, 5)
LEAST_DOCS = 3
PENALTY = 0.03
TURNS = 200
SCREEN = 25
WORDS_KEPT = 300_000
_PIECE = 1 << 18

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def subwords(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words' parts, word after word, and how many each word has: its character n-grams, with marks
    for its begin and end, and the whole word. Hashes depend on the characters only."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    chars = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    room = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(chars))  # characters from here to the word's end
    full = np.repeat(lengths, lengths)
    found = [np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets for w in words], np.int32)]
    owners = [np.arange(len(words))]
    rolled = np.zeros(len(chars), np.uint64)
    for n in range(1, GRAMS[-1] + 1):
        rolled = _step(rolled[: max(len(chars) - n + 1, 0)], chars[n - 1 :])
        if n in GRAMS:
            own = room[: len(rolled)]
            at = np.flatnonzero((own >= n) & (full[: len(rolled)] > n))
            found.append((_mixed(rolled[at], n) % np.uint64(buckets)).astype(np.int32))
            owners.append(owner[at])
    owners = np.concatenate(owners)
    return np.concatenate(found)[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(words))


def _step(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = (h + c + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _mixed(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ np.uint64(kind)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text and their weights: every word weighs alike, and so does every part of a word. The weights
    sum to 1, or there are none."""
    words = words_of(text)
    kinds: dict[str, int] = {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    parts, many = subwords(list(kinds))
    share = np.repeat(np.fromiter(kinds.values(), float, len(kinds)) / max(len(words), 1) / np.maximum(many, 1), many)
    at, own = np.unique(parts, return_inverse=True)
    return at.astype(np.int32), np.bincount(own, share, len(at)).astype(np.float32)


class Model:
    """Bucket embeddings and the softmax over their mean. `of_parts` is what each bucket adds to the odds of label 1."""

    def __init__(self, embedding: np.ndarray, layer: np.ndarray, shift: float = 0.0):
        self.embedding, self.layer = embedding, layer
        self.of_parts = embedding @ (layer[:-1, 1] - layer[:-1, 0])
        self.base = float(layer[-1, 1] - layer[-1, 0]) + shift

    def of_bags(self, bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return np.array([float(self.of_parts[b] @ w) for b, w in bags]) + self.base

    def calibrated(self, bags: list[tuple[np.ndarray, np.ndarray]], ones: np.ndarray, rate: float) -> Model:
        """This model with its odds stretched and moved (logistic regression by Newton steps) to fit texts that it was not
        trained on, the classes weighted to the share `rate` of ones."""
        told, many = self.of_bags(bags), ones.sum()
        if not 0 < many < len(ones):
            return self
        weight = np.where(ones > 0, rate / many, (1 - rate) / (len(ones) - many))
        both, at = np.stack([told, np.ones(len(told))], 1), np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(both @ at, -30, 30)))
            pull = both.T @ (weight * (p - ones)) + 1e-4 * (at - [1, 0])
            at = at - np.linalg.solve((both.T * (weight * np.maximum(p * (1 - p), 1e-4))) @ both + 1e-4 * np.eye(2), pull)
        slope, shift = max(float(at[0]), 1e-3), float(at[1])
        out = Model(self.embedding, self.layer)
        out.of_parts, out.base = self.of_parts * slope, self.base * slope + shift
        return out

    def of_words(self, words: list[str]) -> np.ndarray:
        """What each word adds to the odds: the mean of its parts, through the layer."""
        if not words:
            return np.zeros(0)
        parts, many = subwords(words, len(self.of_parts))
        return np.add.reduceat(self.of_parts[parts], np.cumsum(many) - many) / many

    def odds(self, texts: list[str], known: dict[str, float]) -> list[float]:
        """The logarithm of the odds of label 1; `known` keeps words already met."""
        split = [words_of(t) for t in texts]
        new = list({w for own in split for w in own if w not in known})
        known.update(zip(new, self.of_words(new).tolist()))
        return [sum(map(known.__getitem__, own)) / len(own) + self.base if own else self.base for own in split]


def _sums(to: np.ndarray, amounts, size: int) -> np.ndarray:
    """np.bincount(to, amounts(all), size), to the bit, without its copies of the whole input."""
    out = np.zeros(size)
    for at in range(0, len(to), _PIECE):
        cut = slice(at, at + _PIECE)
        np.add.at(out, to[cut].astype(np.intp), amounts(cut).astype(np.float64))
    return out


def train(
    bags: list[tuple[np.ndarray, np.ndarray]], ones: np.ndarray, rate: float, buckets: int = BUCKETS, dim: int = DIM,
    penalty: float = PENALTY, turns: int = TURNS, seed: int = 0,
) -> Model:
    """Embeddings and softmax layer, trained together on the cross-entropy by alternating proximal gradient steps; both
    classes weigh alike, and the odds are then moved to `rate`.

    A bucket's embedding is measured in units of its usual weight and shrunk as a whole by `penalty`: parts that do not go
    with the label in enough texts keep the zero vector, so the words of a few texts are not learnt by heart. The layer has
    a bounded norm. Buckets of fewer than LEAST_DOCS texts are left out. Equal input gives equal models.
    """
    n = len(bags)
    rows = np.repeat(np.arange(n, dtype=np.int32), [len(b) for b, _ in bags])
    columns, values = np.concatenate([b for b, _ in bags]), np.concatenate([w for _, w in bags])
    fine = (_sums(columns, lambda cut: np.ones(len(columns[cut])), buckets) >= LEAST_DOCS)[columns]
    rows = rows[fine]  # one by one: the driver holds few copies
    columns = columns[fine]
    values = values[fine]
    unit = np.sqrt(_sums(columns, lambda cut: np.square(values[cut]), buckets) / n)
    values /= unit.astype(np.float32)[columns]
    layer = np.random.default_rng(seed).standard_normal((dim + 1, 2))
    layer[-1] = 0
    table = np.zeros((buckets, dim))
    target = np.stack([1 - ones, ones], 1)
    weigh = (target / np.maximum(target.sum(0), 1)).sum(1, keepdims=True) / 2

    def off(inner):
        raw = inner @ layer
        told = np.exp(raw - raw.max(1, keepdims=True))
        return (told / told.sum(1, keepdims=True) - target) * weigh

    def folded(at, to, by, size):
        return np.stack([_sums(to, lambda cut: by[cut] * column[at[cut]], size) for column in np.ascontiguousarray(at_of.T)], 1)

    inner = np.append(np.zeros((n, dim)), np.ones((n, 1)), 1)
    for turn in range(turns):
        if turn % SCREEN == 0:  # the buckets that have a vector or may get one before the next look
            at_of = off(inner) @ layer[:-1].T
            pulls = np.linalg.norm(folded(rows, columns, values, buckets), axis=1)
            live = np.flatnonzero((pulls > penalty * 0.8) | table.any(axis=1))
            place = np.full(buckets, -1, np.int32)
            place[live] = np.arange(len(live))
            held = place[columns] >= 0
            r, c, x = rows[held], place[columns[held]], values[held]
            v = np.ones(len(live))
            for _ in range(8 if len(live) else 0):  # the largest singular value of the classes' weighted texts
                u = _sums(r, lambda cut: x[cut] * v[c[cut]], n) * weigh[:, 0]
                v = _sums(c, lambda cut: x[cut] * u[r[cut]], len(live))
                norm = float(np.linalg.norm(v))
                v /= max(norm, 1e-12)
            own = table[live]
        if not len(live):
            break
        at_of = off(inner) @ layer[:-1].T
        step = 1 / max(1.1 * norm * 0.5 * np.linalg.norm(layer[:-1], 2) ** 2, 1e-9)
        own = own - step * folded(r, c, x, len(live))
        size = np.linalg.norm(own, axis=1, keepdims=True)
        own *= np.maximum(1 - step * penalty / np.maximum(size, 1e-12), 0)
        at_of = own
        inner[:, :-1] = folded(c, r, x, n)
        table[live] = own
        layer = layer - inner.T @ off(inner) / (0.5 * float((weigh * inner**2).sum()))
        layer[:-1] *= min(1.0, dim**0.5 / np.linalg.norm(layer[:-1]))
    return Model(table / np.maximum(unit, 1e-30)[:, None], layer, float(np.log(rate / (1 - rate))))


def _bags(batches):
    for batch in small(batches):
        bags = [bag(t.decode()) for t in text_bytes(batch.column(1))]
        parts, weights = [b for b, _ in bags], [w for _, w in bags]
        yield with_columns(batch.select([0, 2]), ["one", "own"], parts=pa.array(parts, pa.list_(pa.int32())), weights=pa.array(weights, pa.list_(pa.float32())))


def learn(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", per_class: int = MAX_PER_CLASS,
) -> Model | None:
    """A model of the label, or None if there is nothing labelled or only one label.

    Trained on at most `per_class` distinct texts of either label, drawn by hash and used whole; a quarter of them, told by
    hash, calibrates the odds. `rate`, the share of ones, comes from all labels. Rows of `labels` with a NULL id or label
    count for nothing; of several labels of one id the more frequent one counts, of a draw 1. Copies of a text are one
    sample. What reaches the driver is bounded by `per_class` bags of at most BUCKETS entries.
    """
    told = labels.where(F.col(doc_id).isNotNull() & F.col(toxic).isNotNull()).groupBy(F.col(doc_id).alias("own_id"))
    told = told.agg((F.avg((F.col(toxic) > 0).cast("int")) >= 0.5).cast("int").alias("one"))
    counts = {r["one"]: r["count"] for r in told.groupBy("one").count().collect()}
    if len(counts) < 2:
        return None
    rate = counts[1] / (counts[0] + counts[1])
    spread = 1 << 30
    limit = F.when(F.col("one") == 1, min(spread, 4 * per_class * spread // counts[1])).otherwise(min(spread, 4 * per_class * spread // counts[0]))
    # about 8 * per_class narrow rows at most, so that no text but theirs is moved
    drawn = told.where(F.pmod(F.xxhash64("own_id", F.lit("draw")), F.lit(spread)) < limit).limit(10 * per_class)
    texts = docs.select(F.col(doc_id).alias("own_id"), F.col(text).alias("text")).join(F.broadcast(drawn), "own_id")
    texts = texts.select("one", F.coalesce("text", F.lit("")).alias("text")).withColumn("own", F.xxhash64("text", F.lit("own")))
    texts = stored(texts.withColumn("row", F.monotonically_increasing_id()), "toxic-texts")
    # equal texts have equal bags: one of them stays
    firsts = texts.groupBy("one", "own").agg(F.min("row").alias("row"))
    own_class = [firsts.where(F.col("one") == one).orderBy("own").limit(per_class) for one in (0, 1)]
    chosen = own_class[0].union(own_class[1]).select("row")
    kept = texts.join(F.broadcast(chosen), "row").select("one", "text", "own")
    found = kept.mapInArrow(_bags, "one int, own long, parts array<int>, weights array<float>").toArrow()
    ones, own = found.column("one").to_numpy().astype(float), found.column("own").to_numpy()
    order = np.lexsort((ones, own))
    bags = [(p.values.to_numpy(), w.values.to_numpy()) for p, w in zip(found.column("parts"), found.column("weights"))]
    ones, own, bags = ones[order], own[order], [bags[i] for i in order]  # views of what came; nothing is copied
    aside = own % 4 == 0
    if len(set(ones[~aside])) < 2:
        aside[:] = False
    if len(set(ones)) < 2:
        return None
    model = train([b for b, a in zip(bags, aside) if not a], ones[~aside], rate)
    return model.calibrated([b for b, a in zip(bags, aside) if a], ones[aside], rate)


def score(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all) with `score` (0 to 1) and `predicted` (1 from a score of 0.5).

    Whole texts are scored by the mean over their words of the words' own means over character n-grams and the whole word.
    NULL texts and texts without words get the score of no words; without a model every score is 0. Repeated rows give
    repeated results; no column but the text is read. A column of `keep` that is called like a result is an error.
    No shuffle; the model is broadcast (one number per bucket), and a worker keeps at most WORDS_KEPT words and those
    of one batch.
    """
    kept = docs.columns if keep is None else keep
    if clash := {c.lower() for c in kept} & {"score", "predicted"}:
        raise ValueError(f"columns with the names of results: {sorted(clash)}")
    inner = spare("_text", kept)
    sent = docs.sparkSession.sparkContext.broadcast(None if model is None else (model.of_parts, model.base))

    def run(batches):
        held = None
        if sent.value is not None:
            held = Model(np.zeros((0, 1)), np.zeros((2, 2)))
            held.of_parts, held.base = sent.value
        known: dict[str, float] = {}
        for batch in small(batches):
            if len(known) > WORDS_KEPT:
                known.clear()
            texts = [t.decode() for t in text_bytes(batch.column(len(kept)))]
            odds = np.clip(held.odds(texts, known), -700, 700) if held else np.full(len(texts), -np.inf)
            told = 1 / (1 + np.exp(-odds))
            yield with_columns(batch, kept, score=pa.array(told, pa.float64()), predicted=pa.array((told >= 0.5).astype(np.int32)))

    fields = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in kept)
    return docs.select(*kept, F.col(text).alias(inner)).mapInArrow(run, f"{fields}, score double, predicted int")
