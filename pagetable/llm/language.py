"""Language identification by cross-parsing texts with suffix automata of labelled text."""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagetable.llm.store import spare
from pagetable.llm.worker import once, small, text_bytes, with_columns

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TRAIN_SYMBOLS = 160_000
TRAIN_TEXTS = 400
TRAIN_SHARES = 8
PIECE = 256
_POINTS = sys.maxunicode + 1
_WIDEST = 64
_OTHER, _SPACE = 0, 1


def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(_POINTS)])


class Transitions:
    """The suffix automaton of one text. States are multiples of the width of its own alphabet; the first is 0.

    Up to _WIDEST symbols they are a table, beyond that sorted keys, whose size does not depend on the alphabet.
    """

    def __init__(self, symbols: np.ndarray, codes: int):
        known = np.unique(symbols)
        self.own = np.zeros(codes, np.int32)  # the symbols of this text by their code; 0 is none of them
        self.own[known] = np.arange(1, len(known) + 1)
        self.width = len(known) + 1
        following = _automaton(self.own[symbols].tolist())
        state = np.repeat(np.arange(len(following)), [len(f) for f in following])
        at = state * self.width + np.array([s for f in following for s in f], np.int64)
        to = np.array([t for f in following for t in f.values()], np.int64) * self.width
        if self.width <= _WIDEST:
            self.keys, self.to = None, np.full(len(following) * self.width, -1, np.int32)
            self.to[at] = to
        else:
            order = np.argsort(at)
            self.keys, self.to = np.append(at[order], -1), np.append(to[order], -1)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Where each state goes with a symbol of `own`; -1 if nowhere."""
        if self.keys is None:
            return self.to.take(state + symbol)
        place = np.searchsorted(self.keys[:-1], state + symbol)
        return np.where(self.keys.take(place) == state + symbol, self.to.take(place), -1)


class Automata:
    """Suffix automata of one text per language. Every letter of any sample is a symbol; all others are one more."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        alphabet = sorted({c for text in samples.values() for c in text if c != " "})
        self.code = np.zeros(_POINTS, np.min_scalar_type(len(alphabet) + 1))
        self.code[~once("letters", _letters)] = _SPACE
        for i, c in enumerate(alphabet):
            self.code[ord(c)] = i + 2
        self.tables = [Transitions(self.symbols(samples[lang]), len(alphabet) + 2) for lang in self.langs]
        self.weight = np.array([math.log2(len(samples[lang]) + 2) for lang in self.langs])

    def symbols(self, text: str) -> np.ndarray:
        """Letters in lower case by their code, everything else as single spaces between them."""
        codes = self.code[np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")]
        double = (codes[1:] == _SPACE) & (codes[:-1] == _SPACE)
        return codes[np.concatenate([[True], ~double])] if len(codes) else codes

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases per text (rows) and language: each phrase is the longest match from where the last one ended.

        Texts are parsed in pieces of PIECE symbols, all pieces and languages in step; a piece starts a phrase.
        """
        counts = np.zeros((len(texts), len(self.langs)), np.int64)
        sizes = [len(t) for t in texts]
        if not sum(sizes) or not self.langs:
            return counts
        pieces = [(t, at) for t, n in enumerate(sizes) for at in range(0, n, PIECE)]
        length = np.array([min(PIECE, sizes[t] - at) for t, at in pieces])
        order = np.argsort(-length, kind="stable")
        length = length[order]
        owner = np.array([t for t, _ in pieces])[order]
        flat = np.concatenate(texts)
        first = np.cumsum([0, *sizes[:-1]])[owner] + np.array([at for _, at in pieces])[order]
        grid = np.zeros((PIECE, len(pieces)), np.int32)
        for step in range(PIECE):
            n = int(np.searchsorted(-length, -step))
            grid[step, :n] = flat[first[:n] + step]
        active = [int(np.searchsorted(-length, -step)) for step in range(PIECE)]
        for j, table in enumerate(self.tables):
            state = np.zeros(len(pieces), table.to.dtype)
            made = np.zeros(len(pieces), np.int64)
            for step in range(int(length[0])):
                n = active[step]
                symbol = table.own.take(grid[step, :n])
                reached = table.step(state[:n], symbol)
                # a phrase begins where none is under way and where the longest match ends
                made[:n] += (reached < 0) | (state[:n] == 0)
                lost = np.flatnonzero(reached < 0)
                # a symbol without any match is a phrase of its own
                reached[lost] = np.maximum(table.step(np.zeros(len(lost), state.dtype), symbol[lost]), 0)
                state[:n] = reached
            np.add.at(counts[:, j], owner, made)
        return counts


def _automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Per state of the suffix automaton of a symbol sequence, where each symbol leads."""
    following, link, longest, last = [{}], [-1], [0], 0
    for s in symbols:
        state = len(following)
        following.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and s not in following[p]:
            following[p][s] = state
            p = link[p]
        if p >= 0:
            q = following[p][s]
            if longest[q] == longest[p] + 1:
                link[state] = q
            else:
                clone = len(following)
                following.append(following[q].copy())
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p >= 0 and following[p].get(s) == q:
                    following[p][s] = clone
                    p = link[p]
                link[q] = link[state] = clone
        last = state
    return following


def training_texts(
    labelled: DataFrame, text: str, lang: str, symbols: int = TRAIN_SYMBOLS, texts: int = TRAIN_TEXTS, shares: int = TRAIN_SHARES
) -> dict[str, str]:
    """Per language up to `symbols` / languages characters from at most `texts` texts, chosen by a hash
    of the text. Of a text's letters and the single spaces between them, at most one part in `shares` of its language's
    characters is taken, in one piece at a place drawn from the hash, so that openings do not stand for whole texts.

    Copies of a text within a language are one text. The sample is bounded whatever the table: the distinct texts of
    languages are counted by their hashes, rows thinned by hash to about four times the number of texts asked for, copies
    reduced to one, and only then ranked within their language.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    rows = rows.select(F.col(lang).alias("lang"), F.xxhash64(text, F.lit("train")).alias("mixed"), F.col(text).alias("text"))
    counts = {r["lang"]: r["count"] for r in rows.select("lang", "mixed").distinct().groupBy("lang").count().collect()}
    if not counts:
        return {}
    room = max(symbols // len(counts), 1)
    spread = 1 << 30
    limits = [F.lit(x) for name, n in counts.items() for x in (name, min(spread, 4 * texts * spread // n + 1))]
    thinned = rows.where(F.pmod("mixed", F.lit(spread)) <= F.element_at(F.create_map(*limits), F.col("lang")))
    thinned = thinned.withColumn("text", F.regexp_replace("text", r"[^\p{L}]+", " "))
    left = F.greatest(F.length("text") - room // shares, F.lit(0))
    start = F.pmod(F.xxhash64("mixed", F.lit("place")), left + 1).cast("int") + 1
    piece = F.substring("text", start, F.lit(room // shares))
    ranked = thinned.groupBy("lang", "mixed").agg(F.min(piece).alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("mixed", "text"))
    chosen = ranked.withColumn("place", place).where(F.col("place") <= texts).orderBy("lang", "place").collect()
    samples: dict[str, str] = {}
    for r in chosen:
        held = samples.get(r["lang"], "")
        if len(held) < room:
            own = " ".join("".join(c if c.isalpha() else " " for c in r["text"].lower()).split())
            samples[r["lang"]] = f"{held} {own}"[:room]
    return samples


def identify(docs: DataFrame, samples: dict[str, str], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all) with `lang_pred` and `score`.

    Each text is parsed greedily into longest matches with the suffix automaton of every language's sample. The
    language with the fewest phrases, weighted by the logarithm of its sample's length, wins; of equal ones the first by name.
    `score` is the lead over the second, from 0 to 1 (1 if only one language is known).

    NULL texts and texts without a letter are `und` with score 0, and so are all texts if nothing was learned.
    Whole texts are parsed, repeated rows give repeated results, no column but the text is read. Every
    letter of the samples counts as itself; letters that no sample has are one symbol. Memory: the automata take at most
    about 0.5 KB per training symbol, bounded by TRAIN_SYMBOLS for all languages together.
    """
    kept = docs.columns if keep is None else keep
    if clash := {c.lower() for c in kept} & {"lang_pred", "score"}:
        raise ValueError(f"columns with the names of results: {sorted(clash)}")
    inner = spare("_text", kept)
    stamp = hash(tuple(sorted(samples.items())))

    def run(batches):
        automata = once(("automata", stamp), lambda: Automata(samples))
        for batch in small(batches, 512):
            texts = [t.decode() for t in text_bytes(batch.column(len(kept)))]
            known = [any(map(str.isalpha, t)) and bool(automata.langs) for t in texts]
            parsed = [automata.symbols(t) if k else np.zeros(0, np.uint8) for t, k in zip(texts, known)]
            cost = automata.phrases(parsed) * automata.weight
            langs, scores = [], []
            for k, row in zip(known, cost):
                if not k:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                best = int(row.argmin())
                rest = np.delete(row, best)
                langs.append(automata.langs[best])
                scores.append(float((rest.min() - row[best]) / rest.min()) if len(rest) and rest.min() > 0 else 1.0)
            yield with_columns(batch, kept, lang_pred=pa.array(langs, pa.string()), score=pa.array(scores, pa.float64()))

    fields = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in kept)
    return docs.select(*kept, F.col(text).alias(inner)).mapInArrow(run, f"{fields}, lang_pred string, score double")
