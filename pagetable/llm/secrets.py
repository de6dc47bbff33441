"""Secret scans: fixed patterns, and formats inferred from the credentials that the patterns label."""

from __future__ import annotations

import math
import re
import sys
import zlib
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetable.llm.store import spare, stored
from pagetable.llm.worker import small, text_bytes, with_columns

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The kinds in their order, their patterns, and the least length of the part that counts.
KINDS = ["assign", "access", "hex", "format"]
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_ASSIGN_LEAST = 6

_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
TRAIN_PER_KIND = 400
TRAIN_LENGTH = 64
ALPHA = 0.05
MARGIN = 0.25

# classes of characters: the symbols of the automata, with the number of characters in each
_CLASS = {
    **{c: "9" for c in "0123456789"},
    **{c: "f" for c in "abcdef"},
    **{c: "z" for c in "ghijklmnopqrstuvwxyz"},
    **{c: "F" for c in "ABCDEF"},
    **{c: "Z" for c in "GHIJKLMNOPQRSTUVWXYZ"},
}
_SIZE = Counter(_CLASS.values())


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(kind, start, end, value start, value end) of the fixed patterns' matches, by start and kind."""
    found = []
    folded = text.lower()
    if any(w in folded for w in _ASSIGN_WORDS):
        found += [
            (0, m.start(), m.end(), m.start(1), m.end(1)) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= _ASSIGN_LEAST
        ]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m.start(), m.end()) for m in _ACCESS.finditer(text)]
    found += [(2, m.start(), m.end(), m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda b: (b[1], b[0]))


def classes(value: str) -> str:
    return "".join(_CLASS.get(c, c) for c in value)


class Automaton:
    """A probabilistic automaton: a prefix tree of class strings whose compatible states are merged.

    Red states are kept, blue ones are children of red ones. The blue state that most strings pass is merged into
    the first red state with which it is compatible: at every pair of states below the two, the shares of ending and
    of each symbol differ by less than the Hoeffding bound for `alpha`. If there is none, it turns red.
    """

    def __init__(self, strings: list[str], alpha: float = ALPHA):
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.step: list[dict[str, int]] = [{}]
        self.through: list[dict[str, int]] = [{}]
        self.ends = [0]
        for string in strings:
            state = 0
            for c in string:
                if c not in self.step[state]:
                    self.step[state][c] = len(self.step)
                    self.step.append({})
                    self.through.append({})
                    self.ends.append(0)
                self.through[state][c] = self.through[state].get(c, 0) + 1
                state = self.step[state][c]
            self.ends[state] += 1
        self._merge()

    def _passes(self, state: int) -> int:
        return self.ends[state] + sum(self.through[state].values())

    def _merge(self) -> None:
        red = [0]
        while True:
            known = set(red)
            blue = [(-n, r, c) for r in red for c, n in self.through[r].items() if self.step[r][c] not in known]
            if not blue:
                break
            _, source, symbol = min(blue)
            state = self.step[source][symbol]
            into = next((r for r in red if self._compatible(r, state)), None)
            if into is None:
                red.append(state)
            else:
                self.step[source][symbol] = into
                self._fold(into, state)
        self.states = red

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        return abs(a / n - b / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: int, b: int) -> bool:
        waiting = [(a, b)]
        while waiting:
            a, b = waiting.pop()
            n, m = self._passes(a), self._passes(b)
            if not n or not m:
                continue
            if self._differ(self.ends[a], n, self.ends[b], m):
                return False
            for c in self.through[a].keys() | self.through[b].keys():
                if self._differ(self.through[a].get(c, 0), n, self.through[b].get(c, 0), m):
                    return False
                if c in self.step[a] and c in self.step[b]:
                    waiting.append((self.step[a][c], self.step[b][c]))
        return True

    def _fold(self, into: int, state: int) -> None:
        """Adds the tree below `state` to the automaton at `into`."""
        waiting = [(into, state)]
        while waiting:
            into, state = waiting.pop()
            self.ends[into] += self.ends[state]
            for c, n in self.through[state].items():
                self.through[into][c] = self.through[into].get(c, 0) + n
                if c in self.step[into]:
                    waiting.append((self.step[into][c], self.step[state][c]))
                else:
                    self.step[into][c] = self.step[state][c]

    def model(self) -> list[tuple[float, dict[str, tuple[float, int]]]]:
        """Per state the logarithm of ending, and per symbol that of going on with a given character, and where to."""
        place = {state: i for i, state in enumerate(self.states)}
        out = []
        for state in self.states:
            n = self._passes(state) + 1
            going = {
                c: (math.log(k / n) - math.log(_SIZE.get(c, 1)), place[self.step[state][c]])
                for c, k in self.through[state].items()
            }
            out.append((math.log((self.ends[state] + 0.5) / n), going))
        return out


def likelihood(model, value: str) -> float:
    """The mean logarithm of a character's probability; what the automaton has never seen counts as 1 in 10^4."""
    if not model:
        return -math.inf
    total, state = 0.0, 0
    for c in classes(value):
        known = model[state][1].get(c)
        if known is None:
            total += math.log(1e-4)
        else:
            total += known[0]
            state = known[1]
    return (total + model[state][0]) / (len(value) + 1)


def infer(samples: dict[str, list[str]], alpha: float = ALPHA) -> dict:
    """Models by kind, and the likelihood that 99 of 100 of a kind's own samples reach. `other` is ordinary text."""
    models, floors = {}, {}
    for kind, values in samples.items():
        values = sorted(set(values))
        if values:
            models[kind] = Automaton([classes(v[:TRAIN_LENGTH]) for v in values], alpha).model()
            own = sorted(likelihood(models[kind], v) for v in values)
            floors[kind] = own[len(own) // 100]
    return {"models": models, "floors": floors}


def format_score(learned: dict, value: str) -> float:
    """How much likelier, per character, the best credential format is than ordinary text; -inf below every floor."""
    ordinary = likelihood(learned["models"].get("other"), value)
    if ordinary == -math.inf:
        ordinary = -math.log(64)
    best = -math.inf
    for kind, model in learned["models"].items():
        if kind != "other":
            fit = likelihood(model, value)
            if fit >= learned["floors"][kind]:
                best = max(best, fit - ordinary)
    return best


def _split(text: str) -> tuple[list, list[tuple[int, int]], list[tuple[int, int]]]:
    """The base spans, the candidates that touch none of them, and those that touch some and lie in none of them."""
    base = base_spans(text)
    starts, reach = [b[1] for b in base], list(accumulate((b[2] for b in base), max))
    free, wider = [], []
    for m in _CANDIDATE.finditer(text):
        before = bisect_left(starts, m.end())  # base spans that start before the candidate ends
        if not before or reach[before - 1] <= m.start():
            free.append((m.start(), m.end()))
            continue
        upto = bisect_left(starts, m.start() + 1)  # base spans that start no later than the candidate
        if not upto or reach[upto - 1] < m.end():
            wider.append((m.start(), m.end()))
    return base, free, wider


def labelled_samples(docs: DataFrame, text: str = "text", per_kind: int = TRAIN_PER_KIND) -> dict[str, list[str]]:
    """Up to `per_kind` distinct values of each base kind, and of candidates outside them (`other`).

    The values with the smallest hashes are taken; every task hands on only its own smallest, so the sample is the
    same for any partitioning and bounded for any input.
    """
    names = [*KINDS[:3], "other"]

    def run(batches):
        lowest: list[dict[str, int]] = [{} for _ in names]
        for batch in small(batches):
            for data in text_bytes(batch.column(0)):
                text = data.decode()
                base, free, _ = _split(text)
                for kind, value in [(b[0], text[b[3] : b[4]]) for b in base] + [(3, text[a:b]) for a, b in free]:
                    lowest[kind][value] = zlib.crc32(value.encode())
            for kind, values in enumerate(lowest):
                if len(values) > 4 * per_kind:
                    lowest[kind] = dict(sorted(values.items(), key=lambda x: (x[1], x[0]))[:per_kind])
        rows = [(k, v, h) for k, vs in enumerate(lowest) for v, h in sorted(vs.items(), key=lambda x: (x[1], x[0]))[:per_kind]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int64()))], names=["kind", "value", "mixed"]
        )

    found = stored(docs.select(text).mapInArrow(run, "kind int, value string, mixed long"), "secret-samples")
    out = {}
    for k, name in enumerate(names):
        own = found.where(F.col("kind") == k).select("mixed", "value").distinct().orderBy("mixed", "value").limit(per_kind)
        out[name] = [r["value"] for r in own.collect()]
    return out


def scan(docs: DataFrame, learned: dict, text: str = "text", keep: list[str] | None = None, margin: float = MARGIN) -> DataFrame:
    """The columns `keep` (default: all) with `spans`: an array of (kind, start, end, score), in code points.

    The kinds assign, access and hex are the matches of fixed patterns, always kept (score NULL). The kind `format`
    adds runs of 16 or more credential characters that lie in none of them, if an automaton inferred from labelled
    credentials finds them likelier than the one of ordinary text by `margin` per character. A run that holds or crosses
    a base span is added beside it.

    NULL and empty texts have no spans; repeated rows give repeated results; an empty table gives an empty one. Whole
    texts are scanned. If nothing was learned, only fixed patterns count. A column called spans is an error.
    """
    kept = docs.columns if keep is None else keep
    if "spans" in [c.lower() for c in kept]:
        raise ValueError("a column has the name of the result: spans")
    inner = spare("_text", kept)
    kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        scores: dict[str, float] = {}
        for batch in small(batches):
            rows = []
            for data in text_bytes(batch.column(len(kept))):
                text = data.decode()
                base, free, wider = _split(text)
                spans = [(b[1], b[0], b[2], None) for b in base]
                for a, b in free + wider:
                    value = text[a:b]
                    score = scores.get(value)
                    if score is None:
                        if len(scores) > 50_000:
                            scores.clear()
                        score = scores[value] = format_score(learned, value)
                    if score >= margin:
                        spans.append((a, 3, b, score))
                rows.append([{"kind": KINDS[k], "start": a, "end": b, "score": s} for a, k, b, s in sorted(spans, key=lambda x: x[:3])])
            yield with_columns(batch, kept, spans=pa.array(rows, kind_type))

    fields = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in kept)
    return docs.select(*kept, F.col(text).alias(inner)).mapInArrow(
        run, f"{fields}, spans array<struct<kind string, start int, end int, score double>>"
    )
