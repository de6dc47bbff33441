"""Benchmark decontamination by winnowed word fingerprints that are joined and extended."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetable.llm.store import spare, stored
from pagetable.llm.worker import small, text_bytes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 10
GRAM = 5
FILTER_BITS = 23

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


class Words:
    """The words of some texts, in one array: bounds in `data`, hash, and the text each belongs to."""

    def __init__(self, texts: list[bytes]):
        self.data = _FOLD[np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)]
        inside = _IN_WORD[self.data].astype(np.int8)
        edges = np.diff(inside, prepend=np.int8(0), append=np.int8(0))
        self.start, self.stop = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.start, ends - [len(t) + 1 for t in texts])
        self.last = np.searchsorted(self.start, ends)
        length = self.stop - self.start
        self.hash = np.zeros(len(length), np.uint64)
        order = np.argsort(-length, kind="stable")  # longest first: those still with bytes are a prefix
        at, left = self.start[order], length[order]
        h, step = np.zeros(len(order), np.uint64), 0
        while len(at):
            n = int(np.searchsorted(-left, -step))  # words longer than `step`
            if not n:
                break
            h[:n] = (h[:n] + self.data[at[:n] + step] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h[:n] ^= h[:n] >> np.uint64(29)
            step += 1
        self.hash[order] = _mix(h + length[order].astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """The hash of the k words from each place; _NONE where the text ends before."""
        n = len(self.hash)
        h = np.full(n, np.uint64(k))
        for j in range(k):
            m = max(n - j, 0)
            h[:m] = (h[:m] + self.hash[j:]) * np.uint64(0xD6E8FEB86659FD93)
            h[:m] ^= h[:m] >> np.uint64(32)
        h = np.clip(_mix(h), np.uint64(1), _NONE - np.uint64(1))
        sizes = self.last - self.first
        room = np.repeat(self.last, sizes) - np.arange(n)
        h[room < k] = _NONE
        return h

    def text(self, a: int, b: int) -> list[str]:
        raw = self.data
        return [raw[s:e].tobytes().decode() for s, e in zip(self.start[a:b].tolist(), self.stop[a:b].tolist())]


def winnowed(grams: np.ndarray, span: int) -> np.ndarray:
    """Which places hold the minimum of some `span` consecutive grams of one text (ties: all of them). Two equal runs
    of `span` grams so have a chosen gram at the same place. Texts with fewer grams have none."""
    n = len(grams)
    if n < span:
        return np.zeros(n, bool)
    windows = n - span + 1
    low, high = grams[:windows].copy(), grams[:windows].copy()
    for j in range(1, span):
        np.minimum(low, grams[j : windows + j], out=low)
        np.maximum(high, grams[j : windows + j], out=high)
    low[high == _NONE] = 0  # the window leaves the text: it chooses nothing
    best = np.zeros(n, np.uint64)
    for j in range(span):
        np.maximum(best[j : windows + j], low, out=best[j : windows + j])
    return (grams <= best) & (grams != _NONE) & (best > 0)


def _rows(texts: list[bytes], window: int, gram: int, shorts: list[int], wanted: np.ndarray | None, whole: bool):
    """(words per text, [(text, k, hash, place, first word of context, context)])."""
    words = Words(texts)
    out = []
    sizes = words.last - words.first
    owner = np.repeat(np.arange(len(texts)), sizes)

    def take(grams, chosen, k, around):
        if wanted is not None:
            slot = grams >> np.uint64(64 - FILTER_BITS)
            chosen = chosen & ((wanted[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1) > 0)
        for i in np.flatnonzero(chosen).tolist():
            t = owner[i]
            a, b = max(words.first[t], i - around), min(words.last[t], i + k + around)
            out.append((int(t), k, int(grams[i].view(np.int64)), i - int(words.first[t]), i - int(a), words.text(a, b)))

    grams = words.grams(gram)
    take(grams, winnowed(grams, window - gram + 1), gram, window - gram)
    for k in shorts:
        grams = words.grams(k)
        chosen = grams != _NONE
        if whole:  # a short item is one window: all its words
            chosen &= np.repeat(sizes == k, sizes)
        take(grams, chosen, k, 0)
    return sizes, out


_GRAM = pa.struct(
    [("k", pa.int32()), ("h", pa.int64()), ("at", pa.int32()), ("off", pa.int32()), ("ctx", pa.list_(pa.string()))]
)
_SCHEMA = "n_words long, grams array<struct<k int, h long, at int, off int, ctx array<string>>>"


def _fingerprints(rows: DataFrame, window: int, gram: int, shorts: list[int], wanted, whole: bool) -> DataFrame:
    """`rows` (key columns, then text last) with n_words and the fingerprints in place of the text."""
    kept = rows.columns[:-1]
    fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches):
        bits = None if wanted is None else wanted.value
        for batch in small(batches):
            sizes, found = _rows(text_bytes(batch.column(len(kept))), window, gram, shorts, bits, whole)
            per_text = [[] for _ in range(batch.num_rows)]
            for t, k, h, at, off, ctx in found:
                per_text[t].append({"k": k, "h": h, "at": at, "off": off, "ctx": ctx})
            columns = [batch.column(i) for i in range(len(kept))]
            columns += [pa.array(sizes, pa.int64()), pa.array(per_text, pa.list_(_GRAM))]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "n_words", "grams"])

    return rows.mapInArrow(run, f"{fields}, {_SCHEMA}")


def _filter(grams: DataFrame):
    """A bitmap of fixed size, at most 2^FILTER_BITS / 8 bytes whatever the benchmark, broadcast to skip documents'
    fingerprints that no item has. A larger benchmark fills it and skips less; the join decides."""
    slot = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    octets = grams.groupBy(F.shiftright(slot, 3).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1, int(shiftrightunsigned(h, {64 - FILTER_BITS}) & 7))")).alias("b"))
    bitmap = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    got = octets.toArrow()
    bitmap[got.column("at").to_numpy()] = got.column("b").to_numpy()
    return grams.sparkSession.sparkContext.broadcast(bitmap)


def hits(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, gram: int = GRAM,
) -> DataFrame:
    """(doc_id, text_key, n_words, n_hit, n_items, items, contaminated) per row of `docs`.

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case. A window is
    `window` consecutive words of an item; an item with fewer words, but not none, is one window. A word inside any
    occurrence of a window is hit; `items` are the ids of items with an occurring window, as sorted strings.

    Winnowing: of every `window - gram + 1` consecutive gram hashes the minimum is kept, so a shared window has a
    shared fingerprint at the same place in it. Fingerprints of documents and items are joined and each hit is
    extended word by word to both sides, as far as a window through it can reach.

    NULL and empty texts have no words. Repeated rows, also of items, give repeated results and count once as items.
    Rows of one doc_id with different texts are told apart by `text_key`, a hash of the text. NULL ids stay: an
    item with a NULL id is matched like any other and counts in `n_items` (all such items as one); it only has no id to
    list in `items`. Extra columns are ignored; empty tables give no hits or no rows.
    """
    named = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text"))
    of_items = stored(_fingerprints(named, window, gram, list(range(1, window)), None, True), "items")
    # at most window - 1 values
    shorts = sorted(r["n_words"] for r in of_items.where(F.col("n_words").between(1, window - 1)).select("n_words").distinct().collect())
    item_grams = of_items.select("item", F.explode("grams").alias("i")).select("item", "i.k", "i.h", "i.off", "i.ctx")
    wanted = _filter(item_grams.select("h"))

    # words hold no spaces, so the key names one context
    context = F.unhex(F.md5(F.concat_ws(" ", "k", "h", "off", F.array_join("ctx", " "))))
    source = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    marked = stored(_fingerprints(source, window, gram, shorts, wanted, False), "doc-grams")
    doc_grams = marked.where(F.size("grams") > 0).select("doc_id", "text_key", F.explode("grams").alias("d"))
    doc_grams = doc_grams.select("doc_id", "text_key", "d.*").withColumn("c", context)
    item_grams = item_grams.withColumn("ic", context)
    # a passage that many documents or items share is one context on its side: pairs are of contexts, not of occurrences
    of_docs = doc_grams.groupBy("c", "k", "h").agg(F.first("off").alias("d_off"), F.first("ctx").alias("d_ctx"))
    holders = item_grams.groupBy("ic", "k", "h").agg(
        F.first("off").alias("i_off"), F.first("ctx").alias("i_ctx"), F.collect_set("item").alias("items"),
        F.max(F.col("item").isNull().cast("int")).alias("unnamed"),
    )
    pairs = of_docs.join(holders.drop("items", "unnamed"), ["k", "h"]).select("c", "ic", "k", "d_off", "d_ctx", "i_off", "i_ctx")

    def extend(batches):
        for batch in small(batches, 4096):
            rows, starts, stops = [], [], []
            columns = [batch.column(i).to_pylist() for i in range(2, 7)]
            for r, (k, d_off, d, i_off, i) in enumerate(zip(*columns)):
                if d[d_off : d_off + k] != i[i_off : i_off + k]:
                    continue
                left, right = 0, k
                while left < min(d_off, i_off) and d[d_off - left - 1] == i[i_off - left - 1]:
                    left += 1
                while right < min(len(d) - d_off, len(i) - i_off) and d[d_off + right] == i[i_off + right]:
                    right += 1
                if left + right >= min(window, len(i)):
                    rows.append(r)
                    starts.append(-left)
                    stops.append(right)
            found = batch.take(pa.array(rows, pa.int32()))
            columns = [found.column(0), found.column(1), pa.array(starts, pa.int32()), pa.array(stops, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["c", "ic", "a", "b"])

    met = pairs.mapInArrow(extend, "c binary, ic binary, a int, b int").join(holders.select("ic", "items", "unnamed"), "ic")
    of_context = met.groupBy("c").agg(
        F.collect_set(F.struct("a", "b")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
        F.max("unnamed").alias("unnamed"),
    )
    places = doc_grams.groupBy("doc_id", "text_key", "c").agg(F.collect_set("at").alias("at")).join(of_context, "c")
    own = F.flatten(F.transform("at", lambda p: F.transform("spans", lambda s: F.struct((p + s.a).alias("a"), (p + s.b).alias("b")))))
    per_doc = places.groupBy(F.col("doc_id").alias("doc"), F.col("text_key").alias("txt")).agg(
        F.flatten(F.collect_list(own)).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("found"),
        F.max("unnamed").alias("unnamed"),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s.a, s.b - 1)))))
    per_doc = per_doc.select("doc", "txt", "found", "unnamed", covered.cast("long").alias("hit"))
    key = [F.col("doc_id").eqNullSafe(F.col("doc")), F.col("text_key") == F.col("txt")]
    joined = marked.select("doc_id", "text_key", "n_words").join(per_doc, key, "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "doc_id", "text_key", "n_words", F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("found") + F.col("unnamed"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("found", none).alias("items"),
        F.col("hit").isNotNull().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`docs` without the rows that hold a window of an item; parameters and cases as in `hits`."""
    bad = hits(docs, items, doc_id, text, **options).where("contaminated")
    bad = bad.select(F.col("doc_id").alias("_bad"), F.col("text_key").alias("_key")).distinct()
    key = spare("text_key", docs.columns)
    marked = docs.withColumn(key, F.xxhash64(text))
    clean = marked.join(bad, marked[doc_id].eqNullSafe(bad["_bad"]) & (marked[key] == bad["_key"]), "left_anti")
    return clean.select(*docs.columns)
