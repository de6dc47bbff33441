"""Exact repeated byte strings across a corpus: anchored suffix buckets, refined by the buckets of later offsets."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetable.llm.store import spare, stored
from pagetable.llm.worker import small, text_bytes, whole_groups, with_columns

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH = 200
GRAM = 32
BLOCK = 1024
CELL = 20
_TOGETHER = 2048


def anchors(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of the anchors: in every string of `length` bytes the first of its 32-grams with the least hash.

    Equal strings so have their anchor at the same place in them; about every (length - 32) / 2 bytes there is one.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    span = length - GRAM + 1
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none
    h = data.astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)
    step, factor = 1, 0x01000193
    while step < GRAM:
        h = h[:-step] * np.uint32(factor) + h[step:]
        factor = factor * factor & 0xFFFFFFFF
        step *= 2
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    least = h.astype(np.uint64) << np.uint64(32) | np.arange(len(h), dtype=np.uint64)
    step = 1
    while step * 2 <= span:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < span:
        least = np.minimum(least[: len(least) - (span - step)], least[span - step :])
    ends = np.cumsum(sizes)
    inside = np.ones(len(least), bool)  # strings that begin here and end in the same text
    for first, end in zip(np.maximum(ends - sizes, ends - length + 1).tolist(), ends.tolist()):
        inside[max(first, 0) : end] = False
    chosen = (least & np.uint64(0xFFFFFFFF))[inside].astype(np.int64)
    chosen = np.unique(chosen[np.concatenate([[True], chosen[1:] != chosen[:-1]])]) if len(chosen) else none
    owner = np.searchsorted(ends, chosen, side="right")
    return owner, chosen - (ends - sizes)[owner]


def _around(n: int, at: int, length: int) -> tuple[int, int]:
    """The part of a text of n bytes that strings of `length` bytes holding the anchor can reach."""
    return max(at - (length - GRAM), 0), min(at + length, n)


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """(rid, at, gram, around): per anchor a hash of its gram and one of all that strings through it can reach."""

    def run(batches):
        digest = xxhash.xxh3_64_intdigest
        for batch in small(batches):
            texts = text_bytes(batch.column(1))
            owner, place = anchors(texts, length)
            grams, around = [], []
            for t, at in zip(owner.tolist(), place.tolist()):
                text = texts[t]
                a, b = _around(len(text), at, length)
                grams.append(digest(text[at : at + GRAM]))
                around.append(digest(text[a:b], at - a))
            signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (grams, around)]
            columns = [batch.column(0).take(pa.array(owner)), pa.array(place.astype(np.int32)), *signed]
            yield pa.RecordBatch.from_arrays(columns, names=["rid", "at", "gram", "around"])

    return docs.select("rid", "text").mapInArrow(run, "rid long, at int, gram long, around long")


def _refine(strings: np.ndarray, length: int) -> np.ndarray:
    """Bucket identifiers of the strings of `length` bytes from each column of `strings`, by doubling.

    The bucket of a string of 2n bytes is named after that of its first n bytes and that of the n bytes at the later
    offset n; identifiers made for one length are used again for the next.
    """

    def mixed(x):
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ x >> np.uint64(29)

    bucket, n = mixed(strings.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), 1
    while 2 * n <= length:
        bucket = mixed(bucket[:, :-n] * np.uint64(0xBF58476D1CE4E5B9) + bucket[:, n:])
        n *= 2
    if n < length:
        late = length - n
        bucket = mixed(bucket[:, :-late] * np.uint64(0x94D049BB133111EB) + bucket[:, late:])
    return bucket


def _surroundings(table, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The contexts of a table as rows of bytes with their anchors in one column, and which strings in them are real."""
    reach = length - GRAM
    strings = np.zeros((table.num_rows, reach + length), np.uint8)
    left, right = np.zeros(table.num_rows, int), np.zeros(table.num_rows, int)
    for r, (off, data) in enumerate(zip(table.column("off").to_pylist(), table.column("context").to_pylist())):
        left[r], right[r] = reach - off, reach - off + len(data)
        strings[r, left[r] : right[r]] = np.frombuffer(data, np.uint8)
    place = np.arange(reach + 1)
    return strings, (place >= left[:, None]) & (place + length <= right[:, None])


def _names(bucket: np.ndarray, gram: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """A name for each string: its bucket, the bucket's gram, and its place around the anchor."""
    return bucket[row, col] + gram[row].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (col.astype(np.uint64) << np.uint64(40))


_CELLS = "array<struct<core long, cell int, single int, open int>>"
_CELL_TYPE = pa.list_(pa.struct([("core", pa.int64()), ("cell", pa.int32()), ("single", pa.int32()), ("open", pa.int32())]))
_MET = f"rid long, a int, b int, at int, gram long, off int, context binary, cells {_CELLS}"


def _repeats_in_blocks(contexts: DataFrame, length: int) -> DataFrame:
    """Spans (rid, a, b) of strings through an anchor that another context of the same block has at the same place.

    A row with `cells` instead is a context of a bucket with other blocks: per CELL consecutive strings the hash of what
    all of them hold, and as bits those that this row speaks for: open ones, and one of each that the block knows.
    """
    reach = length - GRAM

    def run(batches):
        for table, bounds in whole_groups(batches, "g", _TOGETHER):
            start = 0
            for stop in bounds[1:].tolist():  # some groups at a time: names keep their buckets apart
                if stop - start >= _TOGETHER or stop == len(table):
                    yield from block(table.slice(start, stop - start))
                    start = stop

    def block(table):
        rid, at, gram = (table.column(c).to_numpy() for c in ("rid", "at", "gram"))
        done, blocks = table.column("n").to_numpy() > 1, table.column("blocks").to_numpy()
        strings, real = _surroundings(table, length)
        row, col = np.nonzero(real)
        name = _names(_refine(strings, length), gram, row, col)
        order = np.argsort(name, kind="stable")
        same = name[order[1:]] == name[order[:-1]]
        twice, single = np.zeros(len(name), bool), np.ones(len(name), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        single[order[1:][same]] = False
        f = np.flatnonzero(twice & ~done[row])
        r, c = row[f], col[f]
        if len(f):  # runs of consecutive strings of a row become one span
            new = np.concatenate([[True], (r[1:] != r[:-1]) | (c[1:] != c[:-1] + 1)])
            last = np.concatenate([new[1:], [True]])
            start, stop = at[r[new]] - reach + c[new], at[r[last]] - reach + c[last] + length
            nothing = [pa.nulls(len(start), t) for t in (pa.int32(), pa.int64(), pa.int32(), pa.binary(), _CELL_TYPE)]
            columns = [pa.array(rid[r[new]]), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), *nothing]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        speaks, opened = np.zeros(real.shape, bool), np.zeros(real.shape, bool)
        o = np.flatnonzero(single & (blocks[row] > 1))
        speaks[row[o], col[o]] = True
        opened[row[o], col[o]] = ~(twice[o] | done[row[o]])
        rows, cells = np.flatnonzero(speaks.any(axis=1)).tolist(), []
        for r in rows:
            own = []
            for j in range(0, reach + 1, CELL):
                if speaks[r, j : j + CELL].any():
                    core = xxhash.xxh3_64_intdigest(strings[r, j + CELL - 1 : j + length].tobytes() + gram[r].tobytes(), j)
                    bits = [int((1 << np.flatnonzero(x[r, j : j + CELL])).sum()) for x in (speaks, opened)]
                    own.append({"core": core - (1 << 64) if core >> 63 else core, "cell": j, "single": bits[0], "open": bits[1]})
            cells.append(own)
        if rows:
            kept = table.take(pa.array(rows))
            blank = pa.nulls(len(rows), pa.int32())
            columns = [kept.column("rid"), blank, blank, *(kept.column(c) for c in ("at", "gram", "off", "context")), pa.array(cells, _CELL_TYPE)]
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["rid", "a", "b", "at", "gram", "off", "context", "cells"]
    return contexts.mapInArrow(run, _MET)


def _across_blocks(met: DataFrame, length: int) -> DataFrame:
    """Spans (rid, a, b) of open strings that another block of the bucket has: first cells meet by what their strings
    have in common, then the strings of those cells by name."""
    reach = length - GRAM
    open_rows = met.where("cells is not null")
    cells = open_rows.select("rid", "at", F.explode("cells").alias("c"))
    shared = cells.groupBy("c.core").agg(F.count("*").alias("n")).where("n > 1").select("core")
    alive = cells.select("rid", "at", "c", F.col("c.core").alias("core")).join(shared, "core", "left_semi")
    alive = alive.groupBy("rid", "at").agg(F.collect_list("c").alias("cells"))
    again = open_rows.drop("cells", "a", "b").join(alive, ["rid", "at"]).select("rid", "at", "gram", "off", "context", "cells")

    def run(batches):
        for batch in small(batches, 1024):
            table = pa.Table.from_batches([batch])
            rid, at, gram = (table.column(c).to_numpy() for c in ("rid", "at", "gram"))
            strings, _ = _surroundings(table, length)
            row, col, told = [], [], []
            for r, own in enumerate(table.column("cells").to_pylist()):
                for c in own:
                    for k in range(CELL):
                        if c["single"] >> k & 1:
                            row.append(r)
                            col.append(c["cell"] + k)
                            told.append(not c["open"] >> k & 1)
            row, col = np.array(row, int), np.array(col, int)
            name = _names(_refine(strings, length), gram, row, col) if len(row) else np.zeros(0, np.uint64)
            start = pa.array((at[row] - reach + col).astype(np.int32), mask=np.array(told, bool))
            yield pa.RecordBatch.from_arrays([pa.array(rid[row]), start, pa.array(name.view(np.int64))], names=["rid", "a", "key"])

    keyed = again.mapInArrow(run, "rid long, a int, key long")
    twice = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    late = keyed.where("a is not null").join(twice, "key", "left_semi")
    return late.select("rid", "a", (F.col("a") + length).alias("b"))


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """`docs` with `n_bytes`, `n_removed`, `n_spans` and `kept` (the remaining bytes): strings that repeat are taken out.

    A byte goes if a string of `length` bytes around it also starts anywhere else, in the same text or another; all
    strings are judged on the input.

    Each string of `length` bytes is found through its anchor. Anchors are bucketed by their 32-gram. Those whose whole
    surroundings (all that such a string can reach) occur again need no more; a bucket with one surrounding only is done.
    Of the others the surroundings are fetched, one for each distinct one, and refined by doubling from the buckets of
    later offsets until strings of `length` bytes have names. Large buckets are cut into blocks; strings that a block
    holds once meet those of the other blocks in grouped counts, first by what CELL neighbours have in common.

    NULL is an empty text. Repeated rows are repeats of each other. A NULL doc_id is a doc_id like others. An empty
    table gives an empty one. Columns called like a result are an error; other names are free. Texts are compared by
    hashes: 128 bits for whole surroundings, 64 bits for strings within a bucket; rows are told apart by 64 bits of
    doc_id and text. Two shuffles of narrow anchor rows, two of the texts.
    """
    results = {"n_bytes", "n_removed", "n_spans", "kept"}
    if clash := {c.lower() for c in docs.columns} & results:
        raise ValueError(f"columns with the names of results: {sorted(clash)}")
    source = docs.select(F.xxhash64(doc_id, text).alias("rid"), F.col(text).alias("text"))
    rows = _anchor_rows(source, length)
    classes = rows.groupBy("gram", "around").agg(F.count("*").alias("n"), F.min(F.struct("rid", "at")).alias("one"))
    classes = stored(classes, "surroundings")
    # stored, so that the join below shuffles both sides and adaptive execution can cut the rows of a frequent gram
    wide = stored(classes.groupBy("gram").agg(F.count("*").alias("k")).where("k > 1"), "buckets")
    again = classes.where("n > 1").select("gram", "around")
    reach = length - GRAM
    sure = rows.join(again, ["gram", "around"]).select("rid", (F.col("at") - reach).alias("a"), (F.col("at") + length).alias("b"))

    asked = classes.join(wide, "gram").select("one.rid", F.struct("one.at", "gram", "n", "k").alias("x"))
    asked = asked.groupBy("rid").agg(F.collect_list("x").alias("asked"))

    def cut(batches):
        for batch in small(batches, 64):
            out = {"rid": [], "at": [], "gram": [], "n": [], "k": [], "off": [], "context": []}
            for rid, wanted, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2))):
                for x in wanted:
                    a, b = _around(len(text), x["at"], length)
                    for name, value in (("rid", rid), ("at", x["at"]), ("gram", x["gram"]), ("n", x["n"]), ("k", x["k"])):
                        out[name].append(value)
                    out["off"].append(x["at"] - a)
                    out["context"].append(text[a:b])
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))

    one_each = source.join(asked, "rid").dropDuplicates(["rid"]).select("rid", "asked", "text")
    contexts = one_each.mapInArrow(cut, "rid long, at int, gram long, n long, k long, off int, context binary")
    blocks = F.ceil(F.col("k") / BLOCK).cast("int")
    dealt = contexts.withColumn("blocks", blocks)
    dealt = dealt.withColumn("g", F.xxhash64("gram", F.pmod(F.xxhash64("rid", "at"), "blocks")))
    dealt = dealt.select("g", "rid", "at", "gram", "n", "blocks", "off", "context").repartition("g").sortWithinPartitions("g")
    met = stored(_repeats_in_blocks(dealt, length), "met")
    inside = met.where("a is not null").select("rid", "a", "b")
    spans = sure.union(inside).union(_across_blocks(met, length))
    spans = spans.groupBy("rid").agg(F.collect_set(F.struct("a", "b")).alias("spans"))

    key, gone = spare("rid", docs.columns), spare("spans", docs.columns)
    left = docs.withColumn(key, F.xxhash64(doc_id, text))
    joined = left.join(spans.select(F.col("rid").alias(key), F.col("spans").alias(gone)), key, "left")
    inner = spare("text_in", docs.columns)
    columns = docs.columns
    joined = joined.select(*columns, F.col(text).alias(inner), gone)

    def rebuild(batches):
        for batch in small(batches):
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            for data, own in zip(text_bytes(batch.column(len(columns))), batch.column(len(columns) + 1).to_pylist()):
                parts, at, count = [], 0, 0
                for s in sorted((max(s["a"], 0), min(s["b"], len(data))) for s in own or ()):
                    if s[0] > at or not count:
                        parts.append(data[at : s[0]])
                        count += 1
                    at = max(at, s[1])
                parts.append(data[at:])
                kept.append(b"".join(parts))
                n_bytes.append(len(data))
                n_removed.append(len(data) - len(kept[-1]))
                n_spans.append(count)
            counts = {n: pa.array(v, pa.int64()) for n, v in (("n_bytes", n_bytes), ("n_removed", n_removed), ("n_spans", n_spans))}
            yield with_columns(batch, columns, **counts, kept=pa.array(kept, pa.binary()))

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return joined.mapInArrow(rebuild, f"{fields}, n_bytes long, n_removed long, n_spans long, kept binary")
