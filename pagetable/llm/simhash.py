"""Near-duplicate documents by SimHash fingerprints, candidates pruned by pigeonring chains."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetable.llm.blocks import block_pairs, together
from pagetable.llm.components import components
from pagetable.llm.store import spare, stored
from pagetable.llm.worker import forest, small, text_bytes, whole_groups

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS = 3
BITS = 3
_SEED = 42
_PIECE = 1 << 16


def fingerprint(data: bytes, words: int = WORDS) -> int:
    """SimHash of a text: bit b is 1 if it is set in more than half of the XXH64 values of the word shingles."""
    tokens = data.lower().split()
    if not tokens:
        return 0
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    ends = starts + lengths
    n = max(len(tokens) - words + 1, 1)
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    last = ends[words - 1 :] if len(tokens) >= words else ends[-1:]
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _PIECE):
        cut = zip(starts[at : min(at + _PIECE, n)].tolist(), last[at : at + _PIECE].tolist())
        hashes = np.array([digest(joined[s:e], _SEED) for s, e in cut], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fp) per row of `docs`; fp as a signed long."""
    return _fingerprints(docs.select(F.col(doc_id).cast("long").alias("doc_id"), text), words)


def _fingerprints(rows: DataFrame, words: int) -> DataFrame:
    """`rows` (columns of longs, then text last) with fp in place of the text."""
    kept = rows.columns[:-1]

    def run(batches):
        for batch in small(batches):
            fps = np.array([fingerprint(t, words) for t in text_bytes(batch.column(len(kept)))], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(fps.view(np.int64))], names=[*kept, "fp"])

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in [*kept, "fp"]))


def ring(bits: int) -> list[tuple[int, int]]:
    """(shift, width) of the bits + 1 consecutive segments of a fingerprint."""
    m = bits + 1
    edges = [64 * i // m for i in range(m + 1)]
    return [(edges[i], edges[i + 1] - edges[i]) for i in range(m)]


def _mask(shift: int, width: int) -> int:
    return ((1 << width) - 1) << shift


def chain_keys(bits: int) -> list[tuple[int, int]]:
    """(start segment, mask) of the parts of a fingerprint of which two linked fingerprints share at least one.

    Of the bits + 1 segments in a ring, some start has a chain in which the first l segments differ in at most
    l * bits / (bits + 1) bits for every l: none in the first, one in two, two in three. So of the halves of the
    second and third segment one or two are equal as well, and the key holds them too.
    """
    segments = ring(bits)
    m, found = len(segments), []
    for i in range(m):
        first = _mask(*segments[i])
        halves = []
        for j in (1, 2)[: min(2, m - 1)]:
            shift, width = segments[(i + j) % m]
            low = width // 2
            halves.append((_mask(shift, low), _mask(shift + low, width - low)))
        if len(halves) < 2:
            found += [(i, first | h) for pair in halves for h in pair] or [(i, first)]
        else:
            (a, b), (c, d) = halves
            found += [(i, first | x) for x in (a | b, a | c, a | d, b | c, b | d)]
    return found


def links(nodes: DataFrame, bits: int = BITS, block: int = 256) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints `fp` that connect what links of `bits` or fewer differing bits connect.

    Fingerprints meet in groups by the keys of `chain_keys`. In a group, pairs whose chain exceeds a budget are pruned
    before the whole distance is taken, and only a spanning forest of the links found leaves it, never all pairs.
    """
    if not bits:
        return nodes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    keys = chain_keys(bits)
    signed = [m - (1 << 64) if m >> 63 else m for _, m in keys]
    probes = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for k, m in enumerate(signed)])
    rows = nodes.select("fp", F.explode(probes).alias("p")).select("p.k", "p.part", "fp")
    segments = ring(bits)
    masks = np.array([[_mask(*segments[(i + j) % len(segments)]) for j in range(len(segments))] for i, _ in keys], np.uint64)
    budgets = [(j + 1) * bits // (bits + 1) for j in range(len(segments))]

    def run(batches):
        for table, bounds in whole_groups(batches, "g"):
            fp = table.column("fp").to_numpy().view(np.uint64)
            side, k = table.column("side").to_numpy(), table.column("k").to_numpy()
            stop = np.repeat(bounds[1:], np.diff(bounds))
            crossing = np.maximum.reduceat(side, bounds[:-1]).repeat(np.diff(bounds)) > 0
            found = []
            left, apart = np.arange(len(fp)), 1
            while True:
                left = left[left + apart < stop[left]]
                if not len(left):
                    break
                right = left + apart
                ok = (side[left] != side[right]) | ~crossing[left]
                l, r = left[ok], right[ok]
                differ, spent = fp[l] ^ fp[r], np.zeros(len(l), np.uint8)
                for j, budget in enumerate(budgets):  # the chain from the key's start segment; its end is the whole distance
                    spent = spent + np.bitwise_count(differ & masks[k[l], j])
                    ok = spent <= budget
                    l, r, differ, spent = l[ok], r[ok], differ[ok], spent[ok]
                found.append((l, r))
                apart += 1
            if found:
                child, root = forest(len(fp), np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
                signed_fp = fp.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(signed_fp[child]), pa.array(signed_fp[root])], names=["a", "b"])

    dealt = together(block_pairs(rows, ["k", "part"], "fp", block))
    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, bits: int = BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row: component_id is the smallest doc_id that links reach.

    Words are what ASCII white space separates, ASCII letters in lower case; a shingle is `words` of them (a shorter
    text is one shingle). Fingerprints link at `bits` or fewer differing bits.

    NULL, empty and blank texts have fingerprint zero, which links like any other. Rows with equal fingerprints, so
    also repeated rows, are one node of the link graph: copies are counted once before any join. A NULL doc_id gets a
    component like others but names none unless all its members are NULL. Extra columns are ignored; an empty table
    gives an empty one.
    """
    groups = _grouped(fingerprints(docs, doc_id, text, words), bits)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return groups.select("doc_id", digits, "component_id")


def _grouped(prints: DataFrame, bits: int) -> DataFrame:
    """`prints` with the root of each row's component, a fingerprint, and component_id."""
    prints = stored(prints, "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(links(nodes.select("fp"), bits), "a", "b")
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(rooted.join(least, "root").select("fp", "root", "component_id"), "fp")


def one_per_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, bits: int = BITS) -> DataFrame:
    """`docs` with one row per component: that of its smallest doc_id, once. Rows with a NULL doc_id stay: no component
    can be named after them.

    Different texts under one doc_id are told apart by a hash of the text, so each of their components keeps its row. Of
    several texts of the smallest doc_id in one component the one with the least hash stays, of several rows with that
    text the first by its other columns, written as JSON.
    """
    key = spare("text_key", docs.columns)
    keyed = docs.withColumn(key, F.xxhash64(text))
    prints = keyed.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(key).alias("text_key"), F.col(text))
    named = _grouped(_fingerprints(prints, words), bits).where("doc_id = component_id")
    keep = named.groupBy("root", F.col("doc_id").alias("_keep")).agg(F.min("text_key").alias("_key"))
    same = (keyed[doc_id] == keep["_keep"]) & (keyed[key] == keep["_key"])
    row, others = F.struct(*docs.columns), F.to_json(F.struct(*[c for c in docs.columns if c != text]))
    kept = keyed.join(keep, same, "left_semi").groupBy(doc_id, key).agg(F.min_by(row, others).alias("row")).select("row.*")
    return kept.unionByName(docs.where(docs[doc_id].isNull()))
