"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, rerank with the vectors themselves."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetable.llm.blocks import block_pairs, together
from pagetable.llm.components import components
from pagetable.llm.store import stored
from pagetable.llm.worker import forest, small, whole_groups

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE = 20_000
CODE_BITS = 64
CHUNK_BITS = 16
ROUNDS = (3, 4, 6, 8, 12, 16)
COSINE = 0.98
RECALL = 0.99
PROBES = 4_000


class Quantiser:
    """Binary codes by iterative quantisation: principal directions turned so that their signs lose least."""

    def __init__(self, sample: np.ndarray, turns: int = 30, cosine: float = COSINE):
        # the mean of a small sample says little: it is drawn to zero
        self.mean = sample.sum(axis=0) / (len(sample) + 1000)
        centred = sample - self.mean
        _, _, axes = np.linalg.svd(centred.T @ centred)
        bits = min(CODE_BITS, sample.shape[1])
        main = axes[:bits].T
        flat = centred @ main
        random = np.random.default_rng(0)
        turn, _ = np.linalg.qr(random.standard_normal((bits, bits)))
        for _ in range(turns if len(sample) else 0):
            u, _, v = np.linalg.svd(np.where(flat @ turn >= 0, 1.0, -1.0).T @ flat)
            turn = (u @ v).T
        self.axes = main @ turn
        widest = max(min(CHUNK_BITS, bits // 4), 1)
        orders = [np.arange(bits)] + [random.permutation(bits) for _ in range(ROUNDS[-1] - 1)]
        same, best = self._kept_bits(sample[:PROBES], cosine), -1.0
        # the widest chunks, then the fewest rounds, by which RECALL of the pairs at the limit meet
        for width in sorted({max(widest * k // 16, 1) for k in (16, 12, 8)}, reverse=True):
            for rounds in ROUNDS:
                # in every round the code is cut into disjoint chunks, each the key of one table
                chunks = np.array([o[i : i + width] for o in orders[:rounds] for i in range(0, bits - width + 1, width)])
                met = np.zeros(len(same), bool)
                for chunk in chunks:
                    met |= same[:, chunk].all(axis=1)
                recall = met.mean() if len(met) else 1.0
                if recall > best:
                    best, self.chunks = recall, chunks
                if best >= RECALL:
                    return

    def _code(self, unit: np.ndarray) -> np.ndarray:
        return (unit - self.mean) @ self.axes >= 0

    def _kept_bits(self, unit: np.ndarray, cosine: float) -> np.ndarray:
        """Which bits of each vector stay when it is turned, in a random direction, to where its cosine is the limit."""
        aside = np.random.default_rng(1).standard_normal(unit.shape)
        aside -= (aside * unit).sum(axis=1, keepdims=True) * unit
        aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-12)
        turned = cosine * unit + max(1 - cosine**2, 0.0) ** 0.5 * aside
        return self._code(unit) == self._code(turned)

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """The key of each vector (rows) in each table."""
        code = self._code(unit)
        return (code[:, self.chunks] << np.arange(self.chunks.shape[1])).sum(axis=2).astype(np.int32)


def _unit(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    # the largest entry first, so that no square leaves the range of doubles
    rows = rows / np.abs(rows).max(axis=1, keepdims=True, initial=0)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def near_vectors(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, block: int = 256
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row: links join rows of one label with cosine of at least `cosine`.

    Equal vectors of a label are one node with a count; a rotation is fitted on at most SAMPLE of the nodes, chosen
    by hash, and every node is indexed. In each of the tables a node's key is a chunk of its code; nodes with a key in
    common are compared in pairs of blocks by the exact cosine in double precision, so nothing below it links. A pair
    counts in the first table where it meets. What leaves a pair of blocks is one count and at most one link per
    node: no list of pairs is made. Links are found by retrieval: width and number of tables are chosen so that of pairs at
    the limit, made by turning vectors of the sample in random directions, RECALL meet in some table, or as many as the
    most tables reach; closer pairs meet more often. A missed pair is found by nothing else.

    Rows whose label or vector is NULL, whose vector is empty, zero or holds a NULL or non-finite number, link with
    nothing and are their own component. Vectors of different lengths never link. Repeated rows count each. NULL ids
    link and count, but name a component only if it has no other id. Extra columns are ignored; an empty table gives
    an empty one.
    """
    wide = rows.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("label")
    )
    # NaN is greater than infinity in Spark's order
    fine = F.coalesce(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    marked = wide.withColumn("fine", fine & F.col("label").isNotNull() & F.col("v").isNotNull())
    nodes = marked.where("fine").groupBy("label", "v").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    nodes = stored(nodes.withColumn("nid", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "vectors")
    total = nodes.count()
    share = min(1.0, SAMPLE / max(total, 1))
    picked = nodes.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) <= int(share * (1 << 30)))
    sample = picked.select("dim", "v").limit(SAMPLE).toArrow().combine_chunks()
    models = {}  # a rotation per length of vectors
    for dim in sample.column("dim").unique().to_pylist():
        own = sample.filter(pc.equal(sample.column("dim"), dim)).column("v").combine_chunks()
        models[dim] = Quantiser(_unit(own), cosine=cosine)

    def key_rows(batches):
        for batch in small(batches, 4096):
            dims = np.array(batch.column(1).to_pylist())
            nid = batch.column(0).to_numpy()
            keys = [None] * len(nid)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                own = batch.column(2).take(pa.array(at))
                model = models.get(int(dim)) or Quantiser(_unit(own)[:0])
                for i, k in zip(at.tolist(), model.keys(_unit(own)).tolist()):
                    keys[i] = k
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int32()))], names=["nid", "keys"])

    keyed = nodes.select("nid", "dim", "v").mapInArrow(key_rows, "nid long, keys array<int>")
    coded = stored(nodes.join(keyed, "nid"), "codes")
    probes = coded.select("label", "dim", "nid", F.posexplode("keys").alias("t", "key"))
    dealt = block_pairs(probes, ["label", "dim", "t", "key"], "nid", block).select("g", "side", "t", "nid")
    dealt = together(dealt.join(coded.select("nid", "n", "label", "dim", "keys", "v"), "nid").drop("label"))

    def compare(batches):
        for table, bounds in whole_groups(batches, "g", 1 << 11):
            nid, n = table.column("nid").to_numpy(), table.column("n").to_numpy()
            side, t, dims = (table.column(c).to_numpy() for c in ("side", "t", "dim"))
            vectors, keys = table.column("v").combine_chunks(), table.column("keys").combine_chunks()
            counted, linked, left, right = [], [], [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if b - a < 2 or len(set(dims[a:b].tolist())) > 1:
                    continue
                unit = _unit(vectors.slice(a, b - a))
                near = unit @ unit.T >= cosine
                own = side[a:b]
                near &= own[:, None] != own[None, :] if own.any() else ~np.eye(b - a, dtype=bool)
                i, j = np.nonzero(np.triu(near, 1))
                if not len(i):
                    continue
                child, root = forest(b - a, i, j)
                left += nid[a:b][child].tolist()
                right += nid[a:b][root].tolist()
                chunk = np.array(keys.slice(a, b - a).to_pylist())
                met = (chunk[i] == chunk[j]) & (np.arange(chunk.shape[1]) < t[a])
                i, j = i[~met.any(axis=1)], j[~met.any(axis=1)]
                links = np.bincount(i, n[a:b][j], b - a) + np.bincount(j, n[a:b][i], b - a)
                some = np.flatnonzero(links)
                counted += nid[a:b][some].tolist()
                linked += links[some].astype(np.int64).tolist()
            columns = [counted + left, [None] * len(counted) + right, linked + [None] * len(left)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "links"])

    found = stored(dealt.mapInArrow(compare, "a long, b long, links long"), "vector-links")
    roots = components(found.where("b is not null").select("a", "b"), "a", "b")
    counts = found.where("links is not null").groupBy(F.col("a").alias("nid")).agg(F.sum("links").alias("links"))
    named = nodes.select("nid", "label", "v", "first", "n").join(counts, "nid", "left")
    named = named.join(roots, F.col("nid") == roots.node, "left").withColumn("root", F.coalesce("root", "nid"))
    named = named.select("label", "v", "first", "root", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least, "root").select("label", "v", "n_links", "component_id")
    linked_rows = marked.where("fine").join(named, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = marked.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = linked_rows.union(alone)
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
