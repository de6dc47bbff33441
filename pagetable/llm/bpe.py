"""BPE encoding and decoding with reuse of content-defined chunks."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pagetable.llm.tokens import ChunkEncoder
from pagetable.llm.store import spare
from pagetable.llm.worker import once, small, text_bytes, with_columns

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_OUT_BYTES = 8 << 20


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, decode: bool = True) -> DataFrame:
    """The columns `keep` (default: all) with `ids`, `n_tokens` and, if asked for, `decoded`.

    Texts are cut into chunks by a rolling hash of their own bytes; a task encodes a chunk that several documents
    share once, and the joins between chunks are repaired by encoding the words around them again until they agree.
    `ids` equals the tokenizers library's encode(text, add_special_tokens=False) without truncation, as little-endian
    unsigned 32-bit integers; `decoded` is its decode(ids, skip_special_tokens=False) in UTF-8.

    NULL and empty texts have no ids. Repeated rows give repeated results. A column of `keep` that is called like a
    result is an error. No shuffle; memory is bounded by the caches and the longest text.
    `path` is read by the workers: the tokenizer file is installed with the tokenizer library on every machine.
    """
    kept = docs.columns if keep is None else keep
    added = [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())]
    added += [T.StructField("decoded", T.BinaryType())] if decode else []
    if clash := {c.lower() for c in kept} & {f.name for f in added}:
        raise ValueError(f"columns with the names of results: {sorted(clash)}")
    inner = spare("_text", kept)
    source = docs.select(*kept, docs[text].alias(inner))
    schema = T.StructType([docs.schema[k] for k in kept] + added)

    def run(batches):
        encoder = once(("encoder", path), lambda: ChunkEncoder(path, words_kept=75_000))
        for batch in small(batches, 1024):
            coded = encoder.encode_many(text_bytes(batch.column(inner)))
            start, decoded, size = 0, [], 0
            for at, ids in enumerate(coded):
                size += len(ids)
                if decode:
                    decoded.append(encoder.decode(ids))
                    size += len(decoded[-1])
                if size >= _OUT_BYTES or at == batch.num_rows - 1:
                    own = coded[start : at + 1]
                    new = {"ids": pa.array(own, pa.binary()), "n_tokens": pa.array([len(i) // 4 for i in own], pa.int64())}
                    if decode:
                        new["decoded"] = pa.array(decoded, pa.binary())
                    yield with_columns(batch.slice(start, at + 1 - start), kept, **new)
                    start, decoded, size = at + 1, [], 0
        encoder.forget()  # the worker goes on to other stages

    return source.mapInArrow(run, schema)
