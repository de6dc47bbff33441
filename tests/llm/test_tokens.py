"""BPE encoding and token files against the tokenizers library itself."""

import hashlib
import json
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from pagetable.llm import bpe, queries, tokenfile
from pagetable.llm.store import folder
from pagetable.llm.tokens import ChunkEncoder, cuts
from tests.llm.helpers import CASES, SF, as_set, texts

ODD = [
    "<|startoftext|> hi <|endoftext|>", "<|STARTOFTEXT|> x<|Endoftext|>y <| startoftext |>" * 60, "it's\x1cfoo  bar baz  qux\n\n\tqq " * 300,
    "é́ " * 300, "I've  ΣΑΣ İx " * 500, " " * 1000, "a≠ b = ̸c  x." * 100, "\x00 b\x00c " * 400, "ab,. c.d 's 't!? (x) 12,3 " * 200,
]


def library(name):
    return Tokenizer.from_file(queries.tokenizer(name))


def ids_of(lib, text):
    return lib.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(spark, name):
    encoder, lib = ChunkEncoder(queries.tokenizer(name), mean_chunk=64, chunks_kept=50, words_kept=200), library(name)
    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + ODD + [t for _, t in CASES]
    for at in range(0, len(docs), 37):
        own = docs[at : at + 37]
        for text, got in zip(own, encoder.encode_many([(t or "").encode() for t in own])):
            ids = np.frombuffer(got, "<u4").tolist()
            assert ids == ids_of(lib, text)
            assert encoder.decode(got).decode() == lib.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("kept", [4_000, 20])
def test_random_texts(name, kept):
    """Words that differ in zero bytes, controls, combining marks and punctuation only, in one call and across calls."""
    draw = random.Random(kept)
    letters = ["a", "file", "B", "1", "\0", "\0\0", "\x01", "\x7f", "\u0301", "\u0338", "é", "ß", "東", "İ", ".", ",", "'s", "'", "(", "_", "=", "\u200d", "😀"]
    spaces = [" ", " ", " ", "\n", "\t", "\x1c", "\u2003", "\u0085", "  "]
    encoder, lib = ChunkEncoder(queries.tokenizer(name), mean_chunk=24, chunks_kept=kept, words_kept=50 * kept), library(name)
    docs = ["see a file\0 then a file here"]
    docs += ["".join(draw.choice(letters if draw.random() < 0.7 else spaces) for _ in range(draw.randint(0, 30))) for _ in range(10_000)]
    for at in range(0, len(docs), 97):
        own = docs[at : at + 97]
        want = lib.encode_batch(own, add_special_tokens=False)
        for text, ids, got in zip(own, want, encoder.encode_many([t.encode() for t in own])):
            assert np.frombuffer(got, "<u4").tolist() == ids.ids, text


def test_pattern_that_keeps_punctuation(tmp_path):
    """A file whose words hold their punctuation: it is not split off before encoding."""
    vocab = {c: i for i, c in enumerate(["a", "b", "c", "d", ".", "d."])}
    spec = {
        "version": "1.0", "added_tokens": [], "normalizer": None, "post_processor": None, "decoder": None,
        "pre_tokenizer": {"type": "Split", "pattern": {"Regex": r"[^\s]+"}, "behavior": "Removed", "invert": True},
        "model": {"type": "BPE", "vocab": vocab, "merges": [["d", "."]]},
    }
    path = tmp_path / "own.json"
    path.write_text(json.dumps(spec))
    encoder = ChunkEncoder(str(path), mean_chunk=16)
    for text in ("abcd.", "ab d. d .", "d.. a d.\0"):
        assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == ids_of(Tokenizer.from_file(str(path)), text)


def test_equal_passages_are_cut_alike():
    passage = b"the same long passage of many words " * 60
    a, b = cuts([b"one " * 40 + passage, b"quite another beginning " * 30 + passage], 128)
    assert len(set(a) & set(b)) >= 2 and b"".join(a).endswith(passage)


def test_query_is_what_the_library_gives(spark):
    lib = library("word_bpe_49k.json")
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = []
    for r in docs:
        ids = ids_of(lib, r.text)
        raw = np.array(ids, "<u4").tobytes()
        want.append((r.doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert as_set(queries.op3_bpe(spark, SF).collect()) == as_set(want)


def test_encode_cases(spark):
    out = bpe.encode(texts(spark, CASES, _TEXT="a", source="b"), queries.tokenizer())
    assert out.columns == ["doc_id", "text", "_TEXT", "source", "ids", "n_tokens", "decoded"]
    lib = library("word_bpe_49k.json")
    for r in out.collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == ids_of(lib, r.text) and r.n_tokens == len(r.ids) // 4
    assert bpe.encode(texts(spark, []), queries.tokenizer()).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(texts(spark, CASES, IDS=1), queries.tokenizer())


def expected_file(rows, end_id=2):
    lib, start, out = library("word_bpe_49k.json"), 0, []
    for d, t in rows:
        ids = [*ids_of(lib, t), end_id]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_file_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    assert as_set(queries.op9_token_files(spark, SF).collect()) == as_set(expected_file(rows))


def test_file_cases(spark, monkeypatch):
    """A NULL id comes first, equal ids by length; blocks and files of a few documents."""
    monkeypatch.setattr(tokenfile, "BLOCK_IDS", 1000)
    out = folder(spark, "files")
    tokenfile.write_token_files(texts(spark, CASES, ids=1, part=2), queries.tokenizer(), out, 2, files=3)
    got = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in tokenfile.read_token_files(spark, out).orderBy("start").collect()]
    first = [c for c in CASES if c[0] is None]
    assert got == expected_file(first + sorted((c for c in CASES if c[0] is not None), key=lambda c: c[0]))


def test_empty_files(spark):
    out = folder(spark, "files")
    tokenfile.write_token_files(texts(spark, []), queries.tokenizer(), out, 2)
    assert tokenfile.read_token_files(spark, out).count() == 0


def test_variable_length_coding():
    draw = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 4, 5, 1000):
        ranks = draw.integers(0, 2 ** draw.integers(1, 32, n, dtype=np.uint64)).astype(np.uint32)
        control, data = tokenfile.pack(ranks)
        assert len(control) == -(-n // 4) and (tokenfile.unpack(control, data, n) == ranks).all()


def test_words_encoded_together_have_their_own_ids():
    """Words with the mark that keeps them apart, long ones, and other scripts."""
    encoder = ChunkEncoder(queries.tokenizer())
    words = [w.encode() for w in ["|", "a|b", "word", "x" * 500, "naïve", "東京都", "don't", "3.14", "́accent", " wide", "||", "!?", "ends"]]
    assert encoder._apart(words) == [encoder.direct(w) for w in words]
    assert encoder._apart([]) == []
    encoder.between = int(np.frombuffer(encoder.direct(b"word"), "<u4")[0])  # a mark that words hold too
    assert encoder._apart(words) == [encoder.direct(w) for w in words]


def test_blocks_are_read_without_a_shuffle(spark):
    out = folder(spark, "no-shuffle")
    tokenfile.write_token_files(texts(spark, [(i, f"text {i}") for i in range(50)]), queries.tokenizer(), out, 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        read = tokenfile.read_token_files(spark, out)
        assert read.count() == 50
        plan = read._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_plain_words_go_to_the_model():
    """Lower-case Latin words take no turn through the normalizer; their ids are those of the whole library."""
    encoder = ChunkEncoder(queries.tokenizer())
    draw = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
    plain = list({"".join(draw.choice(letters) for _ in range(draw.randint(1, 20))).encode() for _ in range(3000)})
    other = [w.encode() for w in ["÷", "a÷b", "É", "e\u0301", "don't", "ab1", "ǆ", "a" * 300, "<|x", "ç,"]]
    want = [encoder.direct(w) for w in plain + other]
    joint, met = encoder.lib, []

    class Counted:
        def __getattr__(self, name):
            return getattr(joint, name)

        def encode_batch_fast(self, texts, **options):
            met.extend(texts)
            return joint.encode_batch_fast(texts, **options)

    encoder.lib = Counted()
    assert encoder._apart(plain + other) == want
    assert not {w.decode() for w in plain} & {w for t in met for w in t.split()}


def test_other_files_encode_plain_words_whole(tmp_path):
    """A file that changes letters before its model, or cuts between them, gets whole words."""
    spec = json.loads(Tokenizer.from_file(queries.tokenizer()).to_str())
    for step in ({"type": "NFD"}, {"type": "Replace", "pattern": {"String": "a"}, "content": "b"}):
        own = {**spec, "normalizer": {"type": "Sequence", "normalizers": [*spec["normalizer"]["normalizers"], step]}}
        path = tmp_path / f"{step['type']}.json"
        path.write_text(json.dumps(own))
        encoder = ChunkEncoder(str(path))
        assert encoder.model is None
        lib = Tokenizer.from_file(str(path))
        assert np.frombuffer(encoder.encode("là banana señora".encode()), "<u4").tolist() == ids_of(lib, "là banana señora")
