"""Token ids of whole texts with a given tokenizer file, with work shared between equal chunks. Runs inside tasks."""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[48:58] = _PLAIN[97:123] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[33:48] = _PUNCTUATION[58:65] = _PUNCTUATION[91:97] = _PUNCTUATION[123:127] = True
_PUNCTUATION[39] = False  # an apostrophe may begin a contraction


def cuts(texts: list[bytes], mean: int) -> list[list[bytes]]:
    """The content-defined chunks of each text: cut after white space, where a rolling hash of 16 bytes says so.

    A cut depends on the 16 bytes before it alone, so equal passages are cut alike wherever they stand; there is
    none in the first 16 bytes of a text. `mean` is about the mean length of a chunk.
    """
    data = b"".join(texts)
    octets = np.frombuffer(data, np.uint8)
    rolled = octets.astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(0x85EBCA6B)
    step, factor = 1, 0x01000193
    while step < 16:  # doubles the window: h(i, 2n) = h(i, n) + factor^n * h(i - n, n)
        rolled[step:] += rolled[:-step] * np.uint32(factor)
        factor = factor * factor & 0xFFFFFFFF
        step *= 2
    at = np.flatnonzero(_SPACE[octets])
    mixed = rolled[at]
    mixed = (mixed ^ mixed >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
    per_space = max(mean // 6, 1)  # white space is about every sixth byte of prose
    ends = at[(mixed >> np.uint32(16)) % np.uint32(per_space) == 0] + 1
    out, first = [], 0
    bounds = np.cumsum([len(t) for t in texts])
    low = np.searchsorted(ends, bounds - [len(t) - 16 for t in texts])
    high = np.searchsorted(ends, bounds)
    for text, a, b, end in zip(texts, low.tolist(), high.tolist(), bounds.tolist()):
        own = [first, *ends[a:b].tolist(), end] if a < b else [first, end]
        out.append([data[x:y] for x, y in zip(own, own[1:]) if y > x])
        first = end
    return out


def _packed(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of up to 16 bytes as two integers each: their bytes, and zeros behind."""
    around = np.lib.stride_tricks.as_strided(data, (len(data) - 15, 16), (1, 1))
    pairs = around[start].view("<u8")
    return pairs[:, 0] & _LOW[np.minimum(length, 8)], pairs[:, 1] & _LOW[np.maximum(length - 8, 0)]


# words of these letters alone are left as they are by NFC and by lower-casing
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
# their bytes as characters of a byte-level vocabulary: those that do not stand for themselves
_SHOWN = [("\x9f", "\u0141"), ("\xa0", "\u0142"), ("\xad", "\u0143")]
_BETWEEN = b"|"
_TOGETHER = 1024
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class ChunkEncoder:
    """Encodes and decodes with a `tokenizers` file. Equal chunks are encoded once while they stay in the cache.

    A text's ids are the concatenation of its chunks' ids after the joins are repaired (`_joined`). Where the file
    says that white space never is part of a token, a chunk is put together from its words: the distinct words of
    all new chunks are looked up at once. Caches are emptied when full (words: the older half); results do not
    depend on them.
    """

    def __init__(self, path: str, mean_chunk: int = 2048, chunks_kept: int = 4_000, words_kept: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        spec = json.loads(self.lib.to_str())
        self.mean, self.chunks_kept, self.words_kept = mean_chunk, chunks_kept, words_kept
        added = spec.get("added_tokens", [])
        self.by_word = _drops_space(spec)
        self.parts_marks = self.by_word and _pattern(spec).endswith(_LETTERS_AND_MARKS)
        # the model alone has the ids of plain words: what comes before it leaves them as one piece
        self.model = self.lib.model if self.by_word and _keeps_letters(spec) else None
        # upper-case ASCII may be folded before the cache where the file folds it anyway
        self.folds = self.by_word and "Lowercase" in json.dumps(spec.get("normalizer"))
        self.marks = {t["content"].encode().lower() for t in added}
        self.plain = spec.get("decoder") is None
        size = self.lib.get_vocab_size(with_added_tokens=True)
        self.pieces = [(self.lib.id_to_token(i) or "").encode() for i in range(size)]
        between = self.direct(_BETWEEN)
        self.between = int(np.frombuffer(between, "<u4")[0]) if len(between) == 4 else None
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.chunks: dict[bytes, bytes] = {}
        self.joins: dict[bytes, bool] = {}

    def direct(self, data: bytes) -> bytes:
        ids = self.lib.encode(data.decode(), add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def _word_ids(self, words: list[bytes]) -> list[bytes]:
        if len(self.words) >= self.words_kept:
            self.words, self.older = {}, self.words
        known, older = self.words, self.older
        out = list(map(known.get, words))
        new = [i for i, ids in enumerate(out) if ids is None]
        met = {words[i]: older.get(words[i]) for i in new}
        fresh = [w for w, ids in met.items() if not ids]
        met.update(zip(fresh, self._apart(fresh)))
        known.update(met)
        for i in new:
            out[i] = met[words[i]]
        return out

    def _apart(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of these words. Plain ones go to the model, and of the others many short ones are encoded in one
        call, told apart by a mark between them. Its id comes once for every mark; if more are found, a word has it too, and
        the words are encoded one by one."""
        out: list[bytes | None] = [None] * len(words)
        if self.model is not None:
            plain = [i for i, w in enumerate(words) if len(w) <= 256 and _LETTERS.fullmatch(w)]
            shown = b" ".join([words[i] for i in plain]).decode("latin-1")
            for byte, char in _SHOWN:
                shown = shown.replace(byte, char)
            pieces = self.model.tokenize
            for i, word in zip(plain, shown.split(" ")):
                out[i] = array("I", [t.id for t in pieces(word)]).tobytes()
        rest = [i for i, ids in enumerate(out) if ids is None]
        joined = [i for i in rest if len(words[i]) <= 256 and _BETWEEN not in words[i]] if self.between is not None else []
        for at in range(0, len(joined), _TOGETHER):
            own = joined[at : at + _TOGETHER]
            text = (b" %s " % _BETWEEN).join([words[i] for i in own]).decode()
            ids = np.array(self.lib.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            marks = np.flatnonzero(ids == self.between)
            if len(marks) == len(own) - 1:
                raw = ids.tobytes()
                for i, a, b in zip(own, [0, *(4 * marks + 4).tolist()], [*(4 * marks).tolist(), len(raw)]):
                    out[i] = raw[a:b]
        return [self.direct(w) if ids is None else ids for w, ids in zip(words, out)]

    def _from_words(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of chunks without special tokens: of each distinct word once, then gathered for all words."""
        text = b" ".join(chunks)
        data = np.frombuffer((text.lower() if self.folds else text) + b" " * 16, np.uint8)
        inside = (~_SPACE[data]).view(np.int8)
        edges = np.diff(inside, prepend=np.int8(0), append=np.int8(0))
        start, stop = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        if self.parts_marks:
            core = stop.copy()  # punctuation behind an ASCII letter or digit is a word of its own
            for _ in range(4):
                core -= _PUNCTUATION[data[core - 1]] & (core - 1 > start)
            core = core[(core < stop) & _PLAIN[data[core - 1]]]
            start, stop = np.sort(np.concatenate([start, core])), np.sort(np.concatenate([stop, core]))
        length = stop - start
        short = length <= 16
        low, high = _packed(data, np.where(short, start, 0), np.where(short, length, 0))
        mixed = (low ^ (low >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (high ^ (high >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        mixed += length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # a word may end in zero bytes
        far = np.flatnonzero(~short)
        mixed[far] = np.arange(len(far), dtype=np.uint64)  # long words are looked up one by one
        order = np.argsort(mixed)
        same = np.ones(max(len(order) - 1, 0), bool)
        for key in (mixed, low, high, length):
            ranked = key[order]
            same &= ranked[1:] == ranked[:-1]
        if len(far):
            ranked = short[order]
            same &= ranked[1:] & ranked[:-1]
        first = np.concatenate([[True], ~same]) if len(order) else np.zeros(0, bool)
        kind = np.empty(len(order), np.int32)
        kind[order] = np.cumsum(first, dtype=np.int32) - 1
        lead = order[first]
        raw = data.tobytes()
        ids = self._word_ids([raw[a:b] for a, b in zip(start[lead].tolist(), stop[lead].tolist())])
        pool = np.frombuffer(b"".join(ids), "<u4")
        count = np.array([len(i) // 4 for i in ids], np.int32)
        offset = np.cumsum(count, dtype=np.int32) - count
        own = count[kind]
        ends = np.cumsum(own, dtype=np.int32)  # of one slice of texts: far below 2^31
        total = int(ends[-1]) if len(ends) else 0
        gathered = pool.take(np.arange(total, dtype=np.int32) + np.repeat(offset[kind] - (ends - own), own)).tobytes()
        bounds = np.cumsum([len(c) + 1 for c in chunks])
        ends = np.concatenate([[0], ends])[np.searchsorted(start, bounds)]
        begins = np.concatenate([[0], ends[:-1]])
        return [gathered[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist())]

    def _marked(self, data: bytes) -> bool:
        """Whether there may be a special token, which is found in the text as it stands."""
        folded = data.lower()
        return any(m in folded for m in self.marks)

    def _encode_chunks(self, chunks: list[bytes]) -> None:
        """Puts the ids of all these distinct chunks in the cache."""
        if self.by_word:
            marked = [c for c in chunks if self._marked(c)]
            plain = [c for c in chunks if not self._marked(c)] if marked else chunks
            self.chunks.update(zip(plain, self._from_words(plain)) if plain else ())
        else:
            marked = chunks
        self.chunks.update((c, self.direct(c)) for c in marked)

    def encode_many(self, texts: list[bytes]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers."""
        if len(self.chunks) >= self.chunks_kept:
            self.chunks.clear()
        pieces = cuts(texts, self.mean)
        self._encode_chunks(list({c for own in pieces for c in own if c not in self.chunks}))
        self._compare_joins(pieces)
        return [self._put_together(own) for own in pieces]

    def encode(self, data: bytes) -> bytes:
        return self.encode_many([data])[0]

    def _put_together(self, chunks: list[bytes]) -> bytes:
        out: list[bytes] = []
        before = b""
        for chunk in chunks:
            ids = self.chunks[chunk]
            if before and not self.joins.get(_join_key(before, chunk), False):
                repaired = self._joined(before, chunk, out[-1], ids)
                if repaired is None:
                    before += chunk
                    out[-1] = self.direct(before)
                    continue
                out[-1], ids, moved = repaired
                chunk = chunk[moved:]
            out.append(ids)
            before = chunk
        return b"".join(out)

    def _compare_joins(self, pieces: list[list[bytes]]) -> None:
        """Notes for every join whether the words beside it give the same ids together as apart."""
        if len(self.joins) > 1 << 15:
            self.joins.clear()
        keys = {_join_key(a, b) for own in pieces for a, b in zip(own, own[1:])}
        new = [k for k in keys if k not in self.joins]
        sides = [k.split(b"\0") for k in new]
        good = [len(s) == 2 and not (self.by_word and self._marked(s[0] + s[1])) for s in sides]
        both = [self.direct(s[0] + s[1]) for s, ok in zip(sides, good) if ok]
        parts = [w for s, ok in zip(sides, good) if ok for w in s]
        alone = self._from_words(parts) if self.by_word else [self.direct(w) for w in parts]
        agree = iter([b == x + y for b, x, y in zip(both, alone[::2], alone[1::2])])
        self.joins.update((k, ok and next(agree)) for k, ok in zip(new, good))

    def _joined(self, left: bytes, right: bytes, left_ids: bytes, right_ids: bytes) -> tuple[bytes, bytes, int] | None:
        """The ids of two chunks with the join repaired, and how many bytes of the right one moved to the left one.
        A window of words around the join is encoded again and widened until the ids at both its ends agree with
        those of the chunks. None: no window within them does."""
        starts = [i for i in range(1, len(left)) if _SPACE[left[i]] and not _SPACE[left[i - 1]]]
        stops = [i for i in range(1, len(right)) if _SPACE[right[i]] and not _SPACE[right[i - 1]]]
        words = 2
        while words <= min(len(starts), len(stops)):
            a, b = left[starts[-words] :], right[: stops[words - 1]]
            ids_a, ids_b, both = self.direct(a), self.direct(b), self.direct(a + b)
            if (
                left_ids.endswith(ids_a)
                and right_ids.startswith(ids_b)
                and both[:8] == ids_a[:8]
                and both[-8:] == ids_b[-8:]
            ):
                return left_ids[: len(left_ids) - len(ids_a)] + both, right_ids[len(ids_b) :], len(b)
            words *= 2
        return None

    def forget(self) -> None:
        """Empties the caches."""
        self.words, self.older, self.chunks, self.joins = {}, {}, {}, {}

    def decode(self, ids: bytes) -> bytes:
        """The text of the ids, special tokens kept, in UTF-8."""
        if self.plain:  # without a decoder the library joins the pieces with spaces
            return b" ".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return self.lib.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False).encode()


def _join_key(left: bytes, right: bytes) -> bytes:
    """The last word of a chunk with the space behind it, and the first word of the next."""
    words = left.rstrip()
    last = words[-256:].rsplit(None, 1)[-1:] if len(words) < 256 or b" " in words[-256:] else [words]
    return b"%s%s\0%s" % (last[0] if last else b"", left[len(words) :], _FIRST.match(right)[0])


_FIRST = re.compile(rb"[ \t-\r]*[^ \t-\r]*")


# letters, digits and everything else are pieces apart
_LETTERS_AND_MARKS = r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


def _keeps_letters(spec: dict) -> bool:
    """Whether a word of lower-case letters in NFC reaches a BPE model unchanged and whole, as the characters of its bytes."""
    steps = spec.get("pre_tokenizer") or {}
    split, *more = steps.get("pretokenizers") or [steps]
    normal = spec.get("normalizer") or {}
    return (
        split.get("type") == "Split"
        and split.get("behavior") == "Removed"
        and split.get("invert") is True
        and _pattern(spec) == _CONTRACTIONS + _LETTERS_AND_MARKS
        and [m["type"] for m in more] == ["ByteLevel"]
        and not more[0].get("use_regex", True)
        and not more[0].get("add_prefix_space", True)
        and all(n["type"] in ("NFC", "Lowercase") or n.get("pattern") == {"Regex": r"\s+"} for n in normal.get("normalizers", [normal]) if n)
        and spec["model"]["type"] == "BPE"
        and not spec["model"].get("dropout")
    )


def _pattern(spec: dict) -> str:
    steps = spec.get("pre_tokenizer") or {}
    first = (steps.get("pretokenizers") or [steps])[0]
    return (first.get("pattern") or {}).get("Regex", r"\s")


def _drops_space(spec: dict) -> bool:
    """Whether white space separates words and is part of no token, so that words can be encoded alone."""
    steps = spec.get("pre_tokenizer") or {}
    first = (steps.get("pretokenizers") or [steps])[0]
    matched = _pattern(spec)
    normal = spec.get("normalizer") or {}
    kinds = {n["type"] for n in normal.get("normalizers", [normal]) if n}
    return (
        first.get("type") == "Split"
        and first.get("behavior") == "Removed"
        and first.get("invert") is True
        and r"\s" not in matched.replace(r"[^\s", "[^")
        and not re.search(r"\.|\\[DSWHV]|\[\^(?!\\s)", matched)  # these match white space too
        and kinds <= {"NFC", "NFD", "Replace", "Lowercase"}
        and not any(t.get("lstrip") or t.get("rstrip") or " " in t["content"] for t in spec.get("added_tokens", []))
    )
