"""Groups of spelling variants: words at one edit's distance by a variable-length gram index."""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetable.llm.blocks import block_pairs, together
from pagetable.llm.store import stored
from pagetable.llm.worker import small, text_bytes, whole_groups

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LETTERS = 90  # a-z and U+00C0 to U+00FF
GRAMS = LETTERS**2 + LETTERS**3  # grams of two letters, then of three
FREQUENT = 0.001
LEAST_LENGTH, LEAST_COUNT, LEAST_RATIO = 6, 5, 5
TYPO_EVERY = 199
HELD = 100_000

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_CODE = np.zeros(256, np.int64)
_CODE[97:123] = np.arange(26)
_CODE[0xC0:] = np.arange(26, LETTERS)
_PAD = 3


def occurrences(doc_id: str, text: str, every: int = TYPO_EVERY, least: int = LEAST_LENGTH) -> Counter:
    """The words of a text, each run in the spelling that its hash with the document's id gives it."""
    found: Counter = Counter()
    start = zlib.crc32(f"{doc_id}:".encode())
    for run, n in Counter(_RUN.findall(text.translate(_LOWER))).items():
        if len(run) < least:
            continue  # a deletion only makes it shorter
        h = zlib.crc32(run.encode(), start)
        if h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= least:
            found[run] += n
    return found


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of at least `least_length` letters with `least_count` occurrences in all texts."""

    def run(batches):
        held: Counter = Counter()

        def out():
            rows = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return rows

        for batch in small(batches):
            for name, data in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                held.update(occurrences(name, data.decode(), least=least_length))
                if len(held) > HELD:
                    yield out()
        yield out()

    named = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc_id"), F.col(text).alias("text"))
    return named.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Laid:
    """Words laid out letter by letter in one array, with room behind each, and all their grams of two and three."""

    def __init__(self, words: list[str]):
        self.words = words
        self.length = np.array([len(w) for w in words], np.int64)
        self.first = np.cumsum(self.length + _PAD) - self.length - _PAD
        raw = np.frombuffer((" " * _PAD).join(words).encode("latin-1") + b" " * 2 * _PAD, np.uint8)
        self.letter = _CODE[raw]
        self.owner = np.repeat(np.arange(len(words)), self.length + _PAD)
        size = len(self.owner)
        self.at = np.arange(size) - self.first[self.owner]
        self.two = (self.letter[:size] * LETTERS + self.letter[1 : size + 1]).astype(np.int64)
        self.three = LETTERS**2 + self.two * LETTERS + self.letter[2 : size + 2]
        self.has_two, self.has_three = self.at <= self.length[self.owner] - 2, self.at <= self.length[self.owner] - 3


def gram_counts(words: DataFrame) -> np.ndarray:
    """How often each gram of two or three letters occurs in the words: GRAMS numbers, whatever the table."""

    def run(batches):
        total = np.zeros(GRAMS, np.int64)
        for batch in small(batches, 4096):
            laid = Laid(batch.column(0).to_pylist())
            total += np.bincount(laid.two[laid.has_two], minlength=GRAMS) + np.bincount(laid.three[laid.has_three], minlength=GRAMS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["gram", "n"])

    found = words.select("word").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(GRAMS, np.int64)
    counts[found.column("gram").to_numpy()] = found.column("n").to_numpy()
    return counts


class Dictionary:
    """The gram dictionary: all grams of two letters, and in place of each that is frequent its continuations by a letter.

    `counts` also orders the grams: rare ones first.
    """

    def __init__(self, counts: np.ndarray, frequent: float = FREQUENT):
        two = counts[: LETTERS**2]
        self.longer = two > max(frequent * int(two.sum()), 1)
        self.ends = self.longer.reshape(LETTERS, LETTERS).any(axis=0)  # letters that end a frequent gram of two
        self.counts = counts

    def parts(self, laid: Laid):
        """(kept, gram): at which places a word has a gram of its own, and which. The longest gram of the dictionary counts at
        each place, unless an earlier one covers it."""
        longer = laid.has_two & self.longer[laid.two]
        three = longer & laid.has_three
        covered = laid.has_two & ~three
        covered[1:] &= three[:-1]
        covered[:1] = False
        return laid.has_two & ~covered, np.where(three, laid.three, laid.two), longer, three

    def affected(self, laid: Laid, kept, longer, three) -> np.ndarray:
        """Per word the most of its grams that one edit can take away, over all places of the edit.

        An edit of the letter at i takes the grams that contain it; the one that begins two places before it, if that
        is frequent and so may be continued differently; and a gram of two right behind it, if a longer one that ends
        there may come to cover it. An insertion before i is no more than an edit of i, or of the last letter.
        """
        ext = (kept & longer).astype(np.int64)
        own = kept.astype(np.int64)
        size = len(own)
        behind = (kept & ~three & self.ends[laid.letter[:size]]).astype(np.int64)

        def moved(a, by):
            out = np.zeros(size, np.int64)
            if by > 0:
                out[by:] = a[: max(size - by, 0)]
            elif by < 0:
                out[:by] = a[-by:]
            return out

        left = moved(ext, 2) + moved(own, 1)
        most = np.maximum(left + own + moved(behind, -1), left + behind)
        inside = laid.at <= laid.length[laid.owner]  # also an insertion at the end
        return np.maximum.reduceat(np.where(inside, most, 0), laid.first) if len(laid.words) else np.zeros(0, np.int64)

    def index(self, words: list[str]):
        """(owner, gram, place) of the rarest grams of each word: one more than an edit can take away. Two words at one edit's
        distance have a gram in common among these, as far from the begin or as far from the end in both."""
        laid = Laid(words)
        kept, gram, longer, three = self.parts(laid)
        bound = self.affected(laid, kept, longer, three)
        at = np.flatnonzero(kept)
        owner, gram, place = laid.owner[at], gram[at], laid.at[at]
        order = np.lexsort((place, gram, self.counts[gram], owner))
        owner, gram, place = owner[order], gram[order], place[order]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        chosen = rank <= bound[owner]
        return owner[chosen], gram[chosen], place[chosen], laid.length

    def keys(self, words: list[str]):
        """(owner, key, longer): where each word is listed. A key names a gram, its place and the length of the shorter word; the
        longer one of a pair has it at that place or the next."""
        owner, gram, place, length = self.index(words)
        size = length[owner]
        key = lambda p, n: (gram << np.int64(42)) | ((p & 0x1FFFFF) << np.int64(21)) | (n & 0x1FFFFF)
        fine = place > 0
        listed = [key(place, size), key(place, size - 1), key(place - 1, size - 1)[fine]]
        owners = np.concatenate([owner, owner, owner[fine]])
        role = np.repeat([0, 1, 1], [len(k) for k in listed])
        rows = np.unique(np.stack([owners, np.concatenate(listed), role], 1), axis=0) if len(owners) else np.zeros((0, 3), np.int64)
        return rows[:, 0], rows[:, 1], rows[:, 2]

    def shared_bounds(self, words: list[str]):
        """For list merging: (tokens per word as a 0/1 matrix, the least number of tokens that a near word shares). The
        second occurrence of a gram in a word is a token of its own."""
        laid = Laid(words)
        kept, gram, longer, three = self.parts(laid)
        bound = self.affected(laid, kept, longer, three)
        at = np.flatnonzero(kept)
        owner, gram = laid.owner[at], gram[at]
        order = np.lexsort((gram, owner))
        owner, gram = owner[order], gram[order]
        both = owner * np.int64(GRAMS) + gram
        again = np.arange(len(both)) - np.searchsorted(both, both)
        _, token = np.unique(gram * np.int64(1 << 20) + again, return_inverse=True)
        told = np.zeros((len(words), int(token.max(initial=-1)) + 1), np.float32)
        told[owner, token] = 1
        return told, np.bincount(owner, minlength=len(words)) - bound


def one_edit(words: list[str], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs of different words (as places in `words`) differ by one inserted, deleted or replaced letter."""
    longest = max(map(len, words))
    ahead = np.zeros((len(words), longest + 1), np.uint8)
    back = np.zeros_like(ahead)
    for i, w in enumerate(words):
        raw = np.frombuffer(w.encode("latin-1"), np.uint8)
        ahead[i, : len(raw)] = raw
        back[i, : len(raw)] = raw[::-1]
    length = np.array(list(map(len, words)))
    out = np.zeros(len(left), bool)
    step = max((1 << 22) // (longest + 1), 1)
    for a in range(0, len(left), step):
        i, j = left[a : a + step], right[a : a + step]
        # rows end in zeros, and a letter that only one has ends the common part
        head = (ahead[i] != ahead[j]).argmax(axis=1)
        tail = (back[i] != back[j]).argmax(axis=1)
        out[a : a + step] = (np.abs(length[i] - length[j]) <= 1) & (head + tail >= np.maximum(length[i], length[j]) - 1)
    return out


def near_words(words: DataFrame, frequent: float = FREQUENT, block: int = 128) -> DataFrame:
    """(word, n_near, best_n, best) for every word of (word, n) with another at one edit's distance.

    Words are listed under their rarest grams with place and length; a list is dealt in pairs of blocks. Words in a pair of
    blocks that share as many grams as both their bounds ask for are verified letter by letter. A pair
    counts under the first key that both words are listed under. What leaves a pair of blocks is one row per word.
    """
    spark = words.sparkSession
    sent = spark.sparkContext.broadcast(Dictionary(gram_counts(words), frequent))  # at most GRAMS numbers

    def listed(batches):
        for batch in small(batches, 2048):
            own = batch.column(0).to_pylist()
            owner, key, role = sent.value.keys(own)
            columns = [pa.array(key), pa.array(role.astype(np.int32)), *(c.take(pa.array(owner)) for c in batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "role", "word", "n"])

    lists = words.select("word", "n").mapInArrow(listed, "key long, role int, word string, n long")
    # a key without a shorter word holds no pair of its own
    lists = stored(lists, "spelling-lists")
    some = lists.groupBy("key").agg(F.min("role").alias("least"), F.count("*").alias("many")).where("least = 0 and many > 1")
    dealt = together(block_pairs(lists.join(some.select("key"), "key", "left_semi"), ["key"], "word", block))

    def compare(batches):
        for table, bounds in whole_groups(batches, "g", 1 << 11):
            word, n = table.column("word").to_pylist(), table.column("n").to_numpy()
            key, role, side = (table.column(c).to_numpy() for c in ("key", "role", "side"))
            lefts, rights = [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                told, least = sent.value.shared_bounds(word[a:b])
                own = role[a:b]
                meet = (told @ told.T >= np.maximum(least[:, None], least[None, :])) & (own[:, None] + own[None, :] <= 1)
                meet &= key[a:b][:, None] == key[a:b][None, :]
                if side[a:b].any():
                    meet &= side[a:b][:, None] != side[a:b][None, :]
                i, j = np.nonzero(np.triu(meet, 1))
                lefts.append(i + a)
                rights.append(j + a)
            left, right = np.concatenate(lefts), np.concatenate(rights)
            if not len(left):
                continue
            # words far apart in length stand in different groups, so only those of pairs are laid out
            fine = np.zeros(len(left), bool)
            lengths = np.array(list(map(len, word)))[left]
            for some_length in np.unique(lengths):
                at = np.flatnonzero(lengths == some_length)
                used, place = np.unique(np.concatenate([left[at], right[at]]), return_inverse=True)
                fine[at] = one_edit([word[u] for u in used], place[: len(at)], place[len(at) :])
            left, right = left[fine], right[fine]
            if not len(left):
                continue
            first = _first_keys(sent.value, word, left, right)
            left, right = left[first == key[left]], right[first == key[left]]
            best: dict[str, tuple[int, int, str]] = {}
            for i, j in zip([*left.tolist(), *right.tolist()], [*right.tolist(), *left.tolist()]):
                many, top, name = best.get(word[i], (0, -1, ""))
                if n[j] > top or (n[j] == top and word[j] < name):
                    top, name = int(n[j]), word[j]
                best[word[i]] = (many + 1, top, name)
            columns = [pa.array(list(best), pa.string()), pa.array([v[0] for v in best.values()], pa.int64())]
            columns += [pa.array([v[1] for v in best.values()], pa.int64()), pa.array([v[2] for v in best.values()], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "many", "top", "name"])

    found = dealt.mapInArrow(compare, "word string, many long, top long, name string")
    best = F.min(F.struct((-F.col("top")).alias("less"), F.col("name")))
    told = found.groupBy("word").agg(F.sum("many").alias("n_near"), best.alias("best"))
    return told.select("word", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.name").alias("best"))


def _first_keys(grams: Dictionary, word: list[str], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least key under which both words of each pair are listed, at most one of them as the longer one."""
    used = np.unique(np.concatenate([left, right]))
    owner, key, role = grams.keys([word[u] for u in used])
    lists: list[set] = [set() for _ in used]
    for o, k, r in zip(owner.tolist(), key.tolist(), role.tolist()):
        lists[o].add((k, r))
    out = []
    for i, j in zip(np.searchsorted(used, left).tolist(), np.searchsorted(used, right).tolist()):
        a, b = lists[i], lists[j]
        out.append(min(k for k, r in a if (k, 0) in b or (r == 0 and (k, 1) in b)))
    return np.array(out, np.int64)


def spelling_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
    ratio: int = LEAST_RATIO, frequent: float = FREQUENT, block: int = 128,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) per word of all texts.

    Words are runs of the letters A-Z, a-z and U+00C0 to U+00FF with A-Z in lower case; of a run whose hash with the
    document's id is divisible by TYPO_EVERY one letter goes. Those of at least `least_length` letters (6 at least: shorter ones may
    share no gram) and `least_count` occurrences count. `form` is the most frequent word at one edit's distance (ties: the first in
    code-point order) if it is `ratio` times as frequent, `root` the end of the chain of forms, `n_near` the number of words
    at one edit's distance.

    NULL and empty texts have no words, repeated rows count each, a NULL id counts as an empty one; extra columns are
    ignored; an empty table gives an empty one. Very long runs are words like any other.
    """
    if least_length < 6:
        raise ValueError("words of fewer than 6 letters may share no gram with a near word")
    words = stored(word_counts(docs, doc_id, text, least_length, least_count), "spelling-words")
    near = near_words(words, frequent, block)
    joined = words.join(near, "word", "left")
    fits = F.col("best_n") >= ratio * F.col("n")
    told = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n"))
    told = stored(told, "spelling-forms")
    # every form is `ratio` times as frequent: chains are short, and each round doubles what a step covers
    ends = stored(told.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stored(ends.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        ends = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    whole = told.join(ends, "word", "left")
    return whole.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
