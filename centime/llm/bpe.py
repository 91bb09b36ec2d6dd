"""Encoding a corpus with a byte-level BPE vocabulary, by an automaton over tokens.

Compilation starts from the automaton that accepts every token string and takes
the merges in order. The gadget of merge (a, b) -> c, at its time, takes the arc
b away behind a, makes the state behind c a copy of the state behind b, and lets
c start wherever a could. What a state forbids is fixed by the times of the
merges on the two spines that meet, so the compiled machine is four flat tables:
of each token the time and the two halves of its gadget, the arcs taken away with
their times (sorted), the byte trie of the tokens, and whether a word may begin
with a token at all. An arc is looked up by following these tables; all arcs of
all 50,000 states together would be 2.5 thousand million entries.

Texts are split into words for a whole block at once, by a table of character
classes. Distinct words of the block are encoded together: all walk the trie from
every place that a valid path has reached; the automaton allows exactly one path
over a word, and its labels are the ids. Words seen before come from a bounded
memory.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centime.llm.words import blocks

#: Folder of the public vocabularies; a parameter of every operator here.
VOCABULARIES = "/opt/tokenizers"
# The split of a text into words that the byte-level vocabularies were made with, and its endings after an apostrophe.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")

#: Characters of a block; bytes of the words that a task remembers.
BLOCK, KEEP = 1 << 20, 48 << 20
#: Bytes of words that are walked together; a longer word goes in so many places at a time.
WINDOW = 1 << 15
_NEVER = 1 << 60
#: Classes of characters.
OTHER, LETTER, NUMBER, BLANK, END = range(5)


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of bytes in vocabulary files: bytes that print stand for themselves, the rest follow from 256 on."""
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printing]
    return {chr(b): b for b in printing} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """A compiled vocabulary. Flat tables only, so that it can be broadcast (a few MB, fixed by the vocabulary)."""

    def __init__(self, pieces: dict[bytes, int], merges: list[tuple[int, int, int]]):
        """pieces: bytes -> id; merges: (left, right, merged) ids in order."""
        count = max(pieces.values()) + 1
        self.pieces = pieces
        single = np.zeros(count, bool)
        single[[token for piece, token in pieces.items() if len(piece) == 1]] = True
        table = np.array(merges, np.int64).reshape(-1, 3)
        # arcs taken away, and when: the first merge of the two counts
        self.cut, self.cut_time = np.unique(table[:, 0] << 32 | table[:, 1], return_index=True)
        # one gadget a token: the merge that made it; bytes were there before
        made, at = np.unique(table[:, 2], return_index=True)
        made, at = made[~single[made]], at[~single[made]]
        self.time, self.left, self.right = (np.full(count, -1, np.int64) for _ in range(3))
        self.time[made], self.left[made], self.right[made] = at, table[at, 0], table[at, 1]
        # a word can begin with a token if its gadget still joins at its time what its halves' gadgets made
        joins = np.zeros(count, bool)
        joins[made] = self.meets(self.left[made], self.right[made], at)
        begins = single.copy()
        for token in made[np.argsort(at)].tolist():
            begins[token] = joins[token] and begins[self.left[token]] and begins[self.right[token]]
        # the byte trie of those tokens: node << 8 | byte -> node
        steps: dict[int, int] = {}
        ends = [-1]
        for piece, token in pieces.items():
            if begins[token]:
                node = 0
                for byte in piece:
                    node = steps.setdefault(node << 8 | byte, len(ends))
                    if node == len(ends):
                        ends.append(-1)
                ends[node] = token
        keys = np.array(list(steps), np.int64)
        order = np.argsort(keys)
        self.step, self.node, self.ends = keys[order], np.array(list(steps.values()), np.int64)[order], np.array(ends, np.int64)

    def meets(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | int = _NEVER) -> np.ndarray:
        """Whether b may follow a: no merge joined the inner ends of the two before `until`.

        Going back in time, the younger of the two ends is undone. A merge at
        the very time the right end was made counts, as the left pair goes first.
        """
        may = np.ones(len(a), bool)
        open_, until = np.arange(len(a)), np.broadcast_to(until, len(a))
        while len(open_) and len(self.cut):
            key = a << 32 | b
            near = np.minimum(np.searchsorted(self.cut, key), len(self.cut) - 1)
            cut = (self.cut[near] == key) & (self.cut_time[near] < until)
            may[open_[cut]] = False
            time_a, time_b = self.time[a], self.time[b]
            kept = ~cut & ((time_a >= 0) | (time_b >= 0))
            open_, a, b, until, time_a, time_b = (x[kept] for x in (open_, a, b, until, time_a, time_b))
            younger = time_a > time_b
            until = np.minimum(until, np.where(younger, time_a, time_b + 1))
            a, b = np.where(younger, self.right[a], a), np.where(younger, b, self.left[b])
        return may

    def walk(self, words: list[bytes]) -> list[np.ndarray]:
        """The labels of the one path over the bytes of each word."""
        found: list[np.ndarray] = []
        sizes = np.array([len(w) for w in words], np.int64)
        done = np.concatenate([[0], np.cumsum(sizes)])
        begin = 0
        while begin < len(words):
            end = max(begin + 1, int(np.searchsorted(done, done[begin] + WINDOW, side="right")) - 1)
            found += self._labels(words[begin:end], sizes[begin:end])
            begin = end
        return found

    def _follow(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The trie's next node, or -1."""
        key = node << 8 | byte
        near = np.minimum(np.searchsorted(self.step, key), len(self.step) - 1)
        return np.where(self.step[near] == key, self.node[near], -1)

    def _arcs(self, text: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first byte, last byte, label) of every arc from some places on; stop: where the word of a place ends."""
        node, at, found = np.zeros(len(begin), np.int64), begin, [(np.empty(0, np.int64),) * 3]
        while len(begin):
            inside = at < stop
            begin, stop, at, node = begin[inside], stop[inside], at[inside], node[inside]
            node = self._follow(node, text[at])
            inside = node >= 0
            begin, stop, at, node = begin[inside], stop[inside], at[inside], node[inside]
            label = self.ends[node]
            some = label >= 0
            found.append((begin[some], at[some], label[some]))
            at = at + 1
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _labels(self, words: list[bytes], sizes: np.ndarray) -> list[np.ndarray]:
        """The labels of several words, or of one long one, WINDOW places at a time."""
        text = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        ends = np.cumsum(sizes)
        stop = np.repeat(ends, sizes)
        starts = np.zeros(len(text), bool)
        starts[ends - sizes] = True
        label_at, begin_at = np.full(len(text), -1, np.int64), np.zeros(len(text), np.int64)
        held = (np.empty(0, np.int64),) * 3
        for window in range(0, len(text), WINDOW):
            until = min(window + WINDOW, len(text))
            begin, last, label = (np.concatenate(x) for x in zip(held, self._arcs(text, np.arange(window, until), stop[window:until]), strict=True))
            # an arc is on a valid path if it begins the word or may follow one that is and ends just before it
            valid = starts[begin]
            valid[: len(held[0])] = True
            by_last = np.argsort(last, kind="stable")
            order = np.flatnonzero(~valid)
            order = order[np.argsort(begin[order], kind="stable")]
            low, high = (np.searchsorted(last[by_last], begin[order] - 1, side=side) for side in ("left", "right"))
            many = high - low
            after = np.repeat(order, many)
            before = by_last[np.arange(len(after)) + np.repeat(low - (np.cumsum(many) - many), many)]
            may = self.meets(label[before], label[after])
            reached = bytearray(valid.astype(np.uint8).tobytes())
            for x, y in zip(before[may].tolist(), after[may].tolist(), strict=True):
                if reached[x]:
                    reached[y] = 1
            valid = np.frombuffer(reached, np.uint8) > 0
            label_at[last[valid]], begin_at[last[valid]] = label[valid], begin[valid]
            over = valid & (last >= until - 1)
            held = begin[over], last[over], label[over]
        labels, begins, found = label_at.tolist(), begin_at.tolist(), []
        for start, end in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
            ids, at = [], end - 1
            while at >= start:
                ids.append(labels[at])
                at = begins[at] - 1
            found.append(np.array(ids[::-1], np.int32))
        return found

    def encoder(self, keep: int = KEEP) -> "Encoder":
        return Encoder(self, keep)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of each code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "?" for c in range(0x110000))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for run in regex.finditer(pattern, every):
            table[run.start() : run.end()] = kind
    return table


def split_places(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where words begin in texts that follow each other, each with one more character behind it, at the places ends; these begin too.

    A word is a run of letters, of numbers or of other characters, with one space
    before it; of blanks before a word all but the last are one word, and the last
    one too if it is no space. An apostrophe that is a run of its own, without a
    space, takes one of the ENDINGS from the letters behind it.
    """
    kind = _classes()[codes]
    kind[ends] = END
    count = len(kind)
    first = np.ones(count, bool)
    first[1:] = kind[1:] != kind[:-1]
    first[ends] = True
    # the last blank of a run before a word
    last = np.zeros(count, bool)
    last[:-1] = (kind[:-1] == BLANK) & (kind[1:] != BLANK) & (kind[1:] != END)
    first |= last
    spaced = np.zeros(count, bool)
    spaced[1:] = last[:-1] & (codes[:-1] == 32)
    first &= ~spaced
    apostrophe = np.flatnonzero((codes == 39) & first & (kind == OTHER))
    apostrophe = apostrophe[kind[np.minimum(apostrophe + 1, count - 1)] == LETTER]
    if len(apostrophe):
        one, two = codes[apostrophe + 1], codes[np.minimum(apostrophe + 2, count - 1)]
        taken = np.zeros(len(apostrophe), np.int64)
        for ending in ENDINGS:
            same = one == ord(ending[0])
            if len(ending) > 1:
                same &= two == ord(ending[1])
            taken[same & (taken == 0)] = len(ending)
        apostrophe, taken = apostrophe[taken > 0], taken[taken > 0]
        first[apostrophe + 1] = False
        behind = apostrophe + 1 + taken
        # what is left of the letters is a word of its own
        first[behind[kind[behind] == LETTER]] = True
    return np.flatnonzero(first)


class Encoder:
    """Encodes texts, remembering the ids of words; forgets all when it holds more than `keep` bytes."""

    def __init__(self, automaton: Automaton, keep: int = KEEP):
        self.automaton, self.keep, self.held = automaton, keep, 0
        self.known: dict[str, np.ndarray] = {}

    def words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of distinct words."""
        new = [w for w in words if w not in self.known]
        fresh = dict(zip(new, self.automaton.walk([w.encode("utf-8", "replace") for w in new]), strict=True))
        found = [self.known[w] if w in self.known else fresh[w] for w in words]
        if self.held > self.keep:
            self.known, self.held = {}, 0
        for word, ids in fresh.items():
            if len(word) < 1000:
                self.known[word] = ids
                self.held += 4 * len(word) + ids.nbytes + 200
        return found

    def block(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): ids of texts one after the other, and where each text's begin (and one more)."""
        whole = "\n".join([*(t or "" for t in texts), ""])
        codes = np.frombuffer(whole.encode("utf-32-le", "replace"), np.uint32)
        ends = np.cumsum([len(t) + 1 if t else 1 for t in texts]) - 1
        begin = split_places(codes, ends)
        end = np.append(begin[1:], len(codes))
        # a word is known in the block by two sums of its characters, each with its own multipliers, and its length
        keys = []
        for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            power = _powers(len(codes), seed)
            sums = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[: len(codes)], out=sums[1:])
            keys.append((sums[end] - sums[begin]) * power[len(codes) - begin])
        is_word = np.ones(len(begin), bool)
        is_word[np.searchsorted(begin, ends)] = False
        begin, end, key, check = begin[is_word], end[is_word], keys[0][is_word], keys[1][is_word]
        _, at, which = np.unique(key, return_index=True, return_inverse=True)
        if not ((check == check[at[which]]) & (end - begin == (end - begin)[at[which]])).all():
            _, at, which = np.unique(np.array([whole[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]), return_index=True, return_inverse=True)
        ids = self.words([whole[a:b] for a, b in zip(begin[at].tolist(), end[at].tolist(), strict=True)])
        sizes = np.array([len(x) for x in ids], np.int64)
        starts, flat = np.cumsum(sizes) - sizes, np.concatenate([np.empty(0, np.int32), *ids])
        many = sizes[which]
        done = np.concatenate([[0], np.cumsum(many)])
        labels = flat[np.arange(int(done[-1])) + np.repeat(starts[which] - done[:-1], many)]
        return labels, done[np.searchsorted(begin, np.concatenate([[0], ends]))]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; of an empty or null text the empty list."""
        return self.block([text])[0].tolist() if text else []


@lru_cache(maxsize=4)
def _powers_of(size: int, seed: int) -> np.ndarray:
    grown = np.full(size, seed | 1, np.uint64)
    grown[0] = 1
    return np.cumprod(grown, out=grown)


def _powers(size: int, seed: int) -> np.ndarray:
    """Powers of a seed, at least size + 1 of them."""
    return _powers_of(1 << max(20, size.bit_length()), seed)


def load(name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> Automaton:
    """The automaton of a vocabulary file of ids and ordered merges."""
    with open(f"{folder}/{name}.json", encoding="utf-8") as file:
        model = json.load(file)["model"]
    byte_of = _byte_of()
    vocabulary = model["vocab"]
    plain = {t: bytes(byte_of[c] for c in t) for t in vocabulary if all(c in byte_of for c in t)}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merges = [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs]
    made = {c for _, _, c in merges}
    pieces = {plain[t]: i for t, i in vocabulary.items() if t in plain and (i in made or len(plain[t]) == 1)}
    return Automaton(pieces, merges)


def decode(ids: list[int], automaton: Automaton) -> str:
    """The text of ids: the labels' bytes, one after the other."""
    piece_of = {token: piece for piece, token in automaton.pieces.items()}
    return b"".join(piece_of[i] for i in ids).decode("utf-8", "replace")


def encode_texts(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(key, ids array<int>) for every row: ids of its text, no special tokens.

    Null and empty texts give the empty list; repeated rows and null keys are
    kept as they are; characters that are no valid Unicode become '?'. Texts of
    any length are taken whole. Only the driver reads the vocabulary; the compiled
    tables are broadcast, their size is fixed by the vocabulary. No shuffle.
    """
    shared = df.sparkSession.sparkContext.broadcast(load(name, folder))
    kind = df.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value.encoder()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in blocks(texts, BLOCK):
                labels, first = encoder.block(texts[begin:end])
                ids = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(labels, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), ids], ["key", "ids"])

    coded = df.select(F.col(key), F.col(text).cast("string")).mapInArrow(encode, f"key {kind}, ids array<int>")
    return coded.select(F.col("key").alias(key), "ids")


def decode_texts(df: DataFrame, key: str, ids: str, name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(key, text) for every row: the text of its ids.

    Null ids give null, no ids the empty text; ids that the vocabulary has no bytes
    for (null ones too) add nothing; bytes that are no valid UTF-8 become U+FFFD.
    No shuffle.
    """
    pieces = load(name, folder).pieces
    size = np.zeros(max(pieces.values()) + 1, np.int64)
    size[list(pieces.values())] = [len(p) for p in pieces]
    by_id = sorted(pieces, key=pieces.__getitem__)
    shared = df.sparkSession.sparkContext.broadcast((np.frombuffer(b"".join(by_id), np.uint8), size))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, size = shared.value
        start = np.cumsum(size) - size
        for batch in batches:
            texts = []
            for labels in batch.column(1):
                if not labels.is_valid:
                    texts.append(None)
                    continue
                token = labels.values.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
                token = token[(token >= 0) & (token < len(size))]
                many = size[token]
                at = np.arange(int(many.sum())) + np.repeat(start[token] - (np.cumsum(many) - many), many)
                texts.append(raw[at].tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    read = df.select(F.col(key), F.col(ids).cast("array<int>")).mapInArrow(run, f"key {kind}, text string")
    return read.select(F.col("key").alias(key), "text")
