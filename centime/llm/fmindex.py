"""Test passages inside a training corpus, found with an FM-index per shard.

The words of a shard's documents, as small numbers, are sorted by suffix; the
word before each suffix makes the transformed sequence, held in a wavelet matrix
of packed bits. All test phrases step backward through it at once. The places of
the suffixes that remain follow from sampled positions. Hits that touch merge
into spans.

A phrase is a run of `least` words of a test item, so a document shares that many
words in a row with an item exactly if a phrase occurs. Document words that no
item has cannot be part of a hit: they end runs, and runs shorter than a phrase
are not indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centime.llm.words import blocks, mix, words

#: Words of one shard; bounds a task's memory (about 60 bytes a word).
SHARD = 1 << 20
#: One suffix position in so many is kept.
SAMPLE = 16
#: Bytes of item tables that are sent to the tasks at once; more items are searched in several rounds.
ROUND_BYTES = 96 << 20
#: Bytes that a word of an item takes in these tables: its hash, its number, a phrase with its place and owner.
WORD_BYTES = 24
#: Document keys that a task holds before it drops those of documents already searched.
KEYS = 200_000


class Bits:
    """A bit vector with ranks: packed words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.word = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.word), dtype=np.int64)])
        self.ones = int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[block] + np.bitwise_count(self.word[block] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.word[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


class Wavelet:
    """A wavelet matrix: ranks of a symbol, and symbols with their rank, in one step per bit."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels, self.zeros = [], []
        for level in reversed(range(bits)):
            bit = (symbols >> level) & 1
            self.levels.append((level, Bits(bit)))
            self.zeros.append(int((bit == 0).sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        low = np.zeros_like(at)
        for (level, bits), zeros in zip(self.levels, self.zeros, strict=True):
            one = ((symbol >> level) & 1).astype(bool)
            r_low, r_at = bits.rank(low), bits.rank(at)
            low = np.where(one, zeros + r_low, low - r_low)
            at = np.where(one, zeros + r_at, at - r_at)
        return at - low

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and its occurrences before."""
        low, symbol = np.zeros_like(at), np.zeros_like(at)
        for (level, bits), zeros in zip(self.levels, self.zeros, strict=True):
            one = bits.get(at).astype(bool)
            symbol |= one.astype(np.int64) << level
            r_low, r_at = bits.rank(low), bits.rank(at)
            low = np.where(one, zeros + r_low, low - r_low)
            at = np.where(one, zeros + r_at, at - r_at)
        return symbol, at - low


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffixes of symbols in order. A suffix ends at its first 0, and equal ones keep the order of the text.

    As many symbols as 62 bits hold make a first key. Each later round orders
    only the suffixes that are still tied, by the ranks of what follows.
    """
    count = len(symbols)
    bits = int(symbols.max()).bit_length() or 1
    several = min(62 // bits, count)
    key, ended = symbols.copy(), symbols == 0
    for k in range(1, several):
        key <<= bits
        following = symbols[k:]
        key[: count - k] |= np.where(ended[: count - k], 0, following)
        ended[: count - k] |= following == 0
        ended[count - k :] = True
    order = np.argsort(key, kind="stable")
    sorted_key, alone = key[order], ended[order]
    new = np.concatenate([[True], (sorted_key[1:] != sorted_key[:-1]) | alone[1:]])
    held, bits = several, count.bit_length()
    several = min(62 // bits, count)
    rank = np.empty(count, np.int64)
    while True:
        starts = np.flatnonzero(new)
        rank[order] = np.repeat(starts, np.diff(np.append(starts, count)))
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            return order
        suffixes = order[tied]
        key = rank[suffixes]
        for k in range(1, several):
            key = key << bits | rank[np.minimum(suffixes + k * held, count - 1)]
        by_key = np.argsort(key, kind="stable")
        order[tied] = suffixes[by_key]
        key = key[by_key]
        new[tied] = np.concatenate([[True], key[1:] != key[:-1]])
        held *= several


class FMIndex:
    """symbols: numbers from 1 on, 0 ends a run; the last one is 0."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        order = suffix_order(symbols)
        self.size = len(symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=alphabet + 1))])
        self.wavelet = Wavelet(symbols[order - 1], int(alphabet).bit_length())
        kept = (order % SAMPLE == 0) | (symbols[order - 1] == 0)
        self.kept, self.positions = Bits(kept), order[kept]

    def search(self, sequence: np.ndarray, starts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of phrases (the `least` symbols of sequence from each start on): which ones occur, and the first and last (excluded) suffix that begins with them."""
        alive = np.arange(len(starts))
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), self.size, np.int64)
        for step in reversed(range(least)):
            symbol = sequence[starts[alive] + step].astype(np.int64)
            low = self.first[symbol] + self.wavelet.rank(symbol, low)
            high = self.first[symbol] + self.wavelet.rank(symbol, high)
            left = low < high
            alive, low, high = alive[left], low[left], high[left]
            if not len(alive):
                break
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes: step to the suffix before until one is sampled. The starts of runs all are, so no step crosses an end."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        found, open_ = np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(open_):
            at = rows[open_]
            hit = self.kept.get(at).astype(bool)
            done = open_[hit]
            found[done] = self.positions[self.kept.rank(rows[done])] + steps[done]
            open_ = open_[~hit]
            symbol, before = self.wavelet.access(rows[open_])
            rows[open_] = self.first[symbol] + before
            steps[open_] += 1
        return found


class Items(NamedTuple):
    """Test items as tables: their words as numbers from 1 on, one after the other, and their distinct phrases.

    vocabulary: sorted word hashes; sequence: numbers of all words; starts: where
    each distinct phrase begins in it; begin, owner: the items of phrase i are
    ids[owner[begin[i] : begin[i + 1]]].
    """

    vocabulary: np.ndarray
    sequence: np.ndarray
    starts: np.ndarray
    begin: np.ndarray
    owner: np.ndarray
    ids: np.ndarray

    @property
    def size(self) -> int:
        return sum(table.nbytes for table in self)


def items_of(ids: list[int], hashed: list[np.ndarray], least: int) -> Items:
    """Tables of items from the hashes of their words. Phrases are compared by a hash and then word by word."""
    sizes = np.array([len(h) for h in hashed], np.int64)
    whole = np.concatenate([np.empty(0, np.uint64), *hashed])
    vocabulary, number = np.unique(whole, return_inverse=True)
    sequence = (number.reshape(-1) + 1).astype(np.int32)
    item = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    count = max(0, len(sequence) - least + 1)
    start = np.flatnonzero(item[:count] == item[len(item) - count :]).astype(np.int32 if len(item) < 1 << 31 else np.int64)
    value = np.zeros(len(start), np.uint64)
    for step in range(least):
        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + sequence[start + step].astype(np.uint64))
    order = np.lexsort((item[start], value))
    start, value = start[order], value[order]
    new = np.ones(len(start), bool)
    near = np.flatnonzero(value[1:] == value[:-1]) + 1
    differs = np.zeros(len(near), bool)
    for step in range(least):
        differs |= sequence[start[near] + step] != sequence[start[near - 1] + step]
    new[near] = differs
    phrase, owner = np.cumsum(new) - 1, item[start]
    once = np.ones(len(start), bool)
    once[1:] = (phrase[1:] != phrase[:-1]) | (owner[1:] != owner[:-1])
    begin = np.searchsorted(phrase[once], np.arange(int(new.sum()) + 1)).astype(np.int32)
    return Items(vocabulary, sequence, start[new], begin, owner[once], np.array(ids, np.int64))


class _Shard:
    """Runs of known words of several documents, indexed and searched when there are enough."""

    def __init__(self, items: Items, least: int):
        self.items, self.least = items, least
        self.clear()

    def clear(self) -> None:
        self.symbols, self.docs, self.places, self.held = [], [], [], 0

    def add(self, symbol: np.ndarray, doc: np.ndarray, place: np.ndarray) -> Iterator[tuple]:
        """Words of whole documents; place: of the word in its document. Documents never continue in another call."""
        edge = (symbol[1:] == 0) | (symbol[:-1] == 0) | (doc[1:] != doc[:-1])
        starts = np.concatenate([[0], np.flatnonzero(edge) + 1])
        sizes = np.diff(np.append(starts, len(symbol)))
        chosen = (sizes >= self.least) & (symbol[starts] > 0)
        starts, sizes = starts[chosen], sizes[chosen]
        if len(sizes) and sizes.max() > SHARD:  # a run longer than a shard goes in pieces that overlap by all but one word of a phrase
            step = SHARD - self.least + 1
            pieces = np.maximum(1, -(-(sizes - self.least + 1) // step))
            nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            starts, sizes = np.repeat(starts, pieces) + nth * step, np.minimum(SHARD, np.repeat(sizes, pieces) - nth * step)
        done = np.cumsum(sizes + 1)
        begin = 0
        while begin < len(sizes):
            before = int(done[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(done, before + SHARD - self.held, side="right")))
            some, first = sizes[begin:end] + 1, starts[begin:end]
            ends = np.cumsum(some)
            at = np.arange(int(ends[-1])) + np.repeat(first - (ends - some), some)
            at[ends - 1] -= 1
            part = symbol[at]
            part[ends - 1] = 0
            self.symbols.append(part)
            self.docs.append(doc[at])
            self.places.append(place[at])
            self.held += len(at)
            begin = end
            if self.held >= SHARD or begin < len(sizes):
                yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        if not self.symbols:
            return
        symbols, docs, places = (np.concatenate(x) for x in (self.symbols, self.docs, self.places))
        self.clear()
        items = self.items
        index = FMIndex(symbols, len(items.vocabulary))
        found, low, high = index.search(items.sequence, items.starts, self.least)
        if not len(found):
            return
        sizes = high - low
        offset = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        position = index.locate(np.repeat(low, sizes) + offset)
        phrase = np.repeat(found, sizes)
        # a phrase of several items counts for each of them
        several = (items.begin[phrase + 1] - items.begin[phrase]).astype(np.int64)
        step = np.arange(int(several.sum())) - np.repeat(np.cumsum(several) - several, several)
        item = items.owner[np.repeat(items.begin[phrase], several) + step]
        position = np.repeat(position, several)
        yield merged(docs[position], item, places[position], self.least)

    def kept(self, keys: list) -> list:
        """The keys of documents that are still waiting to be searched; they are numbered anew."""
        if not self.docs:
            return []
        used = np.unique(np.concatenate(self.docs))
        self.docs = [np.searchsorted(used, d) for d in self.docs]
        return [keys[i] for i in used.tolist()]


def merged(doc: np.ndarray, item: np.ndarray, place: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Spans (doc, item, begin, end) of words: hits of `size` words that overlap or touch become one."""
    order = np.lexsort((place, item, doc))
    doc, item, place = doc[order], item[order], place[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (place[1:] > place[:-1] + size)])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(doc) - 1]])
    return doc[new], item[new], place[new], place[last] + size


def _spans(items: Items, least: int, kind: pa.DataType):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, vocabulary = _Shard(items, least), items.vocabulary
        keys: list = []  # of documents, by the number that stands for them in the shard

        def out(results: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            for doc, item, begin, end in results:
                key = pa.array([keys[i] for i in doc.tolist()], kind)
                columns = [key, pa.array(items.ids[item]), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "item", "word_begin", "word_end"])

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in blocks(texts):
                found = words(texts[begin:end])
                at = np.searchsorted(vocabulary, found.hash)
                at[at == len(vocabulary)] = 0
                symbol = np.where(vocabulary[at] == found.hash, at + 1, 0) if len(found.hash) else np.empty(0, np.int64)
                base = len(keys)
                keys += batch.column(0).slice(begin, end - begin).to_pylist()
                if len(symbol):
                    yield from out(shard.add(symbol, found.text + base, np.arange(len(symbol)) - found.first[found.text]))
                if not shard.symbols or len(keys) > KEYS:
                    keys = shard.kept(keys)
        yield from out(shard.flush())

    return search


def leaked_spans(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", least: int = 15, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(doc_key, item_key, word_begin, word_end): maximal spans of documents that repeat phrases of test items.

    A span is made of runs of at least `least` words that the item has too; word
    places count from 0, word_end is excluded. Case, accents, punctuation and
    line ends do not matter. Null and empty texts, and texts shorter than a
    phrase, have no span; a null document key stays null; rows with equal keys
    are searched each for itself; items that share a phrase are all reported;
    items with null key or text are left out. Documents are indexed where they
    are read: no shuffle. Items are split into words in the tasks and sent on in
    rounds whose tables take at most about `round_bytes` (a longer single item
    is a round of its own); any number of rounds may follow.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_key].dataType.simpleString()
    whole = docs.select(F.col(doc_key).alias("key"), F.col(text).cast("string").alias("text"))

    def search(ids: list[int], hashed: list[np.ndarray]) -> DataFrame:
        tables = spark.sparkContext.broadcast(tuple(items_of(ids, hashed, least)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = Items(*tables.value)
            if not len(held.starts):
                for _ in batches:
                    pass
                return
            first = next(batches, None)
            if first is None:
                return
            from itertools import chain

            yield from _spans(held, least, first.schema.field(0).type)(chain([first], batches))

        return whole.mapInArrow(run, f"key {kind}, item bigint, word_begin int, word_end int")

    chosen = items.select(F.col(item_key).cast("bigint").alias("item"), F.col(text).cast("string").alias("text")).where("item IS NOT NULL AND text IS NOT NULL").distinct()
    ids, hashed, held, rounds = [], [], 0, []
    for row in chosen.mapInArrow(_hashed(least), "item bigint, words binary").toLocalIterator():
        size = len(row["words"]) // 8 * WORD_BYTES
        if ids and held + size > round_bytes:
            rounds.append(search(ids, hashed))
            ids, hashed, held = [], [], 0
        ids.append(row["item"])
        hashed.append(np.frombuffer(bytes(row["words"]), np.uint64))
        held += size
    rounds.append(search(ids, hashed))
    spans = rounds[0]
    for other in rounds[1:]:
        spans = spans.unionByName(other)
    return spans.select(F.col("key").alias(doc_key), F.col("item").alias(item_key), "word_begin", "word_end")


def _hashed(least: int):
    """(item, words): the hashes of an item's words; items shorter than a phrase are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in blocks(texts):
                found = words(texts[begin:end])
                kept = [i for i in range(end - begin) if found.first[i + 1] - found.first[i] >= least]
                raw = [found.hash[found.first[i] : found.first[i + 1]].tobytes() for i in kept]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin).take(pa.array(kept, pa.int64())), pa.array(raw, pa.binary())], ["item", "words"])

    return run


def leaks(docs: DataFrame, items: DataFrame, least: int = 15) -> DataFrame:
    """(doc_id, item_id): documents and items that share at least `least` words in a row. Distinct."""
    return leaked_spans(docs, items, least=least).select("doc_id", "item_id").distinct()
