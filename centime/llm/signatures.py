"""Near-duplicate texts in groups: signature trees over the rare triples of all texts.

A text is the set of its word triples, in one order for all texts, rare ones
first. Two sets that reach the threshold share one of the first triples of both:
of n triples they have at least threshold * n in common, so not all of these are
among the last. Only first triples are indexed, and no pair is missed.

The collection is parted by triple. Each part is one signature tree over its
entries (a text under one of its first triples), in order of triple and size. A
node holds the range of triples and sizes below it, the OR and the AND of the
token bitmaps, and the most that an overlap may still have (what the two share
lies from their first common triple on). The tree is walked against itself from
the root, and a pair of nodes is dropped as soon as even the greatest possible
overlap is too small. Every candidate comes out of such a walk, and is then
verified on the whole sets; groups are the connected components of the links.

With many parts nearly each entry of a text goes to another one, with the text's
bitmap. Parts are then walked in rounds, and the entries of one round at a time
are on disk.

Where very many texts are near-copies of each other, all their pairs are
candidates. Such a triple's entries are first linked along chains only; when
groups are known, they are walked again, and pairs of nodes within one group are
dropped, so no pair of different groups is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centime.llm.batches import spread, whole_runs
from centime.llm.components import components
from centime.llm.words import blocks, mix, words
from centime.session import durable

THRESHOLD = 0.6
#: Texts whose triples are counted for the order, about; triples that have a place in it by their count, the others come first.
#: Any order finds every pair; a poor one only makes more candidates.
SAMPLE, FREQUENT = 20_000, 200_000
#: Allowance for rounding where sizes are compared.
SLACK = 1e-6
#: Bits of a token bitmap; texts with more tokens than 1 / DENSE of that have up to WIDER times as many, as a bitmap with most bits set rules out nothing.
BITS, WIDER, DENSE = 768, 4, 1.5
#: Bytes of a stored token.
WIDTH = 5
#: Entries of a tree's leaf, children of its other nodes.
LEAF, FAN = 16, 4
#: Parts at least, and entries of a part beyond which there are more parts.
PARTS, ENTRIES = 32, 300_000
#: Parts are walked in rounds of at least PARTS; a round's entries take about so many times the bytes of the sets, an entry some ENTRY besides its bitmap.
SHARE, ENTRY = 1.5, 30
#: A triple with more candidates than that many for each entry, and than that many in all, waits until groups are known.
PLENTY, SEVERAL = 8, 4096
#: Entries of one triple that one task takes; more are split.
SPLIT = 100_000
#: Pairs of nodes and pairs of texts that are compared at once; entries that are walked together when groups are known.
NODES, TEXTS, ROWS = 512, 30_000, 50_000


def shingle_sets(texts: list[str | None], length: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, first): of each text the distinct hashes of `length` words in a row, in order; first has where each begins."""
    found = words(texts)
    h = found.hash
    if len(h) < length:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    value = h[: len(h) - length + 1]
    for k in range(1, length):
        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - length + 1 + k])
    value = value >> np.uint64(64 - 8 * WIDTH)
    text = found.text
    inside = text[: len(value)] == text[length - 1 :]
    value, text = value[inside], text[: len(inside)][inside]
    order = np.argsort(text.astype(np.uint64) << np.uint64(8 * WIDTH) | value if len(texts) < 1 << (64 - 8 * WIDTH) else value, kind="stable")
    value, text = value[order], text[order]
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (text[1:] != text[:-1])])[: len(value)]
    value, text = value[new], text[new]
    return value, np.searchsorted(text, np.arange(len(texts) + 1))


def pack(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()


def unpack(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // WIDTH, 8), np.uint8)
    wide[:, :WIDTH] = np.frombuffer(packed, np.uint8).reshape(-1, WIDTH)
    return wide.view("<u8").reshape(-1)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for begin, end in blocks(texts):
            tokens, first = shingle_sets(texts[begin:end])
            raw = pack(tokens)
            kept = [i for i in range(end - begin) if first[i + 1] > first[i]]
            sets = [raw[first[i] * WIDTH : first[i + 1] * WIDTH] for i in kept]
            keys = batch.column(0).slice(begin, end - begin).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(sets, pa.binary())], ["seq", "tokens"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, n) of the sets of each batch."""
    for batch in batches:
        token, n = np.unique(unpack(b"".join(batch.column(0).to_pylist())), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], ["token", "n"])


def _sample(sets: DataFrame, count: int) -> tuple[DataFrame, int]:
    """About SAMPLE of the sets, and the number of sets that each stands for."""
    step = max(1, -(-count // SAMPLE))
    return sets.where(F.pmod(F.xxhash64("seq"), F.lit(step)) == 0).select("tokens"), step


def _frequent(some: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, ranks): the most frequent tokens of some sets, in order, and their places by count, from 1."""
    counts = some.mapInArrow(_counted, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).where("n > 1")
    top = counts.orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
    token, n = (top.column(i).to_numpy() for i in (0, 1))
    order = np.argsort(token)
    _, rank = np.unique(n, return_inverse=True)
    return token[order].astype(np.uint64), rank[order].astype(np.uint64) + np.uint64(1)


def _hot(some: DataFrame, frequent, threshold: float, least: float, split: float) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    """(tokens, chunks): first tokens of more than `least` of some sets, in order, and into how many chunks of `split` their entries go.

    At most as many as the sample has entries over `least`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = batch.column(0).to_pylist()
            token, _, _ = first_tokens(unpack(b"".join(sets)), np.array([len(x) // WIDTH for x in sets], np.int64), frequent.value, threshold)
            token, n = np.unique(token, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], ["token", "n"])

    counts = some.mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > least)
    top = counts.orderBy("token").toArrow()
    return top.column(0).to_numpy().astype(np.int64), np.ceil(top.column(1).to_numpy() / split).astype(np.int64)


def first_tokens(tokens: np.ndarray, sizes: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, set, rest): of each set the tokens of which similar sets share one; rest counts the set's tokens from there on.

    Two sets with the threshold of their union in common have at least threshold
    * n of either's n tokens in common, so not all of these are among the last
    threshold * n - 1.
    """
    known, ranks = frequent
    place = np.zeros(len(tokens), np.uint64)
    if len(known):
        at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        place = np.where(known[at] == tokens, ranks[at], place)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(place << np.uint64(8 * WIDTH) | tokens)
    order = order[np.argsort(owner[order], kind="stable")]
    rest = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(tokens))
    first = rest >= np.repeat(np.maximum(np.ceil(threshold * sizes - SLACK), 1), sizes)
    return tokens[order][first], owner[first], rest[first]


def widened(sizes: np.ndarray) -> np.ndarray:
    """How many times as wide as BITS the bitmaps of sets of these sizes are."""
    wide = np.ones(len(sizes), np.int64)
    while (more := (wide < WIDER) & (sizes * DENSE > wide * BITS)).any():
        wide[more] *= 2
    return wide


def _firsts(frequent, threshold: float):  # noqa: ANN001
    """Size, bitmap and first tokens of each set, in their order; frequent is broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sets = batch.column(1).to_pylist()
                tokens = unpack(b"".join(sets))
                sizes = np.array([len(s) // WIDTH for s in sets], np.int64)
                text = np.repeat(np.arange(len(sets)), sizes)
                widths, bitmap = widened(sizes) * BITS, [b""] * len(sets)
                for width in np.unique(widths).tolist():
                    has = np.flatnonzero(widths == width)
                    own = widths[text] == width
                    bits = np.zeros((len(has), width), np.uint8)
                    bits[np.searchsorted(has, text[own]), (tokens[own] % np.uint64(width)).astype(np.int64)] = 1
                    for i, x in zip(has.tolist(), np.packbits(bits, axis=1), strict=True):
                        bitmap[i] = x.tobytes()
                token, owner, _ = first_tokens(tokens, sizes, frequent.value, threshold)
                raw, first = pack(token), np.searchsorted(owner, np.arange(len(sets) + 1)) * WIDTH
                packed = pa.array([raw[first[i] : first[i + 1]] for i in range(len(sets))], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int32)), pa.array(bitmap, pa.binary()), packed], ["seq", "size", "bitmap", "tokens"])

    return run


FIRSTS = "seq bigint, size int, bitmap binary, tokens binary"


def _postings(hot, parts: int, rounds: int, turn: int):  # noqa: ANN001
    """The entries of each set in the parts of one round, a row for each part they are in; hot is broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_token, chunks = hot.value
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sets = batch.column(3).to_pylist()
                token = unpack(b"".join(sets))
                counts = np.array([len(s) // WIDTH for s in sets], np.int64)
                sizes = batch.column(1).to_numpy()
                owner = np.repeat(np.arange(len(sets)), counts)
                # first tokens are the first in a set's order
                rest = sizes[owner] - (np.arange(len(token)) - np.repeat(np.cumsum(counts) - counts, counts))
                place = token
                if len(hot_token):
                    near = np.minimum(np.searchsorted(hot_token, token.view(np.int64)), len(hot_token) - 1)
                    seq = batch.column(0).to_numpy()[owner].astype(np.uint64)
                    chunk = mix(seq + mix(token)) % chunks[near].astype(np.uint64)
                    place = np.where(hot_token[near] == token.view(np.int64), token + chunk * np.uint64(0x9E3779B97F4A7C15), token)
                part = (mix(place) % np.uint64(parts)).astype(np.int32)
                here = np.flatnonzero(part % rounds == turn)
                order = here[np.lexsort((owner[here], part[here]))]
                part, owner, token, rest = part[order], owner[order], token[order], rest[order]
                starts = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])])) if len(part) else np.empty(0, np.int64)
                one = pa.array(owner[starts])
                offsets = pa.array(np.append(starts, len(part)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (token.view(np.int64), rest.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array(part[starts]), *(batch.column(i).take(one) for i in range(3)), *lists], POSTING_NAMES)

    return run


POSTINGS = "part int, seq bigint, size int, bitmap binary, tokens array<bigint>, rests array<int>"
POSTING_NAMES = ["part", "seq", "size", "bitmap", "tokens", "rests"]
#: A pair (a, b), or with b null an entry of a token that has to be walked again.
FOUND = "a bigint, b bigint, token bigint, size int, bitmap binary, rest int"
FOUND_NAMES = ["a", "b", "token", "size", "bitmap", "rest"]


class Tree:
    """A signature tree over entries. row tells the text of each entry; size, bitmap, group (-1: none) and side are those of texts, wide the wider bitmaps of some.

    order: the entries in the tree's order; token_no: of each, in that order, the
    place of its token among all; found: of each token the pairs found; waits:
    tokens whose pairs are not looked at.
    """

    def __init__(self, token, row, rest, size, bitmap, group=None, side=None, wide=()):  # noqa: ANN001
        group = np.full(len(size), -1) if group is None else group
        # like entries next to each other: by token, then group, size, bitmap
        self.order = np.lexsort((bitmap[row, 0], size[row], group[row], token))
        self.row, self.rest = row[self.order], rest[self.order]
        self.size, self.bitmap, self.group, self.side = size, bitmap, group, side
        self.wide = [(place, bits, size[place >= 0]) for place, bits in wide]
        token = token[self.order]
        self.token_no = np.cumsum(np.concatenate([[0], token[1:] != token[:-1]]))
        self.members = np.bincount(self.token_no)
        self.found = np.zeros(len(self.members), np.int64)
        self.waits = np.zeros(len(self.members), bool)
        self.compared = 0
        ones = every = bitmap[self.row]
        low = high = size[self.row]
        label, most, first, last = group[self.row], self.rest, self.token_no, self.token_no
        self.levels = []
        fan = LEAF
        while True:
            starts = np.arange(0, len(low), fan)
            ends = np.append(starts[1:], len(low)) - 1
            ones, every = np.bitwise_or.reduceat(ones, starts), np.bitwise_and.reduceat(every, starts)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            label = np.where(np.minimum.reduceat(label, starts) == np.maximum.reduceat(label, starts), label[starts], -1)
            most, first, last = np.maximum.reduceat(most, starts), first[starts], last[ends]
            self.levels.append((ones, every, low, high, label, most, first, last))
            if len(starts) == 1:
                break
            fan = FAN

    def pairs(self, threshold: float, plenty: float = np.inf, several: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (in the tree's order) of entries of one token that may reach the threshold and are not known to be of one group, a part at a time.

        A token with more than `several` pairs and more than `plenty` for each entry is marked in waits and walked no further.
        """
        self.plenty, self.several = plenty, several
        root = np.zeros(1, np.int64)
        yield from self._down(len(self.levels) - 1, root, root, threshold)

    def _down(self, level: int, a: np.ndarray, b: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if len(a) > NODES:
            for at in range(0, len(a), NODES):
                yield from self._down(level, a[at : at + NODES], b[at : at + NODES], threshold)
            return
        ones, every, low, high, label, most, first, last = self.levels[level]
        self.compared += len(a)
        kept = (last[a] >= first[b]) & ~((first[a] == last[b]) & self.waits[first[a]])
        kept &= np.minimum(most[a], most[b]) >= threshold / (1 + threshold) * (low[a] + low[b]) - SLACK
        kept &= (label[a] != label[b]) | (label[a] < 0)
        a, b = a[kept], b[kept]
        kept = may_match(ones[a], every[a], low[a], high[a], ones[b], every[b], low[b], high[b], threshold)
        a, b = a[kept], b[kept]
        if not len(a):
            return
        fan = LEAF if level == 0 else FAN
        below = len(self.row) if level == 0 else len(self.levels[level - 1][2])
        left = (a[:, None] * fan + np.repeat(np.arange(fan), fan)[None, :]).ravel()
        right = (b[:, None] * fan + np.tile(np.arange(fan), fan)[None, :]).ravel()
        if level:
            inside = (right < below) & (left <= right)
            yield from self._down(level - 1, left[inside], right[inside], threshold)
            return
        inside = (right < below) & (left < right)
        left, right = left[inside], right[inside]
        kept = (self.token_no[left] == self.token_no[right]) & ~self.waits[self.token_no[left]]
        left, right = left[kept], right[kept]
        kept = self.may_reach(left, right, threshold)
        left, right = left[kept], right[kept]
        tokens, n = np.unique(self.token_no[left], return_counts=True)
        self.found[tokens] += n
        self.waits[tokens] |= self.found[tokens] > np.maximum(self.several, self.plenty * self.members[tokens])
        yield left, right

    def may_reach(self, left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
        """Whether two entries of one token may reach the threshold, and are of different groups and sides."""
        a, b = self.row[left], self.row[right]
        kept = np.minimum(self.rest[left], self.rest[right]) >= threshold / (1 + threshold) * (self.size[a] + self.size[b]) - SLACK
        kept &= (self.group[a] != self.group[b]) | (self.group[a] < 0)
        if self.side is not None:
            kept &= (self.side[a] != self.side[b]) | (self.side[a] < 0)
        at = np.flatnonzero(kept)
        kept[at] = texts_may_match(self.bitmap, self.size, a[at], b[at], threshold)
        for place, bits, size in self.wide:
            at = np.flatnonzero(kept)
            at = at[(place[a[at]] >= 0) & (place[b[at]] >= 0)]
            kept[at] = texts_may_match(bits, size, place[a[at]], place[b[at]], threshold)
        return kept


def may_match(ones_x, every_x, low_x, high_x, ones_y, every_y, low_y, high_y, threshold: float) -> np.ndarray:  # noqa: ANN001
    """Whether some text below one node can reach the threshold with some text below the other.

    A bit that all texts of the one side have and none of the other takes at least
    one token off any overlap, which otherwise may be the whole larger size.
    """
    only_x = np.bitwise_count(every_x & ~ones_y).sum(axis=1, dtype=np.int64)
    only_y = np.bitwise_count(every_y & ~ones_x).sum(axis=1, dtype=np.int64)
    overlap = np.minimum(high_x - only_x, high_y - only_y)
    return overlap >= threshold / (1 + threshold) * (low_x + low_y) - 1e-9


def texts_may_match(bitmap: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """may_match of single texts a and b."""
    kept = np.empty(len(a), bool)
    for at in range(0, len(a), TEXTS):
        i, j = a[at : at + TEXTS], b[at : at + TEXTS]
        x, y = bitmap[i], bitmap[j]
        kept[at : at + TEXTS] = may_match(x, x, size[i], size[i], y, y, size[j], size[j], threshold)
    return kept


def _bitmaps(column: pa.ChunkedArray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(bitmap, wide): the bitmaps of BITS; and for each greater width the place of a text among those that have it, or -1, and their bitmaps.

    A bit of a narrower bitmap is set if one of those that fall together in it is.
    """
    raw, step = column.to_pylist(), BITS // 8
    times, levels, fold = np.array([len(x) // step for x in raw], np.int64), [], 1
    while len(has := np.flatnonzero(times >= fold)):
        bits = np.empty((len(has), fold * step), np.uint8)
        for n in np.unique(times[has]).tolist():
            own = np.flatnonzero(times[has] == n)
            whole = np.frombuffer(b"".join([raw[i] for i in has[own].tolist()]), np.uint8)
            bits[own] = np.bitwise_or.reduce(whole.reshape(len(own), n // fold, fold * step), axis=1)
        place = np.full(len(raw), -1)
        place[has] = np.arange(len(has))
        levels.append((place, bits.view(np.uint64)))
        fold *= 2
    return levels[0][1], levels[1:]


def _distinct(seq_a: np.ndarray, seq_b: np.ndarray) -> pa.RecordBatch:
    low, high = np.minimum(seq_a, seq_b), np.maximum(seq_a, seq_b)
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    kept = low < high
    kept[1:] &= (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    n = int(kept.sum())
    nulls = [pa.nulls(n, t) for t in (pa.int64(), pa.int32(), pa.binary(), pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(low[kept]), pa.array(high[kept]), *nulls], FOUND_NAMES)


def _candidates(hot, threshold: float, plenty: float, several: int):  # noqa: ANN001
    """Walks the tree of each part, one after the other."""

    def walk(table: pa.Table) -> Iterator[pa.RecordBatch]:
        seq, size = (table.column(i).to_numpy() for i in (1, 2))
        size = size.astype(np.int64)
        lists = [table.column(i).combine_chunks() for i in (4, 5)]
        token, rest = (x.flatten().to_numpy() for x in lists)
        row = np.repeat(np.arange(len(seq)), lists[0].value_lengths().to_numpy())
        _, which, n = np.unique(token, return_inverse=True, return_counts=True)
        met = n[which] > 1
        token, rest, row = token[met], rest[met].astype(np.int64), row[met]
        if not len(token):
            return
        bitmap, wide = _bitmaps(table.column(3))
        tree = Tree(token, row, rest, size, bitmap, wide=wide)
        here = token[tree.order]
        hot_token = hot.value[0]
        if len(hot_token):
            tree.waits[tree.token_no[np.isin(here, hot_token)]] = True
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for a, b in tree.pairs(threshold, plenty, several):
            left.append(a)
            right.append(b)
        a, b = np.concatenate(left), np.concatenate(right)
        if tree.waits.any():
            kept = ~tree.waits[tree.token_no[a]]
            chains = [(a[kept], b[kept])]
            at = np.flatnonzero(tree.waits[tree.token_no])
            packed = table.column(3).combine_chunks()
            # chains of growing step join what is alike at little cost
            for step in 1 << np.arange(int(tree.members.max()).bit_length()):
                x, y = at[:-step], at[step:]
                same = tree.token_no[x] == tree.token_no[y]
                x, y = x[same], y[same]
                kept = tree.may_reach(x, y, threshold)
                chains.append((x[kept], y[kept]))
            a, b = (np.concatenate(x) for x in zip(*chains, strict=True))
            for begin in range(0, len(at), ROWS):
                some = at[begin : begin + ROWS]
                text = tree.row[some]
                columns = [pa.array(seq[text]), pa.nulls(len(some), pa.int64()), pa.array(here[some]), pa.array(size[text].astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*columns, packed.take(pa.array(text)), pa.array(tree.rest[some].astype(np.int32))], FOUND_NAMES)
        yield _distinct(seq[tree.row[a]], seq[tree.row[b]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, 1):
            yield from walk(table)

    return run


def _between_groups(threshold: float):
    """Walks the trees of tokens again, now that groups are known: (unit, seq, size, bitmap, rest, group, side), in order of unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ROWS):
            unit, seq, size, rest, group, side = (table.column(i).to_numpy() for i in (0, 1, 2, 4, 5, 6))
            bitmap, wide = _bitmaps(table.column(3))
            tree = Tree(unit, np.arange(len(seq)), rest.astype(np.int64), size.astype(np.int64), bitmap, group, side, wide)
            for a, b in tree.pairs(threshold):
                yield _distinct(seq[tree.row[a]], seq[tree.row[b]]).select(["a", "b"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                keys, sizes = [], []
                for column in (batch.column(2), batch.column(3)):
                    sets = column.to_pylist()
                    sizes.append(np.array([len(x) // WIDTH for x in sets], np.int64))
                    keys.append(np.repeat(np.arange(len(sets), dtype=np.uint64) << np.uint64(8 * WIDTH), sizes[-1]) | unpack(b"".join(sets)))
                both = np.sort(np.concatenate(keys))
                again = both[1:][both[1:] == both[:-1]] >> np.uint64(8 * WIDTH)
                overlap = np.bincount(again.astype(np.int64), minlength=batch.num_rows)
                kept = pa.array(np.flatnonzero(overlap >= threshold * (sizes[0] + sizes[1] - overlap) - 1e-9))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept)], ["a", "b"])

    met = pairs.join(sets.select(F.col("seq").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("seq").alias("b"), F.col("tokens").alias("y")), "b")
    return met.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _waiting(found: DataFrame, groups: DataFrame, split: int) -> DataFrame:
    """The entries that are walked again, with their groups, in units of one token; a token of more than `split` entries is
    parted in chunks, and each two chunks are a unit of two sides, each chunk alone one without."""
    hot = found.where("b IS NULL").select("token", F.col("a").alias("seq"), "size", "bitmap", "rest")
    chunks = hot.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / split).cast("int").alias("k"))
    met = hot.join(groups.withColumnsRenamed({"node": "seq", "root": "group"}), "seq", "left").join(chunks, "token").withColumn("i", F.pmod(F.xxhash64("seq"), F.col("k")).cast("int"))
    met = met.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    unit = F.xxhash64("token", F.least("i", "j"), F.greatest("i", "j"))
    side = F.when(F.col("i") == F.col("j"), -1).when(F.col("i") < F.col("j"), 0).otherwise(1)
    return met.select(unit.alias("unit"), "seq", "size", "bitmap", "rest", F.coalesce("group", F.lit(-1)).alias("group"), side.alias("side"))


def near_duplicates(df: DataFrame, key: str = "seq", text: str = "text", threshold: float = THRESHOLD, plenty: float = PLENTY, several: int = SEVERAL, split: int = SPLIT) -> DataFrame:
    """(key, group): every row that is linked to another one, with the smallest key of its group.

    Two texts are linked if their sets of word triples have at least `threshold`
    of their union in common; groups hold all that is linked directly or through
    others. Texts of fewer than three words (null and empty ones too) and rows
    without a key are in no group. Texts with equal sets are one class, of which
    only the smallest key goes through the search. A key that is there twice
    counts once. plenty, several and split only say how the work is parted: the
    groups are the same for any.
    """
    share = df.sparkSession.sparkContext.broadcast
    read = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("seq"), F.col(text).cast("string").alias("text"))
    sets = durable(read.mapInArrow(_sets, "seq bigint, tokens binary").withColumn("print", F.xxhash64("tokens")).withColumn("size", F.length("tokens")), "sets")
    classes = sets.groupBy("print", "size").agg(F.min("seq").alias("head"), F.max("seq").alias("other")).where("other > head")
    copies = classes.select("print", "size", "head").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    copies = sets.select("seq", "print", "size", F.pmod(F.hash("seq"), F.lit(16)).alias("salt")).join(copies, ["print", "size", "salt"]).where("seq <> head")
    copies = durable(copies.select(F.col("head").alias("a"), F.col("seq").alias("b")).distinct(), "copies")
    heads = sets.select("seq", "tokens").join(copies.select(F.col("b").alias("seq")), "seq", "left_anti")

    n, wide = F.col("size") / WIDTH, F.lit(1)
    for k in range(WIDER.bit_length() - 1):
        wide = F.when(n * DENSE > BITS << k, F.lit(2 << k)).otherwise(wide)
    count, held, carried = sets.agg(F.count(F.lit(1)), F.sum(n), F.sum(n * (ENTRY + wide * (BITS // 8)))).first()
    parts = max(PARTS, int((1 - threshold) * (held or 0) + count) // ENTRIES + 1)
    rounds = max(1, min(parts // PARTS, int((1 - threshold) * (carried or 0) / (SHARE * WIDTH * (held or 1))) + 1))
    some, step = _sample(sets, count)
    frequent = share(_frequent(some))
    # no token has more entries than there are texts
    hot = share(_hot(some, frequent, threshold, split / step, split / step) if count > split else (np.empty(0, np.int64), np.empty(0, np.int64)))
    firsts = heads.mapInArrow(_firsts(frequent, threshold), FIRSTS)
    if rounds > 1:
        firsts = durable(firsts, "firsts")
    found = None
    for turn in range(rounds):
        postings = spread(firsts.mapInArrow(_postings(hot, parts, rounds, turn), POSTINGS), "part", -(-parts // rounds))
        some = durable(postings.sortWithinPartitions("part").mapInArrow(_candidates(hot, threshold, plenty, several), FOUND), "candidates")
        found = found.unionByName(some) if found else some
    pairs = durable(found.where("b IS NOT NULL").select("a", "b").distinct(), "pairs")

    # first every text with the nearest smaller candidate: a chain, so no text has very many; pairs within a group then need no more work
    first = pairs.groupBy("b").agg(F.max("a").alias("a")).select("a", "b")
    links = durable(_verified(first, sets, threshold), "links")
    groups = durable(components(links), "groups")
    met = pairs.join(first, ["a", "b"], "left_anti")
    for end in ("a", "b"):
        met = met.join(groups.select(F.col("node").alias(end), F.col("root").alias(f"r{end}")), end, "left")
    rest = met.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    links = durable(links.unionByName(_verified(rest, sets, threshold)), "links")
    if found.where("b IS NULL").take(1):
        groups = durable(components(links), "groups")
        again = _waiting(found, groups, split).repartition("unit").sortWithinPartitions("unit")
        more = again.mapInArrow(_between_groups(threshold), "a bigint, b bigint").distinct()
        links = links.unionByName(_verified(more, sets, threshold))
    return components(links.unionByName(copies)).select(F.col("node").alias(key), F.col("root").alias("group"))


def referred(passages: DataFrame, occurrences: DataFrame) -> DataFrame:
    """The passages that some occurrence names."""
    named = occurrences.select(F.col("passage_id").alias("id")).where("id IS NOT NULL").distinct()
    return passages.select("seq", "id", "text").join(named, "id", "left_semi")


def duplicate_pairs(passages: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(seq_a, seq_b): two passages of one group, seq_a < seq_b. Distinct."""
    groups = durable(near_duplicates(referred(passages, occurrences)), "grouped")
    a, b = (groups.select("group", F.col("seq").alias(n)) for n in ("seq_a", "seq_b"))
    return a.join(b, "group").where("seq_a < seq_b").select("seq_a", "seq_b")
