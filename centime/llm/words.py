"""Words of texts as 64-bit hashes, found for a whole batch at once with array operations.

A word is a run of letters or digits (Unicode); case and accents, however
composed, are ignored. One table lookup per code point folds it; runs are found
by comparing neighbours; a word's hash is the difference of two prefix sums of a
polynomial modulo 2**64, shifted to the run's start.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np

#: Folded value of code points that are no part of a word, and of combining marks, which are passed over.
BREAK, MARK = 0, 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def fold_code(code: int) -> int:
    """A code point without case and accents; BREAK outside words, MARK for combining marks."""
    ch = chr(code)
    if unicodedata.category(ch) in ("Mn", "Me"):
        return MARK
    base = unicodedata.normalize("NFD", ch)
    base = "".join(c for c in base if unicodedata.category(c) != "Mn")
    base = base.lower() if len(base) == 1 else ch.lower()
    base = unicodedata.normalize("NFD", base)[:1]
    if not ch.isalnum():
        return BREAK
    return ord(base) if base else code


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """Folded values of the first 65,536 code points."""
    return np.array([BREAK if 0xD800 <= c < 0xE000 else fold_code(c) for c in range(0x10000)], np.uint32)


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    grown = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
    for a in grown:
        a[0] = 1
        np.cumprod(a, out=a)
    return grown


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose low and high bits depend on all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words(NamedTuple):
    """hash of each word, in order; index of its text; first: of each text (and one more) the number of words before it."""

    hash: np.ndarray
    text: np.ndarray
    first: np.ndarray


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All code points, texts parted by one line feed; and where each text starts (and one more)."""
    composed = [t if t.isascii() or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t) for t in (t or "" for t in texts)]
    starts = np.zeros(len(composed) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in composed], out=starts[1:])
    codes = np.frombuffer("\n".join([*composed, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, starts


def fold(codes: np.ndarray) -> np.ndarray:
    folded = fold_table()[np.minimum(codes, 0xFFFF)]
    far = np.flatnonzero(codes > 0xFFFF)
    if len(far):
        values, which = np.unique(codes[far], return_inverse=True)
        folded[far] = np.array([fold_code(int(c)) for c in values], np.uint32)[which]
    return folded


#: Characters looked at in one go; a longer text is taken in parts, cut before a blank where there is one.
PART = 1 << 22
_blank = re.compile(r"\s")


def _runs(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(value, begin, end, starts, size): the words' polynomial values and places among the folded characters without marks, and each text's."""
    codes, starts = code_points(texts)
    folded = fold(codes)
    kept = folded != MARK
    if not kept.all():
        starts = np.concatenate([[0], np.cumsum(kept)])[starts]
        folded = folded[kept]
    inside = folded > MARK
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    begin, end = edge[0::2], edge[1::2]
    power, inverse = _powers(1 << max(16, int(len(folded)).bit_length()))
    sums = np.zeros(len(folded) + 1, np.uint64)
    np.cumsum(folded.astype(np.uint64) * power[: len(folded)], out=sums[1:])
    return (sums[end] - sums[begin]) * inverse[begin], begin, end, starts, len(folded) - 1


def _parts_at(text: str, at: int) -> bool:
    """Whether nothing of a text is composed across a place."""
    pair = text[at - 1 : at + 1]
    return not unicodedata.combining(pair[1]) and unicodedata.normalize("NFC", pair) == pair


def _parts(text: str) -> Iterator[str]:
    """Parts of at most PART characters: cut before the last blank, and where there is none, within the word."""
    at = 0
    while len(text) - at > PART:
        window = text[at : at + PART]
        blank = _blank.search(window[::-1])
        cut = PART - blank.end() if blank else 0
        if not cut:
            cut = PART
            while cut > 1 and not _parts_at(text, at + cut):
                cut -= 1
        yield text[at : at + cut]
        at += cut
    yield text[at:]


def _long(text: str) -> np.ndarray:
    """Hashes of one very long text: a word that a cut falls into goes on in the next part."""
    found: list[np.ndarray] = []
    value, length, is_open = 0, 0, False
    for part in _parts(text):
        values, begin, end, _, size = _runs([part])
        if is_open and size and not (len(begin) and begin[0] == 0):
            found.append(np.array([value], np.uint64))
            is_open = False
        if not len(values):
            continue
        first, last = 0, len(values)
        if is_open and begin[0] == 0:
            value = (value + pow(_BASE, length, 1 << 64) * int(values[0])) % (1 << 64)
            length += int(end[0])
            first = 1
            if end[0] < size:
                found.append(np.array([value], np.uint64))
                is_open = False
        if end[-1] == size and last > first:
            value, length, is_open = int(values[-1]), int(end[-1] - begin[-1]), True
            last -= 1
        found.append(values[first:last])
    if is_open:
        found.append(np.array([value], np.uint64))
    return mix(np.concatenate([np.empty(0, np.uint64), *found]))


def words(texts: list[str | None]) -> Words:
    """The words of a list of texts; null texts have none. Texts of any length are taken whole."""
    found, sizes = [np.empty(0, np.uint64)], [np.zeros(1, np.int64)]
    for begin, end in blocks(texts, PART + 1):
        some = texts[begin:end]
        if end == begin + 1 and some[0] and len(some[0]) > PART:
            found.append(_long(some[0]))
            sizes.append(np.array([len(found[-1])]))
            continue
        value, at, _, starts, _ = _runs(some)
        found.append(mix(value))
        sizes.append(np.diff(np.searchsorted(at, starts)))
    first = np.cumsum(np.concatenate(sizes))
    return Words(np.concatenate(found), np.repeat(np.arange(len(texts)), np.diff(first)), first)


def blocks(texts: list[str | None], most: int = 1 << 21):
    """Consecutive (begin, end) ranges of texts of at most `most` characters together, one text at least."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        size = len(text) + 1 if text else 1
        if held and held + size > most:
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(texts):
        yield begin, len(texts)


def hash_words(text: str) -> np.ndarray:
    """Hashes of one text's words."""
    return words([text]).hash
