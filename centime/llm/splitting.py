"""Texts over a size limit, cut into pieces at natural boundaries with overlap.

Sizes are in tokens: a token is a run of letters and digits, or any other single
visible character. Places where a cut may fall carry a penalty (paragraph end,
sentence end, between words); dynamic programming over them finds the cuts of
least penalty and least imbalance such that every piece, the overlap with the
piece before included, stays within the limit.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centime.llm.quality import HIDDEN, MARK, SPACE, _classes
from centime.llm.words import blocks, code_points

LIMIT, OVERLAP = 800, 150
#: Cost of a cut at a paragraph end, a sentence end, and between words; of pieces that differ by the limit in size.
PARAGRAPH, SENTENCE, BETWEEN, IMBALANCE = 0.0, 0.4, 1000.0, 1.0

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
_PARAGRAPH_END = re.compile(r"\n[^\S\n]*\n|\r\n?[^\S\n]*\r| ")
_LINE_END = re.compile(r"[\n\r \u0085]")
_SENTENCE_END = re.compile(r"[.!?…;:][\"»”’')\]]*$")


def count_tokens(texts: list[str | None]) -> np.ndarray:
    """Tokens of each text, for a batch at once; null and empty texts have none."""
    codes, starts = code_points(texts)
    kind = _classes()[np.minimum(codes, 0xFFFF)]
    word = (kind == 1) | (kind == 2)
    shown = (kind != HIDDEN) & (kind != MARK)
    if not shown.all():
        starts = np.concatenate([[0], np.cumsum(shown)])[starts]
        kind, word = kind[shown], word[shown]
    first = word.copy()
    first[1:] &= ~word[:-1]
    token = first | (~word & (kind != SPACE))
    sums = np.concatenate([[0], np.cumsum(token)])
    return sums[starts[1:]] - sums[starts[:-1]]


class Piece(NamedTuple):
    begin: int
    end: int
    tokens: int
    overlap: int


def tokens_of(text: str) -> list[tuple[int, int]]:
    """(begin, end) of the tokens of one text; marks and hidden characters belong to the token before."""
    spans: list[tuple[int, int]] = []
    table = _classes()
    for match in _TOKEN.finditer(text):
        begin, end = match.span()
        kind = table[min(ord(text[begin]), 0xFFFF)]
        if kind in (HIDDEN, MARK):
            continue
        if spans and kind in (1, 2) and spans[-1][1] < begin and table[min(ord(text[spans[-1][0]]), 0xFFFF)] in (1, 2):
            between = text[spans[-1][1] : begin]
            if all(table[min(ord(c), 0xFFFF)] in (HIDDEN, MARK) for c in between):
                spans[-1] = spans[-1][0], end
                continue
        spans.append((begin, end))
    return spans


def boundaries(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Penalty of a cut before each token (and after the last); infinite inside a word's text without a gap."""
    count = len(spans)
    penalty = np.full(count + 1, BETWEEN)
    penalty[0] = penalty[count] = 0.0
    for i in range(1, count):
        gap = text[spans[i - 1][1] : spans[i][0]]
        if not gap:
            penalty[i] = BETWEEN * 4 if text[spans[i][0]].isalnum() or text[spans[i][0]] in ".,;:!?’')" else BETWEEN * 2
        elif _PARAGRAPH_END.search(gap):
            penalty[i] = PARAGRAPH
        elif _LINE_END.search(gap) or _SENTENCE_END.search(text[max(0, spans[i - 1][1] - 4) : spans[i - 1][1]]):
            penalty[i] = SENTENCE
    return penalty


def cuts(penalty: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(first token, end token) of each piece: first lies at or before the end of the piece before, by `overlap` tokens at most.

    The overlap begins at the earliest natural boundary within reach, else takes
    all tokens it may. Only boundaries count as places for cuts, unless two of
    them lie too far apart: then every place between these does.
    """
    count = len(penalty) - 1
    if count <= limit:
        return [(0, count)]
    reach = limit - overlap
    natural = np.flatnonzero(penalty < BETWEEN)
    wide = np.flatnonzero(np.diff(natural) > reach)
    extra = [np.arange(natural[w] + 1, natural[w + 1]) for w in wide]
    places = np.unique(np.concatenate([natural, *extra])) if extra else natural
    # where the piece that is new from a place on begins
    near = natural[np.minimum(np.searchsorted(natural, places - overlap), len(natural) - 1)]
    begin = np.where((near < places) & (near >= places - overlap), near, np.maximum(places - overlap, 0))
    begin[0] = 0
    pieces = -(-(count - overlap) // reach)
    aim = count / pieces + overlap * (pieces - 1) / pieces
    best = np.full(len(places), np.inf)
    best[0], back = 0.0, np.zeros(len(places), np.int64)
    low = 0
    for j in range(1, len(places)):
        while places[j] - begin[low] > limit:
            low += 1
        size = places[j] - begin[low:j]
        cost = best[low:j] + IMBALANCE * ((size - aim) / limit) ** 2
        k = int(np.argmin(cost))
        best[j], back[j] = cost[k] + penalty[places[j]], low + k
    found, j = [], len(places) - 1
    while j:
        i = int(back[j])
        found.append((int(begin[i]), int(places[j])))
        j = i
    return found[::-1]


def split(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[Piece]:
    """The pieces of one text, as character places: the whole text is covered, and a text within the limit is one piece."""
    if not text:
        return []
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than the limit")
    spans = tokens_of(text)
    if not spans:
        return [Piece(0, len(text), 0, 0)]
    pieces, ended = [], 0
    for first, end in cuts(boundaries(text, spans), limit, overlap):
        begin = spans[first][0] if first else 0
        until = spans[end][0] if end < len(spans) else len(text)
        pieces.append(Piece(begin, until, end - first, max(0, ended - first)))
        ended = end
    return pieces


def chunk_text(chunk: str | None) -> str | None:
    """Member text of a JSON object; None unless the whole is valid JSON and text is a string."""
    if not chunk:
        return None
    try:
        held = json.loads(chunk, parse_constant=_strict)
    except (ValueError, RecursionError):
        return None
    text = held.get("text") if isinstance(held, dict) else None
    return text if isinstance(text, str) else None


def _strict(_: str) -> None:
    raise ValueError("not JSON")


PIECES = "key {kind}, piece int, pieces int, char_begin int, char_end int, tokens int, overlap int{text}"


def split_texts(
    df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, in_json: bool = False, only_cut: bool = False, with_text: bool = True
) -> DataFrame:
    """(key, piece, pieces, char_begin, char_end, tokens, overlap[, text]): every text of df in pieces of at most `limit` tokens.

    Consecutive pieces share `overlap` tokens at most. With in_json, the text is
    member text of a JSON object in the column; invalid JSON and members of
    another type have no piece. Null and empty texts have no piece; a text of
    blanks is one piece of 0 tokens; texts within the limit are one piece, left
    out with only_cut. Repeated rows are split each for itself. No shuffle.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            if in_json:
                texts = [chunk_text(t) if t and len(t) > (limit if only_cut else 0) else None for t in texts]
            rows: list[tuple] = []
            for begin, end in blocks(texts):
                part = texts[begin:end]
                sizes = count_tokens(part)
                for i, (held, size) in enumerate(zip(part, sizes.tolist(), strict=True), begin):
                    if not held or (only_cut and size <= limit):
                        continue
                    found = split(held, limit, overlap) if size > limit else [Piece(0, len(held), size, 0)]
                    for no, p in enumerate(found):
                        rows.append((i, no, len(found), p.begin, p.end, p.tokens, p.overlap, *([held[p.begin : p.end]] if with_text else [])))
            columns = list(zip(*rows, strict=True)) if rows else [()] * (8 if with_text else 7)
            taken = keys.take(pa.array(columns[0], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [taken, *(pa.array(c, pa.int32()) for c in columns[1:7]), *(pa.array(c, pa.string()) for c in columns[7:])],
                ["key", "piece", "pieces", "char_begin", "char_end", "tokens", "overlap", *(["text"] if with_text else [])],
            )

    schema = PIECES.format(kind=kind, text=", text string" if with_text else "")
    read = df.select(F.col(key), F.col(text).cast("string")).where(F.col(text).isNotNull())
    if only_cut:  # a token has a character at least
        read = read.where(F.length(text) > limit)
    return read.mapInArrow(run, schema).withColumnRenamed("key", key)


def oversized(passages: DataFrame, occurrences: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(item, id): texts of passages ('passage') and of occurrences' JSON ('chunk') that had to be cut. Distinct."""
    cut = [
        split_texts(df, "id", column, limit, overlap, in_json=in_json, only_cut=True, with_text=False).where("pieces > 1").select(F.lit(item).alias("item"), "id")
        for df, column, item, in_json in ((passages, "text", "passage", False), (occurrences, "chunk_json", "chunk", True))
    ]
    return cut[0].unionByName(cut[1]).distinct()


def pieces(passages: DataFrame, occurrences: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(item, id, piece, ...): the pieces of the texts of passages ('passage') and of occurrences' JSON ('chunk'), as split_texts gives them."""
    whole = [
        split_texts(df, "id", column, limit, overlap, in_json=in_json).select(F.lit(item).alias("item"), "*")
        for df, column, item, in_json in ((passages, "text", "passage", False), (occurrences, "chunk_json", "chunk", True))
    ]
    return whole[0].unionByName(whole[1])
