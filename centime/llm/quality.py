"""Text quality statistics, and text types learnt from thresholds on them.

All statistics of a batch of texts come from array operations over code points.
Thresholds on statistics are labelling functions that vote prose, no prose or
nothing. Their accuracies are learnt by expectation-maximisation on how they
agree over all documents: only the counts of vote patterns are needed, of which
there are at most 5 to the number of functions. A document's posterior follows
from its pattern.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from centime.llm.words import _powers, blocks, code_points, fold_table, hash_words, mix, words
from centime.session import durable

#: Labelled rows used to place the thresholds, at most.
LABELLED = 4000
# Marks that end a sentence or clause at a line's end.
ENDING = ".!?;:…»”\")"
BULLETS = "-–—•*·▪◦"

STATISTICS = (
    "words", "mean_word_length", "symbol_ratio", "line_end_share", "common_share",
    "digit_share", "words_per_line", "bullet_share", "letter_share", "line_repeat_share",
)
STATS_SCHEMA = "visible bigint, words bigint, " + ", ".join(f"{s} double" for s in STATISTICS[1:])
#: The statistics that vote; a share of the whole text each, so that its length has no say.
VOTERS = STATISTICS[1:]
#: Statistics that are no shares and so may exceed 1.
UNBOUNDED = ("mean_word_length", "words_per_line")

SPACE, LETTER, DIGIT, MARK, PUNCTUATION, SYMBOL, HIDDEN = range(7)
# Marks of ordinary prose, which are no symbols.
PROSE_MARKS = ".,;:!?'’\"«»“”()-–—…%€°/&"


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    def of(code: int) -> int:
        if 0xD800 <= code < 0xE000:
            return SYMBOL
        ch = chr(code)
        kind = unicodedata.category(ch)
        if ch.isspace():
            return SPACE
        if kind in ("Mn", "Me"):
            return MARK
        if kind == "Nd":
            return DIGIT
        if ch.isalnum():
            return LETTER
        if kind in ("Cc", "Cf"):
            return HIDDEN
        return PUNCTUATION if ch in PROSE_MARKS else SYMBOL

    return np.array([of(c) for c in range(0x10000)], np.uint8)


@lru_cache(maxsize=1)
def _breaks() -> np.ndarray:
    table = np.zeros(0x10000, bool)
    table[[10, 13, 0x85, 0x2028, 0x2029]] = True
    return table


def _flags(chars: str) -> np.ndarray:
    table = np.zeros(0x10000, bool)
    table[[ord(c) for c in chars]] = True
    return table


_ending, _bullets = _flags(ENDING), _flags(BULLETS)


def statistics(texts: list[str | None], common: np.ndarray) -> dict[str, np.ndarray]:
    """Each statistic of each text; common: sorted hashes of the common words. A share of nothing is 0."""
    full, starts = code_points(texts)
    codes = np.minimum(full, 0xFFFF)
    kind = _classes()[codes]
    count = len(texts)

    def per_text(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return sums[starts[1:]] - sums[starts[:-1]]

    def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return np.divide(part, whole, out=np.zeros(count), where=whole > 0)

    letters, digits, symbols = per_text(kind == LETTER), per_text(kind == DIGIT), per_text(kind == SYMBOL)
    visible = letters + digits + symbols + per_text(kind == PUNCTUATION)
    found = words(texts)
    number = np.diff(found.first)
    at = np.searchsorted(common, found.hash)
    at[at == len(common)] = 0
    is_common = common[at] == found.hash if len(common) else np.zeros(len(found.hash), bool)
    commons = np.bincount(found.text[is_common], minlength=count)

    # lines that are not blank, by their first and last visible character
    seen = np.flatnonzero((kind != SPACE) & (kind != HIDDEN) & (kind != MARK))
    line = np.cumsum(_breaks()[codes])[seen]
    new = np.concatenate([[True], line[1:] != line[:-1]]) if len(seen) else np.zeros(0, bool)
    head, tail = seen[new], seen[np.append(new[1:], True)] if len(seen) else seen
    owner = np.searchsorted(starts, head, side="right") - 1
    lines = np.bincount(owner, minlength=count)
    ended = np.bincount(owner[_ending[codes[tail]]], minlength=count)
    bulleted = np.bincount(owner[_bullets[codes[head]] | (kind[head] == DIGIT)], minlength=count)
    # lines that equal another line of their text but for digits, case, accents and the width of gaps, by a hash of their characters
    repeated = np.zeros(count, np.int64)
    if len(head):
        gap = kind == SPACE
        gap[1:] &= kind[:-1] != SPACE
        counted = gap | (kind == LETTER) | (kind == SYMBOL) | (kind == PUNCTUATION)
        folded = np.where(kind == LETTER, fold_table()[codes], codes)
        folded = np.where(gap, ord(" "), np.where((folded > 1) & (full <= 0xFFFF), folded, full))
        place = np.concatenate([[0], np.cumsum(counted)])
        power, inverse = _powers(1 << max(16, len(full).bit_length()))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(counted, folded.astype(np.uint64) * power[place[:-1]], np.uint64(0)))])
        value = mix((sums[tail + 1] - sums[head]) * inverse[place[head]])
        key = mix(value + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, which, times = np.unique(key, return_inverse=True, return_counts=True)
        repeated = np.bincount(owner[times[which] > 1], minlength=count)
    return {
        "visible": visible,
        "words": number.astype(np.int64),
        "mean_word_length": share(letters + digits, number),
        "symbol_ratio": share(symbols, visible),
        "line_end_share": share(ended, lines),
        "common_share": share(commons, number),
        "digit_share": share(digits, letters + digits),
        "words_per_line": share(number, lines),
        "bullet_share": share(bulleted, lines),
        "letter_share": share(letters, visible),
        "line_repeat_share": share(repeated, lines),
    }


def text_statistics(docs: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, visible, words, mean_word_length, symbol_ratio, ...) for every row, in one pass and without a shuffle.

    visible is the number of visible characters.

    Null, empty and blank texts have 0 everywhere. Repeated rows and null keys are
    kept. common_words (word) is a small fixed list: it is sent to the tasks.
    """
    spark = docs.sparkSession
    listed = {w for r in common_words.select("word").distinct().toLocalIterator() if r["word"] for w in hash_words(r["word"]).tolist()}
    shared = spark.sparkContext.broadcast(np.array(sorted(listed), np.uint64))
    kind = docs.schema[key].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in blocks(texts):
                found = statistics(texts[begin:end], shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), *(pa.array(found[s]) for s in ("visible", *STATISTICS))], ["key", "visible", *STATISTICS])

    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(measure, f"key {kind}, {STATS_SCHEMA}").withColumnRenamed("key", key)


#: Votes of a function: the value lies within the range of prose, outside it, or so far outside that the range's half width is between.
FAR_LOW, LOW, INSIDE, HIGH, FAR_HIGH = range(5)
#: Shares of the votes within prose, at most.
BOUNDS = (0.0001, 0.004, 1.0, 0.004, 0.0001)
TYPES = ("prose", "list", "table", "junk")


def thresholds(labelled: list, outer: float = 0.0005) -> dict[str, tuple[float, float, float, float]]:
    """(far low, low, high, far high) of each voter: the quantiles `outer` and 1 - outer of labelled prose, and half their
    distance beyond, or half way to the least and greatest possible value if that is nearer."""
    table = {}
    for voter in VOTERS:
        values = np.array([r[voter] for r in labelled], float) if labelled else np.zeros(1)
        low, high = (float(x) for x in np.quantile(values, [outer, 1 - outer]))
        reach = (high - low) / 2
        far_high = high + reach if voter in UNBOUNDED else min(high + reach, (high + 1) / 2)
        table[voter] = (max(low - reach, low / 2), low, high, far_high)
    return table


def vote(voter: str, limits: tuple[float, float, float, float]) -> Column:
    """The vote of one labelling function as a Column."""
    far_low, low, high, far_high = limits
    value = F.col(voter)
    return F.when(value < far_low, FAR_LOW).when(value < low, LOW).when(value <= high, INSIDE).when(value <= far_high, HIGH).otherwise(FAR_HIGH)


def seed_types(patterns: np.ndarray) -> np.ndarray:
    """First guess of the types of vote patterns (rows), as probabilities.

    Prose where nothing is far outside its range and at most one voter outside
    it; else a table where digits stand out, a list where lines are marked, short
    or alike, junk otherwise.
    """
    of = {v: patterns[:, i] for i, v in enumerate(VOTERS)}
    far = ((patterns == FAR_LOW) | (patterns == FAR_HIGH)).sum(axis=1)
    outside = (patterns != INSIDE).sum(axis=1)
    table = of["digit_share"] >= HIGH
    listed = (of["bullet_share"] >= HIGH) | (of["words_per_line"] <= LOW) | (of["line_repeat_share"] >= HIGH)
    guess = np.where((far == 0) & (outside <= 1), 0, np.where(table, 2, np.where(listed, 1, 3)))
    return np.eye(len(TYPES))[guess] * 0.99 + 0.01 / len(TYPES)


class Model:
    """Shares of the types, and of each vote within a type, for every voter."""

    def __init__(self, prior: np.ndarray, votes: np.ndarray):
        self.prior, self.votes = prior, votes  # votes: voter x vote x type

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        logs = np.log(self.prior)[None, :] + sum(np.log(self.votes[i])[patterns[:, i]] for i in range(patterns.shape[1]))
        logs -= logs.max(axis=1, keepdims=True)
        odds = np.exp(logs)
        return odds / odds.sum(axis=1, keepdims=True)


def learn(patterns: np.ndarray, counts: np.ndarray, rounds: int = 40) -> Model:
    """Expectation-maximisation over counted vote patterns; shares are smoothed by one document.

    By the way the thresholds are placed, a voter puts next to no prose outside
    its range: the shares of such votes within prose stay below BOUNDS, else a
    type that only one voter can tell from prose would join it.
    """
    most = np.array(BOUNDS)
    weight = seed_types(patterns) * counts[:, None]
    model = Model(np.full(len(TYPES), 1 / len(TYPES)), np.full((len(VOTERS), 5, len(TYPES)), 0.2))
    for _ in range(rounds):
        total = weight.sum(axis=0)
        votes = np.stack([np.stack([weight[patterns[:, i] == v].sum(axis=0) for v in range(5)]) for i in range(len(VOTERS))])
        grown = Model((total + 1) / (total.sum() + len(TYPES)), (votes + 0.2) / (total + 1))
        grown.votes[:, :, 0] = np.minimum(grown.votes[:, :, 0], most)
        grown.votes[:, INSIDE, 0] += 1 - grown.votes[:, :, 0].sum(axis=1)
        shift = float(np.abs(grown.votes - model.votes).max())
        model = grown
        weight = model.posterior(patterns) * counts[:, None]
        if shift < 1e-6:
            break
    return model


def _learnt(docs: DataFrame, common_words: DataFrame, labels: DataFrame, most_labelled: int) -> tuple[DataFrame, dict, Model | None]:
    """(statistics of all documents, thresholds, model); no model without a document that is not blank."""
    measured = durable(text_statistics(docs, common_words).withColumn("blank", F.col("visible") == 0), "statistics")
    prose = labels.where("natural_text = 1 AND doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    limits = thresholds(prose.join(measured, "doc_id").select(*VOTERS).collect())
    votes = measured.withColumn("pattern", F.concat(*(vote(v, limits[v]).cast("string") for v in VOTERS)))
    counted = votes.where(~F.col("blank")).groupBy("pattern").count().collect()
    if not counted:
        return measured, limits, None
    patterns = np.array([[int(c) for c in r["pattern"]] for r in counted])
    return measured, limits, learn(patterns, np.array([r["count"] for r in counted], float))


def voter_accuracies(docs: DataFrame, common_words: DataFrame, labels: DataFrame, most_labelled: int = LABELLED) -> DataFrame:
    """(voter, vote, text_type, share, bounded): how often each voter gives each vote on documents of a type, as learnt from all documents.

    bounded: the share is at the bound that the placing of the thresholds sets for
    prose; all others are learnt freely. Empty without documents.
    """
    _, _, model = _learnt(docs, common_words, labels, most_labelled)
    names = ("far_low", "low", "inside", "high", "far_high")
    rows = [] if model is None else [
        (voter, names[v], kind, float(model.votes[i, v, k]), bool(k == 0 and v != INSIDE and model.votes[i, v, 0] >= BOUNDS[v] * (1 - 1e-9)))
        for i, voter in enumerate(VOTERS) for v in range(5) for k, kind in enumerate(TYPES)
    ]
    return docs.sparkSession.createDataFrame(rows, "voter string, vote string, text_type string, share double, bounded boolean")


def text_types(docs: DataFrame, common_words: DataFrame, labels: DataFrame, most_labelled: int = LABELLED) -> DataFrame:
    """(doc_id, the statistics, p_prose, text_type) for every row of docs.

    labels (doc_id, natural_text) place the thresholds: at most `most_labelled`
    rows of prose, those of least hash of doc_id, go to the driver. The accuracies
    of the thresholds are learnt from the votes of all documents that are not
    blank; the driver sees only counts of vote patterns. Null, empty and blank
    texts have null p_prose and text_type. Without labels or documents the result
    still has its columns. Repeated rows are kept.
    """
    measured, limits, model = _learnt(docs, common_words, labels, most_labelled)
    if model is None:
        return measured.drop("blank", "visible").withColumn("p_prose", F.lit(None).cast("double")).withColumn("text_type", F.lit(None).cast("string"))

    def log_odds(k: int) -> Column:
        total = F.lit(math.log(model.prior[k]))
        for i, voter in enumerate(VOTERS):
            total = total + F.element_at(F.array(*(F.lit(math.log(model.votes[i][v][k])) for v in range(5))), vote(voter, limits[voter]) + 1)
        return total

    scored = measured.select("doc_id", *STATISTICS, "blank", F.array(*(log_odds(k) for k in range(len(TYPES)))).alias("logs"))
    scored = scored.withColumn("top", F.array_max("logs"))
    odds = F.aggregate(F.transform("logs", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, x: a + x)
    kind = F.element_at(F.array(*(F.lit(t) for t in TYPES)), F.array_position("logs", F.col("top")).cast("int"))
    return scored.select(
        "doc_id",
        *STATISTICS,
        F.when(~F.col("blank"), F.exp(F.col("logs")[0] - F.col("top")) / odds).alias("p_prose"),
        F.when(~F.col("blank"), kind).alias("text_type"),
    )


def no_prose(docs: DataFrame, common_words: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id): documents whose text is not blank and for the most part no natural prose. Distinct."""
    return text_types(docs, common_words, labels).where("p_prose < 0.5").select("doc_id").distinct()
