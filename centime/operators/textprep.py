"""Preparing passages: blocks of rows, proof that chunks tile their source, exact recovery of segments."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def literal_lines(cells: Column) -> Column:
    """'Colonne 1 : x ; Colonne 3 : 0': null cells are left out, empty and zero ones are not."""
    shown = F.transform(cells, lambda v, i: F.when(v.isNotNull(), F.concat(F.lit("Colonne "), (i + 1).cast("string"), F.lit(" : "), v)))
    return F.array_join(F.filter(shown, lambda x: x.isNotNull()), " ; ")


def row_blocks(rows: DataFrame, section: list[str], order: list[Column], line: str, size: int = 32, stretch: Column | None = None) -> DataFrame:
    """Consecutive rows of a section joined into blocks of `size` lines.

    stretch parts a section into stretches that follow each other in its order (a
    null one last): rows are then numbered within their stretch, from the counts of
    the stretches before, so that a section of any length is no task of its own.
    """
    parts = [*section, "_stretch"]
    marked = rows.withColumn("_stretch", F.lit(0) if stretch is None else stretch)
    counts = marked.groupBy(*parts).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*section).orderBy(F.asc_nulls_last("_stretch")).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows").withColumnsRenamed({c: f"_s{c}" for c in parts})
    same = F.lit(True)
    for c in parts:
        same = same & F.col(c).eqNullSafe(F.col(f"_s{c}"))
    numbered = marked.join(counts, same).withColumn("_no", F.col("_before") + F.row_number().over(Window.partitionBy(*parts).orderBy(*order)) - 1)
    numbered = numbered.withColumn("block", F.floor(F.col("_no") / size).cast("int"))
    joined = F.transform(F.sort_array(F.collect_list(F.struct("_no", line))), lambda x: x[line])
    return numbered.groupBy(*section, "block").agg(F.count(F.lit(1)).alias("lines"), F.array_join(joined, "\n").alias("text"))


def segment_breaks(segments: DataFrame, by: list[str], begin: str, end: str) -> DataFrame:
    """Segments that do not begin where the one before ended: gap or overlap, and by how much."""
    before = F.lag(end).over(Window.partitionBy(*by).orderBy(begin, end))
    told = segments.withColumn("shift", F.col(begin) - before).where("shift <> 0")
    return told.withColumn("kind", F.when(F.col("shift") > 0, "gap").otherwise("overlap"))


# Tokens as the overlap of chunks is counted in: a run of letters and digits, or any other single visible character.
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")


def _flat(text: str) -> str:
    return re.sub(r"\s+", " ", unicodedata.normalize("NFC", text)).strip()


def tiles(source: str, chunks: list[str], most_overlap: int) -> bool:
    """Whether chunks, in order, cover a text.

    Every place where a chunk occurs is an interval. An interval may follow one of
    the chunk before if it begins no earlier, ends later, leaves out nothing but a
    blank, and at most `most_overlap` tokens begin in what the two share. All
    intervals that can be reached from the start are kept, so repeated phrases do
    no harm; one of the last chunk must end where the text ends. Composition of
    accents and kind of blanks do not count; an empty chunk covers nothing: false.
    """
    text = _flat(source)
    marks = np.array([m.start() for m in _TOKEN.finditer(text)], np.int64)
    blank = np.array([c == " " for c in text] + [False, False])
    begin, end = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for part in map(_flat, chunks):
        if not part:
            return False
        start = np.array([m.start() for m in re.finditer(f"(?={re.escape(part)})", text)], np.int64)[None, :]
        stop, last, first = start + len(part), end[:, None], begin[:, None]
        shared = np.searchsorted(marks, last) - np.searchsorted(marks, start)
        joined = (start <= last) | ((start == last + 1) & blank[last])
        reached = (joined & (start >= first) & (stop > last) & (shared <= most_overlap)).any(axis=0)
        begin, end = start[0, reached], stop[0, reached]
    return bool((end == len(text)).any())


def tiling(records: DataFrame, key: str, source: str, chunks: str, most_overlap: int = 150) -> DataFrame:
    """(key, covered): whether the chunks (array<string>) of each record tile its source. Null source or chunks: false."""
    kind = records.schema[key].dataType.simpleString()

    def check(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            covered = [isinstance(s, str) and c is not None and tiles(s, [x for x in c if x is not None], most_overlap) for s, c in zip(part["source"], part["chunks"], strict=True)]
            yield pd.DataFrame({"key": part["key"], "covered": covered})

    read = records.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(chunks).alias("chunks"))
    return read.mapInPandas(check, f"key {kind}, covered boolean").withColumnRenamed("key", key)


def exact_dedup(df: DataFrame, text: str, key: str) -> DataFrame:
    """One row for each distinct text: its digest, the smallest key and how many rows have it; null texts have none."""
    held = df.where(F.col(text).isNotNull())
    return held.groupBy(F.sha2(F.col(text), 256).alias("digest")).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies"))


def recover(segments: DataFrame, by: list[str], begin: str, end: str, text: str) -> DataFrame:
    """(by, digest, segments, moved, wrong_length, word_split): a block put together from its segments in order.

    moved: a segment does not begin where the one before ended (the first at 0);
    wrong_length: its places are not as many as its characters; word_split: two
    segments meet inside a word. digest: SHA-256 of the text put together.
    """
    window = Window.partitionBy(*by).orderBy(begin, end, text)
    before = F.lag(text).over(window)
    split = (before != "") & (F.col(text) != "") & ~F.substring(before, -1, 1).rlike(r"\s") & ~F.substring(text, 1, 1).rlike(r"\s")
    marked = segments.select(*by, begin, end, text, (F.col(begin) != F.coalesce(F.lag(end).over(window), F.lit(0))).alias("_moved"), F.coalesce(split, F.lit(False)).alias("_split"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(begin, end, text))), lambda s: s[text]), "")
    return marked.groupBy(*by).agg(
        F.sha2(joined, 256).alias("digest"), F.count(F.lit(1)).alias("segments"), F.bool_or("_moved").alias("moved"), F.bool_or(F.col(end) - F.col(begin) != F.length(text)).alias("wrong_length"),
        F.bool_or("_split").alias("word_split"),
    )
