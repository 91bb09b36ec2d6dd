"""Text that looks the same, brought to one form.

Code points and short strings that print alike are joined by union-find, over
everything that occurs in the corpus; a class stands for all of its members
however many steps part them. The most frequent member represents a class. Texts
are rewritten in two greedy passes of a multi-pattern automaton: single code
points first, then strings, the longest match first.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centime.functions.lookalike import shape_of
from centime.session import durable


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, s: str) -> str:
        root = s
        while (above := self.up.get(root, root)) != root:
            root = above
        while (above := self.up.get(s, s)) != root:
            self.up[s], s = root, above
        return root

    def join(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        self.up.setdefault(a, a)
        if a != b:
            self.up[b] = a

    def members(self) -> dict[str, list[str]]:
        held: dict[str, list[str]] = {}
        for s in self.up:
            held.setdefault(self.find(s), []).append(s)
        return held


def count_code_points(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Code point -> occurrences in the columns, over all rows. Counted in the tasks; there are at most 1,114,112 results."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for batch in batches:
            for i in range(batch.num_columns):
                codes = np.frombuffer("".join(t for t in batch.column(i).to_pylist() if t).encode("utf-32-le", "surrogatepass"), np.uint32)
                found = np.bincount(codes)
                total[: len(found)] += found
        codes = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int32)), pa.array(total[codes])], ["code", "n"])

    counted = df.select(*(F.col(c).cast("string") for c in columns)).mapInArrow(count, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    return {chr(r["code"]): r["n"] for r in counted.collect()}


class Form:
    """How texts are rewritten: built from the code points of a corpus and how often each occurs."""

    def __init__(self, counts: dict[str, int]):
        classes = Classes()
        for ch in counts:
            for part in {ch, *unicodedata.normalize("NFD", ch)}:
                shape = shape_of(part)
                if shape != part:
                    classes.join(shape, part)
                for plain in shape:
                    classes.join(plain, plain)
        # a code point stands for itself, a string for what its parts come to; the empty string for all that is invisible
        single: dict[str, str] = {}
        strings: dict[str, str] = {}
        for members in classes.members().values():
            alone = [m for m in members if len(m) == 1]
            longer = [m for m in members if len(m) > 1]
            if "" in members:
                chosen = ""
            elif longer:
                chosen = longer[0]
            else:
                chosen = max(alone, key=lambda m: (counts.get(m, 0), -ord(m)))
            for m in alone:
                if m != chosen:
                    (single if len(chosen) <= 1 else strings)[m] = chosen
        self.single = {ord(m): chosen for m, chosen in single.items()}
        self.strings = {m: "".join(single.get(c, c) for c in chosen) for m, chosen in strings.items()}

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.strings:
            return None
        machine = ahocorasick.Automaton()
        for pattern, chosen in self.strings.items():
            machine.add_word(pattern, (len(pattern), chosen))
        machine.make_automaton()
        return machine


class Rewriter:
    """Rewrites texts by a Form; made once in each task."""

    def __init__(self, form: Form):
        self.form, self.machine = form, form.automaton()

    def __call__(self, text: str | None) -> str | None:
        if not text:
            return text
        plain = text.isascii()
        if not plain:
            text = unicodedata.normalize("NFD", text)
        text = text.translate(self.form.single)
        if not plain:
            if self.machine:
                out, at = [], 0
                for last, (size, chosen) in self.machine.iter_long(text):
                    out += [text[at : last + 1 - size], chosen]
                    at = last + 1
                text = "".join([*out, text[at:]])
            text = unicodedata.normalize("NFC", text)
        return text


def one_form(df: DataFrame, columns: list[str], suffix: str = "_form") -> DataFrame:
    """df with a column more for each given one: its text in the one form of all texts that look like it.

    Two texts get equal forms exactly if they look the same: width, composition of
    accents, invisible characters, kind of space, ligatures and look-alike letters
    do not count; case, accents, number of spaces, shapes of dashes, minus signs and
    apostrophes do. Null stays null, empty stays empty. Frequencies are counted
    over all rows; repeated rows are kept.
    """
    form = Form(count_code_points(df, columns))
    shared = df.sparkSession.sparkContext.broadcast(form)

    @F.pandas_udf("string")
    def rewrite(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rewriter = Rewriter(shared.value)
        for part in parts:
            yield part.map(rewriter, na_action="ignore")

    for c in columns:
        df = df.withColumn(c + suffix, rewrite(F.col(c).cast("string")))
    return df


def _cells(facts: DataFrame, fields: tuple[str, ...], key: str, within: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """(cells, group): the cells whose group (table, field and form) has more than one string, with the group's least id; what a group is."""
    formed = one_form(facts.select(key, *within, *fields), list(fields))
    cells = formed.select(
        F.col(key).alias("id"), *within, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text"), F.col(f + "_form").alias("form")) for f in fields))).alias("cell")
    ).select("id", *within, "cell.field", "cell.text", "cell.form")
    cells = durable(cells.dropna(subset=[*within, "text", "id"]).withColumn("print", F.xxhash64("text")), "cells")
    group = [*within, "field", "form"]
    # minima are combined before the shuffle; most groups have one string and go no further
    several = cells.groupBy(*group).agg(F.min("print").alias("least"), F.max("print").alias("most"), F.min("id").alias("class")).where("least <> most").select(*group, "class")
    return cells.drop("print").join(several, group), group


def look_classes(facts: DataFrame, fields: tuple[str, ...] = ("raw", "row_label"), key: str = "id", within: tuple[str, ...] = ("source_id", "table_index")) -> DataFrame:
    """(field, id, class): every row whose field looks like another string of its table, with the least id of all rows that look so.

    One row for each row and field, however many look alike. Nulls as in same_look. Distinct.
    """
    cells, _ = _cells(facts, fields, key, within)
    return cells.select("field", "id", "class").distinct()


def same_look(facts: DataFrame, fields: tuple[str, ...] = ("raw", "row_label"), key: str = "id", within: tuple[str, ...] = ("source_id", "table_index")) -> DataFrame:
    """(field, id_a, id_b): two rows of one table whose field looks the same but is not the same string; id_a < id_b. Distinct.

    Rows with a null in `within` are in no table; null fields look like nothing;
    empty texts look like texts of invisible characters. Distinct strings are
    paired within their group first, so rows with equal strings never meet: the
    work is that of the result.
    """
    cells, group = _cells(facts, fields, key, within)
    cells = durable(cells.drop("class"), "varied")
    strings = cells.select(*group, "text").distinct()
    pairs = strings.withColumnRenamed("text", "text_a").join(strings.withColumnRenamed("text", "text_b"), group).where("text_a < text_b")
    met = pairs.join(cells.withColumnsRenamed({"id": "x", "text": "text_a"}), [*group, "text_a"]).join(cells.withColumnsRenamed({"id": "y", "text": "text_b"}), [*group, "text_b"])
    return met.where("x <> y").select("field", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
