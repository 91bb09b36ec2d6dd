from __future__ import annotations

import random

import numpy as np
import pytest

from centime.llm import fmindex
from centime.llm.fmindex import FMIndex, leaked_spans, leaks, suffix_order
from centime.llm.words import words


@pytest.mark.parametrize("seed", range(12))
def test_search_and_locate_against_scanning(seed):
    draw = random.Random(seed)
    runs = [[draw.randrange(1, 4) for _ in range(draw.randrange(3, 40))] for _ in range(30)] + [[1, 2] * 30] * 3
    symbols = np.array([s for run in runs for s in [*run, 0]], np.int64)
    index = FMIndex(symbols, 3)
    phrases = np.array([[draw.randrange(1, 4) for _ in range(5)] for _ in range(60)], np.int64)
    found, low, high = index.search(phrases.ravel(), np.arange(0, 300, 5), 5)
    hits = {int(p): sorted(index.locate(np.arange(a, b)).tolist()) for p, a, b in zip(found, low, high, strict=True)}
    for p, phrase in enumerate(phrases):
        assert hits.get(p, []) == [i for i in range(len(symbols) - 4) if (symbols[i : i + 5] == phrase).all()]


def test_suffix_order_is_a_permutation():
    symbols = np.array([1, 1, 1, 0, 1, 1, 1, 0, 0], np.int64)
    assert sorted(suffix_order(symbols).tolist()) == list(range(9))


ITEM = "Le taux nominal de l'action dépasse le plafond moyen pour 17 307 milliers d'euros sans changement aucun de périmètre cette année encore"


def frames(spark):
    half = " ".join(ITEM.split()[3:20])
    docs = [
        (1, f"Avant. {ITEM} Après.", 0), (2, half.upper().replace(" ", "\n"), 0), (3, " ".join(ITEM.split()[:9]), 0), (4, None, 0), (5, "", 0), (1, ITEM, 0),
        (6, ("x " * 50) + ITEM.replace("é", "é") + (" y" * 50), 0), (None, ITEM, 0),
    ]
    items = [(10, ITEM, "a"), (11, ITEM, "b"), (12, "trop court", "c"), (13, None, "d"), (None, ITEM, "e")]
    return spark.createDataFrame(docs, "doc_id bigint, text string, item_id int"), spark.createDataFrame(items, "item_id bigint, text string, doc_id string")


def test_cases(spark):
    docs, items = frames(spark)
    got = {((r["doc_id"] or 0), r["item_id"]) for r in leaks(docs, items).collect()}
    assert got == {(d, i) for d in (0, 1, 2, 6) for i in (10, 11)}
    assert leaks(docs.where("false"), items).collect() == []
    assert leaks(docs, items.where("false")).collect() == []


def test_spans_and_shards(spark, monkeypatch):
    docs, items = frames(spark)
    spans = {(r["doc_id"], r["word_begin"], r["word_end"]) for r in leaked_spans(docs, items).where("item_id = 10 AND doc_id IS NOT NULL").collect()}
    count = len(words([ITEM]).hash)
    assert {(1, 1, 1 + count), (1, 0, count), (6, 50, 50 + count)} < spans


def test_runs_longer_than_a_shard(monkeypatch):
    monkeypatch.setattr(fmindex, "SHARD", 40)
    draw = random.Random(3)
    phrases = np.array([[draw.randrange(1, 3) for _ in range(5)] for _ in range(8)], np.int64)
    text = np.array([draw.randrange(1, 3) for _ in range(500)], np.int64)
    items = fmindex.items_of(list(range(8)), [np.array([0, 1], np.uint64)[p - 1] for p in phrases], 5)
    assert items.vocabulary.tolist() == [0, 1] and len(items.owner) == 8
    shard = fmindex._Shard(items, 5)
    spans = [s for part in (*shard.add(text, np.zeros(500, np.int64), np.arange(500)), *shard.flush()) for s in zip(*(x.tolist() for x in part), strict=True)]
    covered = {(item, p) for _, item, a, b in spans for p in range(a, b)}
    assert covered == {(k, p) for k, phrase in enumerate(phrases) for i in range(496) if (text[i : i + 5] == phrase).all() for p in range(i, i + 5)}


def test_item_tables_have_each_phrase_once():
    hashed = [np.array(x, np.uint64) for x in ([5, 9, 5, 9, 5, 9], [9, 5, 9, 7], [5], [5, 9, 5])]
    items = fmindex.items_of([10, 11, 12, 13], hashed, 3)
    phrases = [tuple(items.vocabulary[items.sequence[s : s + 3] - 1].tolist()) for s in items.starts]
    owners = [sorted(items.ids[items.owner[a:b]].tolist()) for a, b in zip(items.begin, items.begin[1:], strict=False)]
    assert dict(zip(phrases, owners, strict=True)) == {(5, 9, 5): [10, 13], (9, 5, 9): [10, 11], (5, 9, 7): [11]}
    assert len(fmindex.items_of([], [], 3).starts) == 0 and len(fmindex.items_of([1], [np.array([3], np.uint64)], 3).starts) == 0


def test_rounds_find_the_same(spark, monkeypatch):
    docs, items = frames(spark)
    whole = sorted(map(str, leaked_spans(docs, items).collect()))
    assert sorted(map(str, leaked_spans(docs, items, round_bytes=1).collect())) == whole and whole


def test_keys_of_searched_documents_are_dropped():
    items = fmindex.items_of([1], [np.arange(5, dtype=np.uint64)], 5)
    shard = fmindex._Shard(items, 5)
    list(shard.add(np.array([1, 2, 3, 4, 5, 0]), np.array([2, 2, 2, 2, 2, 3]), np.arange(6)))
    assert shard.kept(["a", "b", "c", "d"]) == ["c"] and shard.docs[0].tolist() == [0] * 6
    assert [x.tolist() for x in next(iter(shard.flush()))] == [[0], [0], [0], [5]]
    assert shard.kept(["c"]) == []


def test_very_long_texts(spark):
    filler = "autre chose ici " * 300_000
    docs = spark.createDataFrame([(1, filler + ITEM), (2, "x" * 5_000_000), (3, "x" * 4_500_000 + " " + ITEM)], "doc_id bigint, text string")
    items = spark.createDataFrame([(10, ITEM)], "item_id bigint, text string")
    count = len(words([ITEM]).hash)
    assert sorted(map(tuple, leaked_spans(docs, items).collect())) == [(1, 10, 900_000, 900_000 + count), (3, 10, 1, 1 + count)]
