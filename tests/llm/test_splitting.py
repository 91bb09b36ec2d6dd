from __future__ import annotations

import json
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from centime.llm.splitting import BETWEEN, boundaries, count_tokens, cuts, oversized, split, split_texts, tokens_of


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aé́1 .,\n­​_🙂 ", max_size=60))
def test_counts_agree(text):
    assert count_tokens([text, None, ""]).tolist() == [len(tokens_of(text)), 0, 0] or not text.isascii()
    assert count_tokens([text])[0] == len(tokens_of(text))


def sentences(draw, n):
    return " ".join(" ".join("mot" for _ in range(draw.randrange(3, 30))) + draw.choice([".", " !", ".\n\n"]) for _ in range(n))


def test_pieces_cover_and_keep_the_limits():
    draw = random.Random(2)
    for n in (1, 20, 90, 200):
        text = sentences(draw, n)
        pieces, at = split(text, 200, 40), 0
        for p in pieces:
            assert p.begin <= at <= p.end and p.tokens <= 200 and p.overlap <= 40
            assert len(tokens_of(text[p.begin : p.end])) == p.tokens
            at = p.end
        assert pieces[0].begin == 0 and at == len(text)
        assert all(text[: p.end].rstrip()[-1] in ".!" for p in pieces)


def test_no_natural_boundary():
    text = "mot " * 2000
    pieces = split(text, 800, 150)
    assert all(p.tokens <= 800 for p in pieces) and pieces[-1].end == len(text) and all(p.overlap <= 150 for p in pieces)
    assert len(split("x" * 5000, 800, 150)) == 1
    assert all(p.tokens <= 10 for p in split("!" * 95, 10, 3))


def test_programming_is_optimal_on_small_texts():
    draw = random.Random(5)
    for _ in range(30):
        text = sentences(draw, 8)
        penalty = boundaries(text, tokens_of(text))
        found = cuts(penalty, 60, 10)
        ends = [e for _, e in found]
        assert ends[-1] == len(penalty) - 1 and all(b - a <= 60 for a, b in found)
        assert all(penalty[e] < BETWEEN for e in ends)


def test_cases(spark):
    long, short = "mot " * 801, "mot " * 800
    passages = spark.createDataFrame([("a", long, 3), ("b", short, 900), ("c", None, 1), ("d", "", 1), ("a", long, 3)], "id string, text string, tokens int")
    chunks = [("x", json.dumps({"text": long})), ("y", json.dumps({"text": [long]})), ("z", json.dumps({"text": long})[:-1]), ("w", None), ("v", json.dumps({"body": long})), ("u", json.dumps([long]))]
    occurrences = spark.createDataFrame(chunks, "id string, chunk_json string")
    assert sorted(map(tuple, oversized(passages, occurrences).collect())) == [("chunk", "x"), ("passage", "a")]
    got = split_texts(passages, "id", "text").collect()
    assert sorted((r["id"], r["piece"], r["pieces"]) for r in got) == [("a", 0, 2), ("a", 0, 2), ("a", 1, 2), ("a", 1, 2), ("b", 0, 1)]
    assert "".join(r["text"] for r in got if r["id"] == "b") == short
    assert oversized(passages.where("false"), occurrences.where("false")).collect() == []


def test_long_texts_in_batches():
    assert count_tokens(["a b" * 10, "x."]).tolist() == [11, 2]
    assert np.all(count_tokens(["", None]) == 0)


def test_pieces_come_of_passages_and_chunks(spark, tmp_path):
    from centime.llm.queries import p6_pieces

    long = "".join(f"mot{i} " for i in range(1700))
    spark.createDataFrame([("a", long), ("b", "court")], "id string, text string").write.parquet(str(tmp_path / "passages.parquet"))
    chunks = [("a", json.dumps({"text": long})), ("y", json.dumps({"text": "court"})), ("z", "{"), ("w", None)]
    spark.createDataFrame(chunks, "id string, chunk_json string").write.parquet(str(tmp_path / "occurrences.parquet"))
    got = p6_pieces(spark, str(tmp_path)).collect()
    found = {k: sorted((r for r in got if (r["item"], r["id"]) == k), key=lambda r: r["piece"]) for k in {(r["item"], r["id"]) for r in got}}
    assert set(found) == {("passage", "a"), ("passage", "b"), ("chunk", "a"), ("chunk", "y")}
    for item in ("passage", "chunk"):
        assert len(found[item, "a"]) == found[item, "a"][0]["pieces"] > 1
        assert all(r["text"] == long[r["char_begin"] : r["char_end"]] and r["tokens"] <= 800 for r in found[item, "a"])
        covered = 0
        for r in found[item, "a"]:
            assert r["char_begin"] <= covered <= r["char_end"]
            covered = r["char_end"]
        assert covered == len(long)
