from __future__ import annotations

import random

import pytest

from centime.llm.bpe import VOCABULARIES, decode, encode_texts, load

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def machine():
    return load()


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(f"{VOCABULARIES}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_equals_the_merge_loop_on_random_texts(machine, reference):
    draw, encoder = random.Random(1), machine.encoder()
    alphabets = ["aeinstr", "aab  \n\t'st.,0123lé’🙂́\x00\x1c 你ſ²½", "".join(chr(draw.randrange(32, 0x2000)) for _ in range(60))]
    for i in range(6000):
        text = "".join(draw.choice(alphabets[i % 3]) for _ in range(draw.randrange(1, 50)))
        ids = encoder.encode(text)
        assert ids == reference(text)
        assert decode(ids, machine) == text


@pytest.mark.parametrize("text", ["a" * 3000, " " * 500, "ab" * 1000, "<|endoftext|>", "don't'll", "\r\n \n", "­​x"])
def test_long_and_odd_texts(machine, reference, text):
    assert machine.encoder().encode(text) == reference(text)


def test_columns_nulls_and_repeats(spark, reference):
    rows = [(1, "Le fonds", "clash"), (2, None, "x"), (3, "", None), (None, "a", None), (1, "Le fonds", "clash")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = encode_texts(docs, "doc_id", "text")
    assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert sorted(((r["doc_id"] or 0), r["ids"]) for r in got.collect()) == sorted([(1, reference("Le fonds")), (2, []), (3, []), (0, reference("a")), (1, reference("Le fonds"))])
    assert encode_texts(docs.where("false"), "doc_id", "text").collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_split_into_words_like_the_pattern(seed):
    import numpy as np
    import regex

    from centime.llm.bpe import SPLIT, split_places

    draw = random.Random(seed)
    alphabet = "ab1² \n\t'' 's.,’strevlmd­́ 🙂"
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randrange(0, 12))) for _ in range(4000)]
    whole = "".join(t + "\n" for t in texts)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    places = split_places(np.frombuffer(whole.encode("utf-32-le"), np.uint32), ends)
    base, expected = 0, []
    for text in texts:
        expected += [base + m.start() for m in regex.finditer(SPLIT, text)] + [base + len(text)]
        base += len(text) + 1
    assert places.tolist() == expected


def test_memory_is_bounded_by_bytes(machine, reference):
    encoder = machine.encoder(keep=10_000)
    for i in range(300):
        text = f"mot{i} " * 3 + "x" * 990
        assert encoder.encode(text) == reference(text)
        assert encoder.held <= 10_000 + 8 * 1000 + 2000
    assert encoder.encode("y" * 5000) == reference("y" * 5000) and "y" * 5000 not in encoder.known


def test_decoding_gives_the_texts_back(spark):
    from centime.llm.bpe import decode_texts

    rows = [(1, "Le fonds n’a pas l'été ½ 🙂"), (2, None), (3, ""), (None, " a\n\n b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = decode_texts(encode_texts(docs, "doc_id", "text"), "doc_id", "ids")
    assert sorted(((r["doc_id"] or 0), r["text"]) for r in got.collect()) == sorted(((k or 0), t or "") for k, t in rows)
    odd = spark.createDataFrame([(1, None), (2, [-5, None, 999_999]), (3, [127])], "doc_id bigint, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in decode_texts(odd, "doc_id", "ids").collect()} == {1: None, 2: "", 3: "�"}
