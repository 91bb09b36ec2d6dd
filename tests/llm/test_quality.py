from __future__ import annotations

import random

import numpy as np

from centime.llm.quality import STATISTICS, VOTERS, learn, no_prose, statistics, text_statistics, text_types, thresholds, voter_accuracies
from centime.llm.words import hash_words

COMMON = ["le", "la", "de", "des", "et", "pour", "dans", "est"]


def test_statistics_by_hand():
    common = np.array(sorted(int(hash_words(w)[0]) for w in COMMON), np.uint64)
    found = statistics(["Le fonds est là.\n- 12 euros\n\n***", None, "", " \n"], common)
    got = {s: found[s][0] for s in STATISTICS}
    assert got["words"] == 6 and abs(got["mean_word_length"] - 19 / 6) < 1e-9
    assert abs(got["common_share"] - 3 / 6) < 1e-9  # là counts as la
    assert abs(got["line_end_share"] - 1 / 3) < 1e-9 and abs(got["bullet_share"] - 2 / 3) < 1e-9
    assert abs(got["symbol_ratio"] - 3 / 24) < 1e-9
    assert all(found[s][i] == 0 for s in STATISTICS for i in (1, 2, 3))


def prose(draw):
    return " ".join(" ".join(draw.choice(COMMON if draw.random() < 0.4 else ["fonds", "dépense", "plafond", "recette", "mission"]) for _ in range(draw.randrange(8, 20))) + "." for _ in range(draw.randrange(3, 12)))


def junk(draw):
    kind = draw.randrange(3)
    if kind == 0:
        return "\n".join("Rubrique ; " + " ; ".join(str(draw.randrange(10**5)) for _ in range(6)) for _ in range(9))
    if kind == 1:
        return "\n".join(f"- {draw.choice(['fonds', 'recette', 'plafond'])} moyen" for _ in range(15))
    return "".join(draw.choice("#*~^{}|<>_ aq") for _ in range(400))


def test_types_are_learnt(spark):
    draw = random.Random(1)
    rows = [(i, prose(draw) if i % 4 else junk(draw), "clash") for i in range(800)] + [(1000, None, ""), (1001, "", ""), (1002, " \n", ""), (0, junk(draw), ""), (900, "... ;;; ...\n???", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, words string")
    labels = spark.createDataFrame([(i, int(bool(i % 4))) for i in range(0, 800, 5)], "doc_id bigint, natural_text int")
    common = spark.createDataFrame([("fr", w) for w in COMMON] + [("fr", None)], "lang string, word string")
    found = {r["doc_id"] for r in no_prose(docs, common, labels).collect()}
    assert 900 in found
    expected = {i for i in range(800) if i % 4 == 0} | {900}
    assert len(found ^ expected) <= 6
    typed = text_types(docs, common, labels)
    assert {r["text_type"] for r in typed.where("doc_id >= 1000").collect()} == {None}
    assert no_prose(docs.where("false"), common, labels).collect() == []
    assert text_statistics(docs, common.where("false")).where("common_share > 0").count() == 0
    text_types(docs, common, labels.where("false")).collect()
    told = voter_accuracies(docs, common, labels)
    assert told.count() == len(VOTERS) * 20 and voter_accuracies(docs.where("false"), common, labels).count() == 0
    sums = {(r["voter"], r["text_type"]): r["s"] for r in told.groupBy("voter", "text_type").agg({"share": "sum"}).withColumnRenamed("sum(share)", "s").collect()}
    assert all(abs(x - 1) < 1e-6 for x in sums.values())


def test_very_long_texts_have_statistics():
    found = statistics(["mot long. " * 500_001, "x" * 5_000_000], np.zeros(0, np.uint64))
    assert found["words"].tolist() == [1_000_002, 1] and found["mean_word_length"].tolist() == [3.5, 5_000_000]


def test_learning_keeps_clear_patterns_apart():
    patterns = np.array([[2] * len(VOTERS), [2] * 3 + [0] + [2] * (len(VOTERS) - 4), [4] * len(VOTERS)])
    model = learn(patterns, np.array([900.0, 12.0, 100.0]))
    p = model.posterior(patterns)[:, 0]
    assert p[0] > 0.9 and p[1] < 0.5 and p[2] < 0.5
    assert set(thresholds([])) == set(VOTERS)


def test_only_equal_lines_are_repeated():
    draw = random.Random(3)
    lines = [f"{''.join(draw.choice('abcdefgh') for _ in range(12))} suite" for _ in range(3000)]
    assert len(set(lines)) == 3000
    texts = ["\n".join(lines), "ab c\nba c\ncb a", "***\n---\n+++", "Page 1 / 20\nautre\npage  12 / 20", "même\nMEME", "seul", "seul"]
    shares = statistics(texts, np.zeros(0, np.uint64))["line_repeat_share"]
    assert shares.tolist() == [0, 0, 0, 2 / 3, 1, 0, 0]
