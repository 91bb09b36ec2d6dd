from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from centime.llm import signatures
from centime.llm.batches import spread
from centime.llm.components import components
from centime.llm.signatures import Tree, duplicate_pairs, near_duplicates, texts_may_match
from centime.session import durable


def triples(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def brute(texts):
    up = {k: k for k in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = {k: triples(t) for k, t in texts.items()}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    groups = defaultdict(set)
    for k in texts:
        groups[find(k)].add(k)
    return {k: root for root, g in groups.items() if len(g) > 1 for k in g}


def edited(draw, words, times):
    words = list(words)
    for _ in range(times):
        words[draw.randrange(len(words))] = f"mot{draw.randrange(10**6)}"
    return " ".join(words)


def corpus(seed, families, copies, edits=4):
    draw, texts, key = random.Random(seed), {}, 1
    for _ in range(families):
        base = [f"w{draw.randrange(300)}" for _ in range(draw.randrange(30, 120))]
        for _ in range(copies):
            texts[key] = edited(draw, base, draw.randrange(edits))
            key += 1
    return texts


@pytest.mark.parametrize("copies", [1, 4])
def test_groups_against_brute_force(spark, copies):
    texts = {**corpus(1, 40, copies), 900: None, 901: "", 902: "deux mots", 903: "un deux trois", 904: "Un, DEUX. trois!"}
    df = spark.createDataFrame([(k, t, "clash") for k, t in texts.items()] + [(903, "un deux trois", "again")], "seq bigint, text string, group string")
    got = {r["seq"]: r["group"] for r in near_duplicates(df).collect()}
    expected = brute({k: t for k, t in texts.items() if k < 900})
    assert got == {**expected, 903: 903, 904: 903}
    assert near_duplicates(df.where("false")).collect() == []


@pytest.mark.parametrize("split", [100_000, 40])
def test_crowded_tokens_find_the_same(spark, split):
    # nearly all candidates wait until groups are known; with a small split, tokens go in chunks and units of two sides
    texts = corpus(2, 3, 120, edits=8)
    df = spark.createDataFrame(list(texts.items()), "seq bigint, text string")
    assert {r["seq"]: r["group"] for r in near_duplicates(df, plenty=0, several=0, split=split).collect()} == brute(texts)
    assert {r["seq"]: r["group"] for r in near_duplicates(df, split=split).collect()} == brute(texts)


@pytest.mark.parametrize("known", [False, True])
def test_tree_drops_only_what_cannot_match(known):
    draw = np.random.default_rng(4)
    base = draw.random((12, signatures.BITS)) < 0.2
    bits = np.repeat(base, 15, axis=0) ^ (draw.random((180, signatures.BITS)) < 0.02)
    bitmap = np.ascontiguousarray(np.packbits(bits, axis=1)).view(np.uint64)
    size = bits.sum(axis=1) + draw.integers(0, 5, 180)
    group = np.repeat(np.arange(12), 15) if known else np.full(180, -1)
    row = np.concatenate([np.arange(180), np.arange(0, 180, 3), np.arange(50)])
    token, rest = np.repeat([7, 3, 9], [180, 60, 50]), np.concatenate([size, size[::3] * 3 // 4, size[:50]])
    a, b = np.triu_indices(len(row), 1)
    kept = (token[a] == token[b]) & (np.minimum(rest[a], rest[b]) >= 0.375 * (size[row[a]] + size[row[b]]))
    kept &= texts_may_match(bitmap, size, row[a], row[b], 0.6) & ((group[row[a]] != group[row[b]]) | (group[row[a]] < 0))
    expected = {(x, y) for x, y in zip(a[kept].tolist(), b[kept].tolist(), strict=True)}
    tree = Tree(token, row, rest, size, bitmap, group)
    found = [tuple(sorted(x)) for p, q in tree.pairs(0.6) for x in zip(tree.order[p].tolist(), tree.order[q].tolist(), strict=True)]
    assert len(found) == len(set(found)) and set(found) == expected
    assert tree.found.sum() == len(expected) and (known or expected)


def test_runs_stay_whole():
    import pyarrow as pa

    keys = [[1, 1, 2], [], [2, 2, 3], [3], [4, 5, 5]]
    batches = [pa.RecordBatch.from_arrays([pa.array(k, pa.int64())], ["k"]) for k in keys]
    assert [t.column(0).to_pylist() for t in signatures.whole_runs(iter(batches), 1)] == [[1, 1], [2, 2, 2], [3, 3], [4], [5, 5]]
    assert [t.column(0).to_pylist() for t in signatures.whole_runs(iter(batches), 4)] == [[1, 1, 2, 2, 2], [3, 3, 4, 5, 5]]


def test_only_named_passages_count(spark):
    rows = [(1, "a", "un deux trois quatre"), (2, "b", "un deux trois quatre."), (3, "c", "Un deux trois quatre")]
    passages = spark.createDataFrame(rows, "seq bigint, id string, text string")
    occurrences = spark.createDataFrame([("x", "a"), ("y", "c"), ("z", None), ("z", "unknown"), ("x", "a")], "id string, passage_id string")
    assert [tuple(r) for r in duplicate_pairs(passages, occurrences).collect()] == [(1, 3)]


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (5, 4)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def test_no_pair_just_above_the_threshold_is_missed(spark):
    # 700 pairs of 40 triples each, of which they share 30: likeness 0.6 exactly; 4 of 96 hashes, 56 ways, miss some of so many
    rows = []
    for k in range(700):
        shared, (a, b) = [f"s{k}x{i}" for i in range(32)], [[f"{side}{k}x{i}" for i in range(10)] for side in "ab"]
        rows += [(2 * k, " ".join(shared + a)), (2 * k + 1, " ".join(shared + b))]
    sets = {k: triples(t) for k, t in rows}
    assert all(len(sets[k] & sets[k + 1]) == 30 and len(sets[k] | sets[k + 1]) == 50 for k in range(0, 1400, 2))
    df = spark.createDataFrame(rows, "seq bigint, text string")
    assert {r["seq"]: r["group"] for r in near_duplicates(df).collect()} == {k: k - k % 2 for k in range(1400)}


@pytest.mark.parametrize("threshold", [0.5, 0.6, 0.85])
def test_similar_sets_share_a_first_token_with_enough_left(threshold):
    draw = np.random.default_rng(7)
    known = np.sort(draw.choice(400, 60, replace=False)).astype(np.uint64)
    frequent = known, draw.integers(1, 9, 60).astype(np.uint64)
    sets = [np.sort(draw.choice(400, n, replace=False)).astype(np.uint64) for n in draw.integers(1, 60, 60)]
    sets += [np.unique(np.concatenate([s[: draw.integers(len(s) // 2, len(s) + 1)], draw.choice(400, draw.integers(1, 25)).astype(np.uint64)])) for s in sets for _ in range(4)]
    sizes = np.array([len(s) for s in sets])
    token, owner, rest = signatures.first_tokens(np.concatenate(sets), sizes, frequent, threshold)
    held = [{t: r for t, r in zip(token[owner == i].tolist(), rest[owner == i].tolist(), strict=True)} for i in range(len(sets))]
    similar = 0
    for i in range(len(sets)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if common >= threshold * (sizes[i] + sizes[j] - common) - 1e-9:
                similar += 1
                assert any(min(held[i][t], held[j][t]) >= common for t in held[i].keys() & held[j].keys())
    assert similar > 5


def test_very_long_texts(spark):
    draw = random.Random(9)
    base = [f"m{draw.randrange(10**6)}" for _ in range(650_000)]
    changed = [*base[:1000], "autre", *base[1001:]]
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(changed)), (3, "x" * 5_000_000)], "seq bigint, text string")
    assert len(" ".join(base)) > 1 << 22
    assert {r["seq"]: r["group"] for r in near_duplicates(df).collect()} == {1: 1, 2: 1}


def test_many_parts_are_walked_in_rounds(spark, monkeypatch):
    # with a part for nearly each entry, a text goes to as many parts as it has first triples: all at once took over 3 times the input on disk
    texts, sent = corpus(3, 40, 3), []

    def counted(df, key, tasks):
        sent.append(df.count())
        return spread(df, key, tasks)

    monkeypatch.setattr(signatures, "ENTRIES", 20)
    monkeypatch.setattr(signatures, "spread", counted)
    df = spark.createDataFrame(list(texts.items()), "seq bigint, text string")
    assert {r["seq"]: r["group"] for r in near_duplicates(df).collect()} == brute(texts)
    assert max(sent) <= sum(sent) / 3


def test_long_texts_that_share_sentences_are_no_candidates(spark, monkeypatch):
    # 1,200 triples each, an eighth of them in common: in bitmaps of 768 bits nearly all bits are set, so each two were sent to be verified
    draw, counts = random.Random(5), {}
    sentences = [" ".join(f"m{draw.randrange(10**6)}" for _ in range(18)) for _ in range(500)]
    texts = {k: " ".join(draw.sample(sentences, 66)) for k in range(40)}
    for k in range(4):
        texts[40 + k] = " ".join(texts[k].split()[: 1200 - 130 * k])
        texts[50 + k] = edited(draw, texts[k].split(), 40)

    def noted(df, name="step"):
        kept = durable(df, name)
        counts[name] = kept.count()
        return kept

    monkeypatch.setattr(signatures, "durable", noted)
    df = spark.createDataFrame(list(texts.items()), "seq bigint, text string")
    expected = brute(texts)
    assert {r["seq"]: r["group"] for r in near_duplicates(df).collect()} == expected and len(expected) == 12
    assert counts["pairs"] <= 24


def test_bitmaps_of_several_widths_agree():
    import pyarrow as pa

    draw, step = np.random.default_rng(6), signatures.BITS
    sizes = np.array([100, step, 3 * step, 9 * step, 50, 2 * step])
    tokens = [draw.choice(1 << 40, n, replace=False) for n in sizes]
    widths = signatures.widened(sizes) * step
    assert set(widths // step) == {1, 2, 4}

    def bits(i, width):
        found = np.zeros(width, np.uint8)
        found[tokens[i] % width] = 1
        return np.packbits(found)

    narrow, wide = signatures._bitmaps(pa.chunked_array([pa.array([bits(i, w).tobytes() for i, w in enumerate(widths)], pa.binary())]))
    assert (narrow.view(np.uint8) == [bits(i, step) for i in range(6)]).all()
    for (place, found), width in zip(wide, (2 * step, 4 * step), strict=True):
        has = np.flatnonzero(widths >= width)
        assert np.flatnonzero(place >= 0).tolist() == has.tolist()
        assert (found[place[has]].view(np.uint8) == [bits(i, width) for i in has]).all()
