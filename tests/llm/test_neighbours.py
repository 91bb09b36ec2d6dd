from __future__ import annotations

import numpy as np

from centime.llm import neighbours as neighbours_module
from centime.llm.neighbours import neighbours, similar_pairs

SCHEMA = "seq bigint, sparse_ids array<int>, sparse_weights array<float>, cosine string"


def family(seed, families, copies):
    draw, rows, key = np.random.default_rng(seed), [], 0
    for _ in range(families):
        ids, weights = draw.choice(50_000, 30, replace=False), draw.random(30) + 0.1
        for _ in range(copies):
            kept = draw.random(30) < 0.85
            order = draw.permutation(int(kept.sum()))
            noisy = weights * draw.uniform(0.8, 1.2, 30)
            rows.append((key, [int(x) for x in ids[kept][order]], [float(x) for x in noisy[kept][order]], "clash"))
            key += 1
    return rows


def brute(rows, k, least):
    vectors = {}
    for seq, ids, weights, _ in rows:
        v = dict(zip(ids, np.float32(weights).astype(float), strict=False))
        norm = sum(w * w for w in v.values()) ** 0.5
        if norm:
            vectors[seq] = {i: w / norm for i, w in v.items()}
    pairs = set()
    for a, v in vectors.items():
        near = sorted((-round(sum(w * u.get(i, 0) for i, w in v.items()), 12), b) for b, u in vectors.items() if a != b)[:k]
        pairs |= {(min(a, b), max(a, b)) for c, b in near if -c >= least}
    return pairs


def test_recall_against_brute_force(spark):
    rows = family(1, 80, 7)
    got = {tuple(r) for r in similar_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    expected = brute(rows, 5, 0.5)
    assert len(got & expected) >= 0.97 * len(expected) and len(got - expected) <= 0.03 * len(expected)


def test_odd_vectors_ties_and_copies(spark):
    rows = [(100 + i, [1, 2], [1.0, 2.0], None) for i in range(9)]  # equal vectors, more than k + 1
    rows += [(1, [1, 2], [1.0, 1.9], None), (2, None, None, None), (3, [], [], None), (4, [5], [0.0], None), (5, [7, 7], [1.0, 1.0], None), (6, [7], [4.0], None), (7, [9, 8], [float("nan"), 1.0], None)]
    df = spark.createDataFrame(rows + [rows[0]], SCHEMA)
    got = {}
    for r in neighbours(df, k=3, least=0.5).collect():
        got.setdefault(r["seq"], []).append((-r["cosine"], r["near"]))
    got = {s: [n for _, n in sorted(x)] for s, x in got.items()}
    assert got[100] == [101, 102, 103] and got[108] == [100, 101, 102] and got[101] == [100, 102, 103]
    assert got[1] == [100, 101, 102] and got[5] == [6] and got[6] == [5]
    assert not {2, 3, 4, 7} & set(got)
    assert neighbours(df.where("false")).collect() == []


def test_many_near_copies_split_at_medians(spark):
    draw = np.random.default_rng(3)
    rows = [(i, list(range(20)), [float(x) for x in 1 + draw.random(20) / 50], None) for i in range(400)]
    got = similar_pairs(spark.createDataFrame(rows, SCHEMA)).count()
    assert got >= 400  # every vector has found partners


def packed_rows(rows):
    ids = [np.argsort(r[1]) for r in rows]
    return neighbours_module.Vectors([np.array(r[1], np.int32)[o].tobytes() + np.array(r[2], np.float32)[o].tobytes() for r, o in zip(rows, ids, strict=True)])


def test_visitors_of_a_leaf_that_splits_meet_its_vectors(monkeypatch):
    # the top does not split below the roots, so all further splitting is the task's; visitors must go where the indexed ones went
    monkeypatch.setattr(neighbours_module, "LEAF", 6)
    draw = np.random.default_rng(8)
    rows = []
    for _ in range(300):
        ids, weights = draw.choice(60, 12, replace=False), draw.random(12) + 0.1
        rows += [(0, ids, weights * draw.uniform(0.8, 1.25, 12)) for _ in range(4)]
    vectors = packed_rows(rows)
    top = neighbours_module.Top(neighbours_module.Rarity(vectors.dim, len(vectors)))
    visits = [np.concatenate(x) for x in zip(*neighbours_module._searched(top, vectors), strict=True)]
    row, leaf, tree, used, own = visits
    assert own.sum() == 1200 * neighbours_module.TREES and (~own).sum() == 1200 * (neighbours_module.VISITS - neighbours_module.TREES)
    met = total = relatives = 0
    for key in np.unique(leaf):
        here = leaf == key
        part, mine, t = row[here], own[here], int(tree[here][0])
        path = neighbours_module._paths(vectors.branches(t, top.rare)[0][part], used[here])
        some = packed_rows([rows[i] for i in part])
        for group in neighbours_module._groups(some, np.arange(len(part)), mine, path):
            visitors, indexed = part[group][~mine[group]], part[group][mine[group]]
            if mine.sum() > 6:
                total += len(visitors)
                met += len(visitors) * bool(len(indexed))
                relatives += int(np.isin(visitors // 4, indexed // 4).sum())
    assert total > 500 and met > 0.25 * total and relatives > 0.02 * total


def test_queue_goes_by_shortfall():
    draw = np.random.default_rng(2)
    rows = [(0, draw.choice(500, 10, replace=False), draw.random(10) + 0.1) for _ in range(50)]
    vectors = packed_rows(rows)
    top = neighbours_module.Top(neighbours_module.Rarity(vectors.dim, len(vectors)))
    both = [vectors.branches(t, top.rare) for t in range(neighbours_module.TREES)]
    for visit, (row, leaf, tree, _, own) in enumerate(neighbours_module._searched(top, vectors)):
        if visit == neighbours_module.TREES:
            # the first visit beyond the own leaves: the tree whose second direction falls short by least
            gaps = np.stack([f[:, 1] for _, f in both])
            assert (tree == np.argmin(gaps, axis=0)[row]).all() and not own.any()
            second = np.stack([d[:, 1] for d, _ in both])[tree, row]
            assert (leaf == neighbours_module._join(tree, second)).all()


def test_nodes_are_counted_exactly(spark):
    rows = family(4, 60, 40)
    df = spark.createDataFrame(rows, SCHEMA)
    classes = neighbours_module.packed(df, "seq", "sparse_ids", "sparse_weights").repartition(5)
    payloads = [bytes(r["vector"]) for r in classes.collect()]
    top = neighbours_module._fitted(classes, payloads, 10**8)
    assert len(top.splits) == 1
    top = neighbours_module._fitted(classes, payloads, len(payloads))
    vectors = neighbours_module.Vectors(payloads)
    keys = np.concatenate([neighbours_module._join(np.full(len(vectors), t), vectors.branches(t, top.rare)[0][:, 0]) for t in range(neighbours_module.TREES)])
    values, counts = np.unique(keys, return_counts=True)
    expected = values[counts > neighbours_module.LEAF]
    assert (top.splits[1].tolist() if len(top.splits) > 1 else []) == expected.tolist()


def test_recall_of_a_small_collection_of_distant_neighbours(spark):
    # a few hundred vectors whose nearest have cosines of 0.5 to 0.7: leaves must not become too small
    draw = np.random.default_rng(6)
    centres = [(draw.choice(3000, 40, replace=False), draw.random(40) + 0.2) for _ in range(60)]
    rows = []
    for k in range(600):
        ids, weights = centres[k % 60]
        kept = draw.random(40) < 0.7
        other = draw.choice(np.arange(3000, 9000), 12, replace=False)
        rows.append((k, [*map(int, ids[kept]), *map(int, other)], [*map(float, weights[kept]), *map(float, draw.random(12) * 0.5 + 0.1)], None))
    got = {tuple(r) for r in similar_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    expected = brute(rows, 5, 0.5)
    assert len(got & expected) >= 0.95 * len(expected)
