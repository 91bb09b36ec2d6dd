"""Most similar vectors of every sparse vector: a forest of random-projection trees and exact reranking.

A node of a tree holds a bundle of sparse random directions, one along each
dimension, of random length; a vector goes to the direction on which its
projection is largest, of those not taken or passed over above. Rare dimensions
get longer directions, as they part the collection more finely. A node splits
while it holds too many vectors: level by level, the vectors of all nodes are
counted, so the depth follows the count. Where vectors leave by the same
directions to the end, nodes split at the median of a dense random projection,
fitted on a sample and, below that, in the tasks.

A search walks all trees at once: nodes wait in one queue, ordered by how much
the projections fall short of the largest on the way, and the first leaves of
the whole forest are visited. At every node on the way, the next best branch is
put into the queue. A visit carries the directions it has used up, so that a leaf
that a task splits further takes it where a vector indexed there went. Candidates
of a leaf are ranked by their exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from centime.llm.batches import spread, whole_runs
from centime.llm.words import mix
from centime.session import durable

TREES = 6
#: Leaves visited for a vector over the whole forest, its own leaf in each tree among them.
VISITS = 9
#: Indexed vectors of a leaf at most.
LEAF = 192
#: Branchings by direction before median splits begin; directions of a vector that are looked at.
DEPTH, WIDTH = 4, 7
#: Vectors of a dimension that a direction may hold before it gets shorter, at least.
TYPICAL = 80
#: Vectors that frequencies of dimensions and medians are fitted on, at most; vectors of the sample that a median takes at least.
SAMPLE, FEW = 20_000, 16
#: Nodes that split, at most about: the bound of what is sent to the tasks (8 to 16 bytes a node). From LEAF * NODES / TREES vectors on
#: (64 million), fitted leaves are larger than LEAF and are split further in the tasks.
NODES = 2_000_000
#: Spread of a dense projection of unit vectors; distances to a median count in this unit.
SPREAD = 0.29
#: Visits that one task takes, about.
VISITORS = 200_000
#: Vectors whose queues are worked off together, rows that are ranked together.
QUEUES, ROWS = 4096, 20_000


def _uniform(x: np.ndarray, seed: int) -> np.ndarray:
    return (mix(x.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(11)).astype(float) / 2**53


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit key of two."""
    return mix(a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64))


class Vectors:
    """Sparse vectors of unit length, their entries one after the other."""

    def __init__(self, payloads: list[bytes]):
        sizes = np.array([len(p) // 8 for p in payloads], np.int64)
        both = [np.frombuffer(p, np.uint8) for p in payloads]
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        # a payload is all its dimensions, then all its weights
        ids = [p[: len(p) // 2] for p in both]
        weights = [p[len(p) // 2 :] for p in both]
        self.dim = np.concatenate(ids).view(np.int32) if ids else np.empty(0, np.int32)
        self.weight = np.concatenate(weights).view(np.float32).astype(np.float64) if ids else np.empty(0)
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        norm = np.sqrt(np.bincount(self.row, self.weight**2, minlength=len(sizes)))
        self.weight = self.weight / norm[self.row]
        self.projected: dict[int, np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.first) - 1

    def branches(self, tree: int, rare: "Rarity") -> tuple[np.ndarray, np.ndarray]:
        """(dimension, shortfall) of the WIDTH directions with the largest projections, a row for each vector; -1 behind the last.

        Projections are compared as logarithms; the shortfall is that to the largest.
        """
        length = -np.log(_uniform(self.dim, tree + 1) + 1e-18)
        fall = np.log(length) - np.log(np.abs(self.weight)) + rare.log_of(self.dim)
        order = np.lexsort((self.dim, fall, self.row))
        width = WIDTH
        place = np.arange(len(order)) - np.repeat(self.first[:-1], np.diff(self.first))
        kept = place < width
        dims, falls = np.full((len(self), width), -1, np.int64), np.full((len(self), width), np.inf)
        dims[self.row[kept], place[kept]] = self.dim[order][kept]
        falls[self.row[kept], place[kept]] = fall[order][kept]
        return dims, falls - falls[:, :1]

    def projection(self, seed: int) -> np.ndarray:
        """On one dense random direction; kept, as many nodes of a level ask for it."""
        if seed not in self.projected:
            self.projected[seed] = np.bincount(self.row, self.weight * (_uniform(self.dim, 7919 + seed) - 0.5), minlength=len(self))
        return self.projected[seed]

    def cosines(self, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Cosines of some rows with those of them at the places others."""
        sizes = self.first[rows + 1] - self.first[rows]
        at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.first[rows], sizes)
        dims, column = np.unique(self.dim[at], return_inverse=True)
        dense = np.zeros((len(rows), len(dims)))
        dense[np.repeat(np.arange(len(rows)), sizes), column] = self.weight[at]
        return dense @ dense[others].T


class Rarity:
    """How frequent dimensions are, from a sample of count of total vectors; dimensions outside it count as rarest.

    A dimension of up to TYPICAL vectors, or a thousandth of all, is not too
    frequent for a direction of full length: leaves are then not too small.
    """

    def __init__(self, dims: np.ndarray, count: int, total: int | None = None):
        total = max(1, count if total is None else total)
        self.dims, seen = np.unique(dims, return_counts=True)
        self.log = np.log(np.maximum(1.0, seen * (total / max(count, 1)) / max(TYPICAL, total / 1000)))

    def log_of(self, dims: np.ndarray) -> np.ndarray:
        if not len(self.dims):
            return np.zeros(len(dims))
        at = np.minimum(np.searchsorted(self.dims, dims), len(self.dims) - 1)
        return np.where(self.dims[at] == dims, self.log[at], 0.0)


def _is_in(values: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Whether values are among held ones, which are sorted."""
    if not len(held):
        return np.zeros(len(values), bool)
    return held[np.minimum(np.searchsorted(held, values), len(held) - 1)] == values


class Top:
    """The fitted part of the forest: which nodes split, and the medians of those that split by a dense projection.

    The root of tree t is node t. splits[l]: sorted keys of the nodes below l
    directions that split by direction (l from 1); medians[m]: sorted keys of nodes
    below m medians, and the medians.
    """

    def __init__(self, rare: Rarity):
        self.rare = rare
        self.splits: list[np.ndarray] = [np.arange(TREES, dtype=np.uint64)]
        self.medians: list[tuple[np.ndarray, np.ndarray]] = []

    def open_nodes(self, vectors: Vectors, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, nodes): the rows that come to a node below as many directions as there are levels, and which."""
        dims, _ = vectors.branches(tree, self.rare)
        rows, key = np.arange(len(vectors)), np.full(len(vectors), tree, np.uint64)
        for level, splits in enumerate(self.splits):
            kept = _is_in(key, splits)
            rows = rows[kept]
            key = _join(key[kept], dims[rows, level])
        return rows, key

    def fit_medians(self, vectors: Vectors, counts: dict[int, int], most: int) -> None:
        """Medians of nodes with so many vectors, from a sample."""
        parts = [self.open_nodes(vectors, tree) for tree in range(TREES)]
        row, key = (np.concatenate(x) for x in zip(*parts, strict=True))
        share = np.array([counts.get(int(k), 0) for k in key], np.float64)
        level = 0
        while True:
            nodes, which, n = np.unique(key, return_inverse=True, return_counts=True)
            size = np.zeros(len(nodes))
            size[which] = share
            split = (size > most) & (n >= FEW)
            go = split[which]
            row, key, which, share = row[go], key[go], which[go], share[go]
            if not len(row):
                return
            value = vectors.projection(level)[row]
            order = np.lexsort((value, which))
            first = np.searchsorted(which[order], np.flatnonzero(split))
            middle = np.zeros(len(nodes))
            middle[split] = value[order][first + n[split] // 2]
            self.medians.append((nodes[split], middle[split]))
            key, share, level = _join(key, (value >= middle[which]).astype(np.int64) + 1), share / 2, level + 1


def _fitted(classes: DataFrame, sample: list[bytes], count: int) -> Top:
    """The top of the forest: nodes of more than LEAF vectors split (see NODES)."""
    spark = classes.sparkSession
    vectors = Vectors(sample)
    top = Top(Rarity(vectors.dim, len(vectors), count))
    most = max(LEAF, TREES * count // NODES)
    counted: dict[int, int] = {}
    for level in range(1, DEPTH + 1):
        shared = spark.sparkContext.broadcast(top)
        nodes = classes.select("vector").mapInArrow(_counted(shared), "node bigint, n bigint").groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") > most).toArrow()
        key, n = nodes.column(0).to_numpy().view(np.uint64), nodes.column(1).to_numpy()
        if not len(key):
            break
        if level < DEPTH:
            top.splits.append(np.sort(key))
        else:
            counted = dict(zip(key.tolist(), n.tolist(), strict=True))
    top.fit_medians(vectors, counted, most)
    return top


def _counted(shared: Broadcast):
    """(node, n): vectors of each batch below the nodes that are not fitted yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = Vectors(batch.column(0).to_pylist())
                keys = np.concatenate([shared.value.open_nodes(vectors, tree)[1] for tree in range(TREES)])
                node, n = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(n)], ["node", "n"])

    return run


def _searched(top: Top, vectors: Vectors) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, leaf, tree, used, own) of the visits of each vector, one visit of all vectors after the other.

    used: bits of the directions, by rank, that were taken or passed over.
    """
    count = len(vectors)
    both = [vectors.branches(tree, top.rare) for tree in range(TREES)]
    dims, falls = np.stack([d for d, _ in both]), np.stack([f for _, f in both])
    room = TREES + VISITS * (DEPTH + len(top.medians))
    short = np.full((count, room), np.inf)
    node = np.zeros((count, room), np.uint64)
    level, used, root = (np.zeros((count, room), np.int16) for _ in range(3))
    # all roots come first
    short[:, :TREES] = np.arange(TREES) - TREES - 1.0
    node[:, :TREES] = root[:, :TREES] = np.arange(TREES)
    held = np.full(count, TREES)

    def push(row: np.ndarray, *entry: np.ndarray) -> None:
        at = held[row]
        for table, value in zip((short, node, level, used, root), entry, strict=True):
            table[row, at] = value
        held[row] += 1

    for visit in range(VISITS):
        at = np.argmin(short, axis=1)
        row = np.flatnonzero(np.isfinite(short[np.arange(count), at]))
        at = at[row]
        far = np.maximum(short[row, at], 0.0)
        short[row, at] = np.inf
        key, deep, gone, tree = node[row, at], level[row, at], used[row, at].astype(np.int64), root[row, at].astype(np.int64)
        for depth, splits in enumerate(top.splits):
            here = np.flatnonzero(deep == depth)
            here = here[_is_in(key[here], splits)]
            free = (gone[here, None] >> np.arange(WIDTH)) & 1 == 0
            best = np.argmax(free, axis=1)
            free[np.arange(len(here)), best] = False
            second = np.argmax(free, axis=1)
            dim, fall = dims[tree[here], row[here]], falls[tree[here], row[here]]
            every = np.arange(len(here))
            some = free.any(axis=1) & (dim[every, second] >= 0)
            other = here[some]
            gap = fall[every, second][some] - fall[every, best][some]
            passed = gone[other] | 1 << best[some] | 1 << second[some]
            push(row[other], far[other] + gap, _join(key[other], dim[every, second][some]), np.full(len(other), depth + 1), passed, tree[other])
            key[here] = _join(key[here], dim[every, best])
            gone[here] |= 1 << best
            deep[here] += 1
        for depth, (nodes, middles) in enumerate(top.medians):
            here = np.flatnonzero(deep == len(top.splits) + depth)
            here = here[_is_in(key[here], nodes)]
            away = vectors.projection(depth)[row[here]] - middles[np.searchsorted(nodes, key[here])]
            side = (away >= 0).astype(np.int64)
            push(row[here], far[here] + np.abs(away) / SPREAD, _join(key[here], 2 - side), np.full(len(here), len(top.splits) + depth + 1), gone[here], tree[here])
            key[here] = _join(key[here], side + 1)
            deep[here] += 1
        yield row, key, tree, gone, np.full(len(row), visit < TREES)


VISIT = "leaf bigint, tree tinyint, used smallint, own boolean, seq bigint, vector binary"
VISIT_NAMES = ["leaf", "tree", "used", "own", "seq", "vector"]


def _visits(top: Top):
    """Every vector to the leaves it visits; own: it is indexed there, else it only searches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, QUEUES):
                batch = whole.slice(at, QUEUES)
                vectors = Vectors(batch.column(1).to_pylist())
                for row, leaf, tree, used, own in _searched(top, vectors):
                    if len(row):
                        place = pa.array(row)
                        columns = [leaf.view(np.int64), tree.astype(np.int8), used.astype(np.int16), own]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), batch.column(0).take(place), batch.column(1).take(place)], VISIT_NAMES)

    return run


def _paths(dims: np.ndarray, used: np.ndarray) -> np.ndarray:
    """The directions of each row that are left, in order, and -1 behind the last."""
    gone = (used[:, None] >> np.arange(WIDTH)) & 1
    order = np.argsort(gone, axis=1, kind="stable")
    return np.where(np.take_along_axis(gone, order, axis=1) == 0, np.take_along_axis(dims, order, axis=1), -1)


def _groups(vectors: Vectors, rows: np.ndarray, own: np.ndarray, path: np.ndarray, level: int = 0) -> Iterator[np.ndarray]:
    """Rows of one fitted leaf split further until at most LEAF of them are indexed: by the directions left to them, then at medians."""
    if int(own[rows].sum()) <= LEAF:
        yield rows
        return
    if level < DEPTH:
        values = path[rows, level]
        order = np.argsort(values, kind="stable")
        edges = np.flatnonzero(np.diff(values[order])) + 1
        for part in np.split(rows[order], edges):
            yield from _groups(vectors, part, own, path, level + 1)
        return
    value = vectors.projection(100 + level)[rows]
    order = np.argsort(value, kind="stable")
    # as many indexed rows on either side; visitors go by their value
    half = int(np.searchsorted(np.cumsum(own[rows][order]), int(own[rows].sum()) // 2)) + 1
    yield from _groups(vectors, rows[order[:half]], own, path, level + 1)
    yield from _groups(vectors, rows[order[half:]], own, path, level + 1)


def _ranked(rare: Rarity, k: int, least: float):
    """Exact cosines within each leaf; of every vector the k best indexed ones."""

    def rank(leaf: np.ndarray, tree: np.ndarray, used: np.ndarray, own: np.ndarray, seq: np.ndarray, payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]]))
        ends = np.append(starts[1:], len(leaf))
        # a leaf where nothing is indexed, or just the one searching vector, has no candidates
        several = (ends - starts > 1) & np.logical_or.reduceat(own, starts)
        chosen = np.concatenate([np.empty(0, np.int64), *(np.arange(a, b) for a, b in zip(starts[several], ends[several], strict=True))])
        if not len(chosen):
            return
        tree, used, own, seq, leaf = tree[chosen], used[chosen], own[chosen], seq[chosen], leaf[chosen]
        vectors = Vectors([payloads[i] for i in chosen])
        starts = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]]))
        ends = np.append(starts[1:], len(leaf))
        a_out, b_out, c_out = [], [], []
        for begin, end in zip(starts.tolist(), ends.tolist(), strict=True):
            part, offset = vectors, 0
            path = np.empty((0, 0), np.int64)
            if int(own[begin:end].sum()) > LEAF:
                part, offset = Vectors([payloads[i] for i in chosen[begin:end]]), begin
                path = _paths(part.branches(int(tree[begin]), rare)[0], used[begin:end].astype(np.int64))
            for rows in _groups(part, np.arange(begin - offset, end - offset), own[offset:], path):
                here = rows + offset
                indexed = np.flatnonzero(own[here])
                if len(rows) < 2 or not len(indexed):
                    continue
                cosine = part.cosines(rows, indexed)
                near = here[indexed]
                cosine[seq[here][:, None] == seq[near][None, :]] = -2
                i, j = np.nonzero(cosine >= least)
                if not len(i):
                    continue
                c = np.round(cosine[i, j], 12)
                order = np.lexsort((seq[near[j]], -c, i))
                i, j, c = i[order], j[order], c[order]
                first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
                kept = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i)))) < k
                a_out.append(seq[here[i[kept]]])
                b_out.append(seq[near[j[kept]]])
                c_out.append(c[kept])
        if a_out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a_out, b_out, c_out)], ["seq", "near", "cosine"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_runs(batches, ROWS):
            leaf, tree, used, own, seq = (part.column(i).to_numpy() for i in range(5))
            yield from rank(leaf, tree, used, own, seq, part.column(5).to_pylist())

    return run


def packed(df: DataFrame, key: str, ids: str, weights: str) -> DataFrame:
    """(seq, vector): a vector as binary, its dimensions in order and then their weights; zero weights left out.

    Null, empty and all-zero vectors have no row. Of ids and weights of unequal
    length the shorter counts; null entries and weights that are no finite number
    are left out; weights of a repeated dimension add up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), sizes)
            dim = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            weight = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float32)
            good = np.isfinite(weight) & (weight != 0)
            if dim.dtype.kind == "f":
                good &= np.isfinite(dim)
            row, dim, weight = row[good], dim[good].astype(np.int32), weight[good]
            order = np.lexsort((dim, row))
            row, dim, weight = row[order], dim[order], weight[order]
            new = np.concatenate([[True], (row[1:] != row[:-1]) | (dim[1:] != dim[:-1])]) if len(row) else np.zeros(0, bool)
            if not new.all():
                weight = np.add.reduceat(weight, np.flatnonzero(new))
                row, dim = row[new], dim[new]
                row, dim, weight = row[weight != 0], dim[weight != 0], weight[weight != 0]
            first = np.searchsorted(row, np.arange(batch.num_rows + 1))
            vectors = [dim[a:b].tobytes() + weight[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            kept = [i for i, v in enumerate(vectors) if v]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), pa.array([vectors[i] for i in kept], pa.binary())], ["seq", "vector"])

    size = F.least(F.size(ids), F.size(weights))
    read = df.where((F.size(ids) > 0) & (F.size(weights) > 0) & F.col(key).isNotNull())
    read = read.select(F.col(key).cast("bigint").alias("seq"), F.slice(ids, 1, size).alias("ids"), F.slice(weights, 1, size).cast("array<float>").alias("weights"))
    return read.mapInArrow(run, "seq bigint, vector binary")


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest distinct ones of each seq: by cosine, equal ones by key."""
    once = edges.repartition("seq").groupBy("seq", "near").agg(F.max("cosine").alias("cosine"))
    listed = once.groupBy("seq").agg(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("minus"), "near"))).alias("all"))
    return listed.select("seq", F.explode(F.slice("all", 1, k)).alias("one")).select("seq", F.col("one.near").alias("near"), (-F.col("one.minus")).alias("cosine"))


def neighbours(df: DataFrame, k: int = 5, least: float = -1.0, key: str = "seq", ids: str = "sparse_ids", weights: str = "sparse_weights") -> DataFrame:
    """(seq, near, cosine): for every vector the k most similar others found, cosine at least `least`.

    Ties go to the smaller key. Every vector is indexed; recall is bounded by the
    visits (see README). Equal vectors are one class: the search runs over classes,
    and a class's rows get each other first. Null, empty and zero vectors have no
    row and are nobody's neighbour. A row that is there twice under one key counts
    once. An empty table gives no rows.
    """
    spark = df.sparkSession
    vectors = durable(packed(df, key, ids, weights).withColumn("class", F.xxhash64("vector")).withColumn("check", F.crc32("vector")), "vectors")
    classes = durable(vectors.groupBy("vector").agg(F.min("seq").alias("seq"), F.max("seq").alias("other")), "classes")
    count = classes.count()
    # rows of least hash; a first cut by hash keeps what the tasks send to about the size of the sample
    draw = F.pmod(F.xxhash64("seq"), F.lit(1 << 31))
    share = min(1.0, 1.2 * SAMPLE / max(1, count))
    sample = classes.where(draw < int(share * (1 << 31))).orderBy(draw, "seq").select("vector").limit(SAMPLE)
    top = spark.sparkContext.broadcast(_fitted(classes, [bytes(r["vector"]) for r in sample.toLocalIterator()], count))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _visits(top.value)(batches)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _ranked(top.value.rare, k, least)(batches)

    visits = classes.select("seq", "vector").mapInArrow(visit, VISIT)
    edges = spread(visits, "leaf", VISITS * count // VISITORS).sortWithinPartitions("leaf").mapInArrow(search, "seq bigint, near bigint, cosine double")
    found = _best(edges, k)

    # rows of classes with more than one row; of each class its k + 1 smallest keys are enough for anybody's list
    copied = classes.where("other > seq").select(F.col("seq").alias("head"), F.xxhash64("vector").alias("class"), F.crc32("vector").alias("check"))
    salted = copied.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    members = vectors.select("seq", "class", "check", F.pmod(F.hash("seq"), F.lit(16)).alias("salt")).join(salted, ["class", "check", "salt"]).select("head", "seq").distinct()
    return _expanded(found, members, k)


def _expanded(found: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """Lists of classes turned into lists of rows: members (head, seq) has all rows of classes of several."""
    few = members.withColumn("nth", F.row_number().over(Window.partitionBy("head").orderBy("seq"))).where(F.col("nth") <= k + 1)
    lists = few.groupBy("head").agg(F.sort_array(F.collect_list("seq")).alias("rows"))
    # a neighbour class stands for its first k rows
    near = found.join(lists.withColumnRenamed("head", "near"), "near", "left")
    near = near.select("seq", "cosine", F.explode(F.coalesce(F.slice("rows", 1, k), F.array("near"))).alias("near"))
    # a class's own rows come first in each row's list; the class's list serves all of its rows
    whole = near.groupBy("seq").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("minus"), "near"))), 1, k).alias("all"))
    salt = F.pmod(F.hash("seq"), F.lit(16))
    spread = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    own = members.withColumn("salt", salt).join(spread, ["head", "salt"]).select("head", "seq", F.explode("rows").alias("near")).where("seq <> near")
    own = own.select("seq", "near", F.lit(1.0).alias("cosine"))
    heads = whole.select(F.col("seq").alias("head"), "all").join(lists, "head", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    copies = members.where("seq <> head").withColumn("salt", salt).join(heads, ["head", "salt"])
    alone = whole.unionByName(copies.select("seq", "all")).select("seq", F.explode("all").alias("one")).select("seq", F.col("one.near").alias("near"), (-F.col("one.minus")).alias("cosine"))
    return _best(alone.unionByName(own), k)


def similar_pairs(df: DataFrame, k: int = 5, least: float = 0.5) -> DataFrame:
    """(seq_a, seq_b): pairs of a cosine of at least `least` where one is among the k nearest of the other. Distinct, seq_a < seq_b."""
    found = neighbours(df, k, least)
    return found.select(F.least("seq", "near").alias("seq_a"), F.greatest("seq", "near").alias("seq_b")).distinct()
