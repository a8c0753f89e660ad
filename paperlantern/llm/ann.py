"""Approximate nearest neighbours: a hierarchical k-means tree, best bin first.

The tree is fitted on a bounded sample (``SAMPLE_ROWS`` vectors at most, chosen by a hash
of the id); every vector of the table is then put into the leaf at the end of its own
descent.  A query walks the tree with a priority queue of open nodes, nearest centre
first, and so meets the leaves in order.  How many leaves are visited is calibrated:
for ``CALIBRATION`` queries at most the true neighbours are found over all rows, and
visits are widened until ``TARGET`` of them lie in visited leaves.

Leaves of any size are split into blocks of about ``BLOCK_ROWS`` vectors, and queries
into blocks of ``BLOCK_QUERIES``; a task holds one block of each.  Nothing is capped: all
vectors of a visited leaf are compared.

Input: ``embeddings`` (vec_id, embedding).  A vector that is null, zero, or holds a null
or non-finite component takes no part; neither does a row without vec_id, nor one
whose length is not the most frequent one.  Rows of one vec_id count as one candidate,
with the nearest of them; as a query the smallest of them counts.  Ties go to the smaller
vec_id.  Fewer candidates than asked for are all returned; an empty table gives no
rows.  Other columns are not looked at.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlantern.llm.common import stored

NEIGHBOURS = 5
SAMPLE_ROWS = 20_000
BRANCHES = 8
LEAF_SAMPLE = 64
DEPTH = 5
CALIBRATION = 200
TARGET = 0.96
BLOCK_ROWS = 4096
BLOCK_QUERIES = 65_536
#: Scores that differ by less than this are computed again, all in the same way.
NEAR = 1e-9


@dataclass
class Tree:
    centres: np.ndarray  # one row per node; node 0 is the root
    children: list[list[int]] = field(default_factory=list)

    def leaves(self) -> list[int]:
        return [i for i, c in enumerate(self.children) if not c]

    def assign(self, unit: np.ndarray) -> np.ndarray:
        """Leaf of each unit vector: the nearest centre at every level."""
        at = np.zeros(len(unit), np.int64)
        todo = [(0, np.arange(len(unit)))]
        while todo:
            node, rows = todo.pop()
            below = self.children[node]
            if not below or not len(rows):
                at[rows] = node
                continue
            near = _distances(unit[rows], self.centres[below]).argmin(1)
            todo += [(child, rows[near == i]) for i, child in enumerate(below)]
        return at

    def best_bins(self, unit: np.ndarray, visits: int) -> list[int]:
        """Up to ``visits`` leaves of one query, in the order of a best-bin-first walk."""
        queue, found = [(0.0, 0)], []
        while queue and len(found) < visits:
            _, node = heapq.heappop(queue)
            below = self.children[node]
            if not below:
                found.append(node)
                continue
            for child, apart in zip(below, _distances(unit[None], self.centres[below])[0]):
                heapq.heappush(queue, (float(apart), child))
        return found


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None]


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    """Labels 0 … k-1 at most; an emptied centre is given up."""
    centres = x[rng.choice(len(x), k, replace=False)]
    label = None
    for _ in range(rounds):
        new = _distances(x, centres).argmin(1)
        if label is not None and (new == label).all():
            break
        used, label = np.unique(new, return_inverse=True)
        centres = np.stack([x[label == i].mean(0) for i in range(len(used))])
    return label


def fit_tree(unit: np.ndarray, seed: int = 17) -> Tree:
    rng = np.random.default_rng(seed)
    tree = Tree(np.empty((0, unit.shape[1])), [[]])
    centres = [unit.mean(0) if len(unit) else np.zeros(unit.shape[1])]
    todo = [(0, unit, 0)]
    while todo:
        node, x, depth = todo.pop()
        if len(x) <= LEAF_SAMPLE or depth == DEPTH:
            continue
        label = _kmeans(x, BRANCHES, rng)
        if label.max() == 0:
            continue
        for i in range(label.max() + 1):
            part = x[label == i]
            centres.append(part.mean(0))
            tree.children.append([])
            tree.children[node].append(len(centres) - 1)
            todo.append((len(centres) - 1, part, depth + 1))
    tree.centres = np.stack(centres)
    return tree


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Arrow lists of one length as rows of doubles."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), width)


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # keeps squares of extreme values in range
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, the largest entry near 1: no digit changes and no square leaves the range."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0.0))[1][:, None])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, each pair summed alike wherever it stands."""
    a, b = scaled(a), scaled(b)
    dot = (a * b).sum(1)
    return dot / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def nearest(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, cosine) of the ``k`` nearest rows of ``x`` for each query, its own id left out."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if not len(ids) or not len(q):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    x_unit = unit_rows(x)
    wide = k * int(np.unique(ids, return_counts=True)[1].max())  # rows of one id count once
    step = max(1, (1 << 22) // max(len(x), 1))
    for at in range(0, len(q), step):
        part = q[at : at + step]
        rough = unit_rows(part) @ x_unit.T
        rough[q_ids[at : at + step, None] == ids[None]] = -np.inf
        kth = np.partition(rough, len(ids) - wide, axis=1)[:, len(ids) - wide] if len(ids) > wide else np.full(len(part), -2.0)
        row, col = np.nonzero((rough >= np.maximum(kth, -2.0)[:, None] - NEAR) & np.isfinite(rough))
        score = cosines(part[row], x[col])
        order = np.lexsort((ids[col], -score, row))
        order = order[_first(row[order], ids[col[order]])]
        row, col, score = row[order], col[order], score[order]
        begin = np.searchsorted(row, np.arange(len(part)))
        best = np.arange(len(row)) - begin[row] < k
        found.append((q_ids[at + row[best]], ids[col[best]], score[best]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _first(query: np.ndarray, vec: np.ndarray) -> np.ndarray:
    """Positions of the first row of each (query, vec), in order."""
    order = np.lexsort((np.arange(len(vec)), vec, query))
    new = np.append(True, (query[order][1:] != query[order][:-1]) | (vec[order][1:] != vec[order][:-1]))
    return np.sort(order[new[: len(order)]])


_FOUND = "query_id long, vec_id long, score double"


def _found(q: np.ndarray, v: np.ndarray, s: np.ndarray) -> pa.Table:
    return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, embedding) of the vectors that take part, and their length (0: there are none)."""
    e = F.col("embedding")
    sound = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf)) & F.exists(e, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0))
    rows = rows.where(sound)
    usual = rows.groupBy(F.size(e).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    width = usual[0].n if usual else 0
    return rows.where(F.size(e) == width), width


def sample_tree(rows: DataFrame, width: int) -> Tree:
    """Fitted on the driver, on the documented sample."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).toArrow()
    return fit_tree(unit_rows(matrix(sample["embedding"].combine_chunks(), width)) if sample.num_rows else np.empty((0, width)))


def true_neighbours(rows: DataFrame, queries: DataFrame, width: int, k: int = NEIGHBOURS, most: int = CALIBRATION) -> DataFrame:
    """(query_id, vec_id, score) by comparing at most ``most`` queries with every row."""
    asked = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).toArrow()
    q_ids, q = asked["vec_id"].to_numpy(), matrix(asked["embedding"].combine_chunks(), width)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        for batch in batches:
            new = nearest(q_ids, q, batch["vec_id"].to_numpy(), matrix(batch["embedding"], width), k)
            query, vec, score = (np.concatenate(x) for x in zip(held, new))
            order = np.lexsort((vec, -score, query))
            order = order[_first(query[order], vec[order])]
            query, vec, score = query[order], vec[order], score[order]
            best = np.arange(len(query)) - np.searchsorted(query, query) < k
            held = query[best], vec[best], score[best]
        yield from _found(*held).to_batches()

    return _top(rows.select("vec_id", "embedding").mapInArrow(compare, _FOUND), k)


def _top(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def visits_for(tree: Tree, rows: DataFrame, queries: DataFrame, width: int, target: float = TARGET) -> int:
    """Leaves to visit so that ``target`` of the true neighbours are met."""
    truth = true_neighbours(rows, queries, width).select("query_id", "vec_id")
    q = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"))
    v = rows.select("vec_id", F.col("embedding").alias("near"))
    pairs = F.broadcast(truth).join(v, "vec_id").join(q, "query_id").toArrow()  # CALIBRATION * NEIGHBOURS rows at most
    if not pairs.num_rows:
        return 1
    asked, near = (unit_rows(matrix(pairs[c].combine_chunks(), width)) for c in ("asked", "near"))
    home = tree.assign(near)
    walks: dict[bytes, dict[int, int]] = {}
    needed = []
    for a, leaf in zip(asked, home):
        key = a.tobytes()
        if key not in walks:
            walks[key] = {node: i for i, node in enumerate(tree.best_bins(a, len(tree.children)), 1)}
        needed.append(walks[key][int(leaf)])
    needed.sort()
    return needed[math.ceil(target * len(needed)) - 1]


def search(vectors: DataFrame, is_query: Column, k: int = NEIGHBOURS, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every query row."""
    spark = vectors.sparkSession
    rows, width = usable(vectors)
    if not width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = stored(rows.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "ann-queries")
    tree = sample_tree(rows, width)
    visits = visits_for(tree, rows, queries, width, target)
    shared = spark.sparkContext.broadcast(tree)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value.children), np.int64)
        for batch in batches:
            total += np.bincount(shared.value.assign(unit_rows(matrix(batch["embedding"], width))), minlength=len(total))
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], ["leaf", "n"])

    counted = rows.select("embedding").mapInArrow(leaves, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect()
    blocks = {r.leaf: -(-r.n // BLOCK_ROWS) for r in counted}  # one entry per leaf of the tree
    asked_blocks = -(-queries.count() // BLOCK_QUERIES)
    cell = "leaf long, block long, part long, vec_id long, embedding array<double>"

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch["vec_id"].to_numpy(), matrix(batch["embedding"], width)
            leaf = shared.value.assign(unit_rows(x))
            block = np.abs(ids * 0x9E3779B1 >> 7) % np.array([blocks[int(i)] for i in leaf])
            yield from _cells(leaf, block, np.arange(len(ids)), ids, x, asked_blocks)

    def walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch["vec_id"].to_numpy(), matrix(batch["embedding"], width)
            for at in range(0, len(ids), 256):
                goals = [(i, leaf, b) for i, u in enumerate(unit_rows(x[at : at + 256]), at) for leaf in shared.value.best_bins(u, visits) for b in range(blocks.get(leaf, 0))]
                if goals:
                    i, leaf, block = (np.array(g, np.int64) for g in zip(*goals))
                    yield _cell(leaf, block, np.abs(ids[i] * 0x85EBCA6B >> 7) % asked_blocks, ids[i], x[i])

    def compare(asked: pa.Table, there: pa.Table) -> pa.Table:
        if not asked.num_rows or not there.num_rows:
            return _found(*(np.empty(0),) * 3)
        q, x = (matrix(t["embedding"].combine_chunks(), width) for t in (asked, there))
        return _found(*nearest(asked["vec_id"].to_numpy(), q, there["vec_id"].to_numpy(), x, k))

    keys = ("leaf", "block", "part")
    there = rows.mapInArrow(homes, cell).groupBy(*keys)
    asked = queries.mapInArrow(walks, cell).groupBy(*keys)
    return _top(asked.cogroup(there).applyInArrow(compare, _FOUND), k)


def _cell(leaf: np.ndarray, block: np.ndarray, part: np.ndarray, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(block), pa.array(part), pa.array(ids), lists], ["leaf", "block", "part", "vec_id", "embedding"])


def _cells(leaf, block, i, ids, x, parts) -> Iterator[pa.RecordBatch]:
    """Once for each block of queries."""
    for part in range(parts):
        yield _cell(leaf, block, np.full(len(i), part), ids, x)


def every_fiftieth(vectors: DataFrame) -> DataFrame:
    """The registered search: rows whose id is divisible by 50, against all rows."""
    return search(vectors, F.col("vec_id") % 50 == 0)
