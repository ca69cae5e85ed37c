"""Nearest neighbours by largest inner product with a forest of random-projection trees.

Trees split at medians of random projections of a bounded sample; all vectors
are then sorted into their leaves. A query walks all trees with one shared
priority queue that always opens the branch with the smallest sum of squared
margins. It first looks into a few leaves, which tells how near its neighbours
are at least, and then goes on until the queue's margins make nearer ones
unlikely. The vectors of the opened leaves are ranked by exact inner products.

Inner products become distances by one more coordinate that gives all vectors
the same length. Copies of a vector are one entry with their smallest ids, as
many as a result can show, so that very many copies of one vector are no burden
and none is lost.

The sample is bounded by ``SAMPLE`` vectors; every vector is indexed. Measured
recall at 20 neighbours is in the README.

Defined results: vectors that are null, zero, hold null or non-finite numbers,
or have another length than most take no part, neither do rows without id;
repeated rows count once; with fewer candidates than asked for all are
returned; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from concord.session import cut_lineage

TREES = 3
LEAF = 512
SAMPLE = 32_768
#: Leaves opened before the second look, for each tree.
FIRST_LEAVES = 2
#: Where the queue stops: squared margins over what a neighbour at the distance found so far would have.
MARGIN = 1.5
STEP_ROWS = 8192
PACKED = "tree int, leaf int, ids binary, vectors binary, floors binary"


@dataclass(frozen=True)
class Tree:
    normal: np.ndarray
    threshold: np.ndarray
    child: np.ndarray  # (nodes, 2): a node, or -1 - leaf
    leaves: int

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int32)
        todo = [(0 if len(self.normal) else -1, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
                continue
            right = x[rows] @ self.normal[node] > self.threshold[node]
            todo += [(int(self.child[node, 0]), rows[~right]), (int(self.child[node, 1]), rows[right])]
        return out


@dataclass(frozen=True)
class Forest:
    trees: tuple[Tree, ...]
    length: float  # of all vectors with the additional coordinate

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.length**2 - (x**2).sum(axis=1), 0))
        return np.hstack([x, rest[:, None]])


def grow(sample: np.ndarray, length: float, count: int, trees: int = TREES, leaf: int = LEAF, seed: int = 7) -> Forest:
    """Trees with leaves for about ``leaf`` of ``count`` vectors, at least eight of the sample each."""
    forest = Forest((), length)
    x = forest.lifted(sample)
    least = max(8, int(leaf * len(x) / max(count, 1)))
    draw, grown = np.random.default_rng(seed), []
    for _ in range(trees):
        normal, threshold, child, leaves = [], [], [], 0
        todo = [(np.arange(len(x)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            w = draw.standard_normal(x.shape[1])
            w /= np.linalg.norm(w)
            p = x[rows] @ w
            cut = np.median(p) if len(p) else 0.0
            right = p > cut
            if len(rows) <= least or not right.any():
                me = -1 - leaves
                leaves += 1
            else:
                me = len(normal)
                normal.append(w)
                threshold.append(cut)
                child.append([0, 0])
                todo += [(rows[~right], me, 0), (rows[right], me, 1)]
            if parent >= 0:
                child[parent][side] = me
        grown.append(Tree(np.array(normal).reshape(-1, x.shape[1]), np.array(threshold),
                          np.array(child, dtype=np.int64).reshape(-1, 2), leaves))
    return Forest(tuple(grown), length)


def open_leaves(forest: Forest, query: np.ndarray, first: int | None, limit: float) -> Iterator[tuple[int, int]]:
    """(tree, leaf) in the order of the shared queue: ``first`` many, or all with margins up to ``limit``."""
    lifted = np.append(query, 0.0)
    margins = [t.normal @ lifted - t.threshold for t in forest.trees]
    queue = [(0.0, t, 0 if len(tree.normal) else -1) for t, tree in enumerate(forest.trees)]
    given = 0
    while queue:
        cost, t, node = heapq.heappop(queue)
        if cost > limit or (first is not None and given == first):
            return
        if node < 0:
            given += 1
            yield t, -1 - node
            continue
        m = margins[t][node]
        near = int(m > 0)
        child = forest.trees[t].child[node]
        heapq.heappush(queue, (cost, t, int(child[near])))
        heapq.heappush(queue, (cost + m * m, t, int(child[1 - near])))


def _valid(df: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.col(vector)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    out = df.where(F.col(key).isNotNull() & v.isNotNull() & sound).select(F.col(key).alias("id"), v.alias("v"))
    sizes = out.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return out.where(F.size("v") == (sizes[0][0] if sizes else 0)).distinct()


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _packed(where: list[tuple[int, int]], rows: list[list[int]], ids: np.ndarray, x: np.ndarray,
            floors: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([t for t, _ in where], pa.int32()), pa.array([n for _, n in where], pa.int32()),
        pa.array([ids[r].tobytes() for r in rows], pa.binary()), pa.array([x[r].tobytes() for r in rows], pa.binary()),
        pa.array([floors[r].tobytes() for r in rows], pa.binary())], names=["tree", "leaf", "ids", "vectors", "floors"])


def _in_leaves(entries: DataFrame, forest: Forest) -> DataFrame:
    """All vectors by (tree, leaf), many to a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP_ROWS):
                part = batch.slice(at, STEP_ROWS)
                ids, x = part["id"].to_numpy(), _matrix(part["v"])
                lifted, where, rows = forest.lifted(x.astype(float)), [], []
                for t, tree in enumerate(forest.trees):
                    leaf = tree.leaf_of(lifted)
                    order = np.argsort(leaf, kind="stable")
                    for group in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1):
                        where.append((t, int(leaf[group[0]])))
                        rows.append(group)
                yield _packed(where, rows, ids, x, np.zeros(len(ids)))

    return entries.select("id", "v").mapInArrow(run, PACKED)


def _to_leaves(queries: DataFrame, forest: Forest, first: int | None) -> DataFrame:
    """Queries by the leaves that they open. With ``first`` None their floors set how far they go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP_ROWS):
                part = batch.slice(at, STEP_ROWS)
                ids, x, floor = part["id"].to_numpy(), _matrix(part["v"]), part["floor"].to_numpy(zero_copy_only=False)
                wide = x.astype(float)
                # Squared distance to an entry with the inner product known so far.
                far = np.maximum((wide**2).sum(axis=1) + forest.length**2 - 2 * floor, 1e-9)
                limit = MARGIN * far / (x.shape[1] + 1) if first is None else np.full(len(ids), np.inf)
                held: dict[tuple[int, int], list[int]] = {}
                for i in range(len(ids)):
                    for place in open_leaves(forest, wide[i], first, limit[i]):
                        held.setdefault(place, []).append(i)
                yield _packed(list(held), list(held.values()), ids, x, floor)

    return queries.select("id", "v", "floor").mapInArrow(run, PACKED)


def _rank(queries: DataFrame, leaves: DataFrame, dim: int, kind: type, k: int) -> DataFrame:
    """(query, id, score): for each query and leaf its k + 1 best entries with at least the query's floor."""

    def unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        join = lambda name, of: np.frombuffer(b"".join(table[name].to_pylist()), dtype=of)
        return join("ids", np.int64), join("vectors", kind).reshape(-1, dim).astype(float), join("floors", np.float64)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query", "id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "id": pa.array([], pa.int64()),
                             "score": pa.array([], pa.float64())})
        q, x, floor = unpack(left)
        ids, y, _ = unpack(right)
        order = np.argsort(ids)
        ids, y = ids[order], y[order]
        out = []
        for at in range(0, len(q), 256):
            score = x[at:at + 256] @ y.T
            best = np.argsort(-score, axis=1, kind="stable")[:, :k + 1]
            s = np.take_along_axis(score, best, axis=1)
            row, col = np.nonzero(s >= floor[at:at + 256, None])
            out.append((q[at:at + 256][row], ids[best[row, col]], s[row, col]))
        return pa.table(dict(zip(names, (np.concatenate(c) for c in zip(*out)))))

    keys = ["tree", "leaf"]
    return queries.groupBy(*keys).cogroup(leaves.groupBy(*keys)).applyInArrow(meet, "query long, id long, score double")


def nearest(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20,
            trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest found of every row for which ``is_query`` (on ``key``) holds."""
    rows = cut_lineage(_valid(vectors, key, vector))
    smallest = W.partitionBy("v").orderBy("id")
    entries = rows.withColumn("r", F.row_number().over(smallest)).where(F.col("r") <= k + 1).groupBy("v").agg(
        F.sort_array(F.collect_list("id")).alias("ids")).select(F.element_at("ids", 1).alias("id"), "ids", "v")
    entries = cut_lineage(entries)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    count, length, dim = entries.agg(F.count("*"), F.max(norm), F.max(F.size("v"))).first()
    empty = "query_id long, rank int, id long, score double"
    if not count:
        return vectors.sparkSession.createDataFrame([], empty)
    kind = np.float32 if dict(rows.dtypes)["v"] == "array<float>" else np.float64
    rows = rows if kind is np.float32 else rows.withColumn("v", F.col("v").cast("array<double>"))
    entries = entries if kind is np.float32 else entries.withColumn("v", F.col("v").cast("array<double>"))
    # About three quarters of the bound, so that the limit hardly ever cuts.
    share = min(1.0, 0.75 * sample / count)
    picked = entries.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(sample)
    forest = grow(np.array([r[0] for r in picked.select("v").collect()], dtype=float), length, count, trees, leaf)

    leaves = _in_leaves(entries, forest)
    asked = rows.where(is_query).withColumn("floor", F.lit(float("-inf")))
    first = cut_lineage(_rank(_to_leaves(asked, forest, FIRST_LEAVES * trees), leaves, dim, kind, k)).distinct()
    top = W.partitionBy("query").orderBy(F.desc("score"), "id")
    floors = first.withColumn("r", F.row_number().over(top)).where(F.col("r") == k + 1).select(
        "query", F.col("score").alias("known"))
    # Without enough entries so far a query opens every leaf.
    again = asked.join(floors, asked["id"] == floors["query"], "left").select(
        "id", "v", F.coalesce("known", "floor").alias("floor"))
    found = first.union(_rank(_to_leaves(again, forest, None), leaves, dim, kind, k)).groupBy("query", "id").agg(
        F.max("score").alias("score"))
    best = found.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1)
    shown = best.join(entries.select("id", "ids"), "id").select("query", "score", F.explode("ids").alias("id")).where(
        "id <> query")
    return shown.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select(
        F.col("query").alias("query_id"), "rank", "id", "score")
