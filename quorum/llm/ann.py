"""Approximate nearest neighbours by 2-stable projections and kd-trees.

Vectors are projected to M dimensions by Gaussian rows, under which the squared projected distance over the squared
true one follows a chi-square law with M degrees of freedom. Candidates are dealt into blocks of about
vectors.BLOCK_ROWS rows; each block has a kd-tree over its projected vectors. A query visits the leaves of every block's tree by their
distance, in runs that double in length. Of the rows of a run, and of no others, it takes the projected distances; those
that are near enough are verified by their true distance, in single precision first, with a margin for its error, then in
double precision. It stops when the next leaf is so far that, by the chi-square test, a point nearer than its K-th best
would be there with a probability below MISS: rows of leaves that are never visited are never touched.

The blocks' answers are merged for each query. Queries are a stated subset of the rows (about one in a hundred); every
part of them meets every block in a cell (``vectors.cells``), of which a task holds one at a time.

Defined cases: vectors that are null or zero, or hold a null or a component that is not finite, take no part; vectors
of other lengths than a query's are no candidates for it; a row without an id takes no part; of rows that repeat an id the first by
vector counts; ties go to the smaller id; a query with fewer candidates than K gets all of them; an empty table gives
no rows; further columns of the input are left aside.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorum.llm.vectors import by_length, cells, finite, walk

K, M, MISS, SEED = 10, 6, 0.01, 11
LEAF_ROWS = 64
_RESULT = "query_id long, vec_id long, score double"


def chi_square_quantile(p: float, m: int) -> float:
    """The value that a chi-square variable with m (even) degrees of freedom stays below with probability p."""

    def below(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))

    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


class Tree:
    """A kd-tree over the projections of one block: leaves, which are runs of its rows, with their bounds."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.rows = rng.standard_normal((vectors.shape[1], M))
        points = vectors @ self.rows
        leaves, parts = [], [np.arange(len(ids))]
        while parts:
            part = parts.pop()
            if len(part) <= LEAF_ROWS:
                leaves.append(part)
                continue
            own = points[part]
            order = np.argpartition(own[:, np.ptp(own, axis=0).argmax()], len(part) // 2)
            parts += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
        placed = np.concatenate(leaves)
        self.ids, self.vectors, self.points = ids[placed], vectors[placed], points[placed]
        self.ends = np.cumsum([len(x) for x in leaves])
        self.starts = np.concatenate([[0], self.ends[:-1]])
        self.low, self.high = np.minimum.reduceat(self.points, self.starts), np.maximum.reduceat(self.points, self.starts)
        self.single = self.vectors.astype(np.float32)
        self.squares = (self.vectors**2).sum(axis=1)
        self.visited = 0  # rows of the leaves that queries came to

    def _members(self, leaves: np.ndarray) -> np.ndarray:
        """The rows of some leaves."""
        lengths = self.ends[leaves] - self.starts[leaves]
        first = np.cumsum(lengths) - lengths
        return np.arange(lengths.sum()) + np.repeat(self.starts[leaves] - first, lengths)

    def nearest(self, query_id: int, query: np.ndarray, stop: float) -> tuple[np.ndarray, np.ndarray]:
        """(distances, ids) of the K nearest that the search finds, nearest first, ties by id."""
        point, square = query @ self.rows, float(query @ query)
        single = query.astype(np.float32)
        near = (np.maximum(np.maximum(self.low - point, point - self.high), 0) ** 2).sum(axis=1)
        order = np.argsort(near, kind="stable")
        kept, ids = np.zeros(0), np.zeros(0, np.int64)
        best, first, length = np.inf, 0, 1
        while first < len(order):
            reach = best * stop * (1 + 1e-9) + 1e-12
            run = order[first : first + length]
            run = run[near[run] <= reach]
            if not len(run):
                break
            at = self._members(run)
            self.visited += len(at)
            at = at[((self.points[at] - point) ** 2).sum(axis=1) <= reach]
            at = at[self.ids[at] != query_id]
            rough = self.squares[at] - 2 * (self.single[at] @ single).astype(np.float64) + square
            at = at[rough - 1e-5 * (self.squares[at] + square) <= best]
            exact = np.cumsum((self.vectors[at] - query) ** 2, axis=1)[:, -1]  # summed in the order of the components
            kept, ids = np.concatenate([kept, exact]), np.concatenate([ids, self.ids[at]])
            top = np.lexsort((ids, kept))[:K]
            kept, ids = kept[top], ids[top]
            best = kept[-1] if len(kept) == K else np.inf
            first, length = first + length, 2 * length
        return np.sqrt(kept), ids


def _trees(table: pa.Table) -> dict[int, Tree]:
    """A tree for each length of vectors; rows come by id and, within an id, by vector."""
    ids = table.column("vec_id").to_numpy()
    first = np.concatenate([[True], ids[1:] != ids[:-1]])
    return {length: Tree(ids[at[first[at]]], vectors[first[at]]) for length, (at, vectors) in by_length(table.column("vector")).items() if first[at].any()}


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stop = chi_square_quantile(1 - MISS, M)

    def ask(trees: dict[int, Tree], piece: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, out = piece.column("vec_id").to_pylist(), []
        for length, (at, vectors) in by_length(piece.column("vector")).items():
            if length in trees:
                out += [(ids[k], *trees[length].nearest(ids[k], vector, stop)) for k, vector in zip(at.tolist(), vectors)]
        if not out:
            return None
        counts = [len(found) for _, _, found in out]
        return pa.record_batch([pa.array(np.repeat([q for q, _, _ in out], counts), pa.int64()), pa.array(np.concatenate([found for _, _, found in out]), pa.int64()), pa.array(np.concatenate([d for _, d, _ in out]), pa.float64())], ["query_id", "vec_id", "score"])

    return walk(batches, _trees, ask)


def nearest_neighbours(embeddings: DataFrame, is_query: Column) -> DataFrame:
    """(query_id, rank, vec_id, score) of the K nearest rows of each row that ``is_query`` takes, by Euclidean distance."""
    vector = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"), is_query.alias("asked"))
    rows = rows.where(F.col("vec_id").isNotNull() & finite(F.col("vector")) & F.exists("vector", lambda x: x != 0))
    counts = rows.agg(F.count("*").alias("n"), F.count_if("asked").alias("asked")).first()
    candidates = rows.select("vec_id", "vector")
    queries = rows.where("asked").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    found = cells(candidates, queries, "vec_id", counts["n"], counts["asked"]).mapInArrow(_search, _RESULT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= K).select("query_id", "rank", "vec_id", "score")
