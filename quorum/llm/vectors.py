"""What operators on embeddings share: which vectors take part, integer components, and cells of candidates and queries.

A search compares every query with every candidate. Candidates are dealt into blocks and queries into parts, both by a hash
of their id; a block and a part meet in a cell, of which a task holds one at a time, so neither a block's queries nor all
candidates ever meet in one task, and equal vectors or a common label don't crowd a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorum.llm.common import PIECE_ROWS

BLOCK_ROWS, PART_ROWS = 8_192, 8_192
#: At most so many tasks; with more cells than that a task holds several, one after the other.
MOST_TASKS = 20_000
#: Integer components beyond this are an error: products of vectors of up to 127 of them fit 64 bits.
MOST = 1 << 27


def finite(vector: Column) -> Column:
    """Whether a vector is there and all of its components are, as finite numbers."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def integers(vector: Column, factor: int) -> Column:
    """floor(factor * x) of each component x, as double; components beyond MOST are an error."""

    def one(x: Column) -> Column:
        scaled = F.floor(x * F.lit(float(factor)))
        return F.when(F.abs(x) * factor < MOST, scaled).otherwise(F.raise_error(F.concat(F.lit("a component is too large for integer arithmetic: "), x.cast("string")))).cast("int")

    return F.transform(vector.cast("array<double>"), one)


def by_length(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length that vectors have: (their places, the vectors as a matrix)."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, starts = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths) - lengths
    out = {}
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        out[n] = at, flat[starts[at][:, None] + np.arange(n)]
    return out


def cells(candidates: DataFrame, queries: DataFrame, key: str, n_candidates: int, n_queries: int, block_rows: int | None = None, part_rows: int | None = None) -> DataFrame:
    """Candidates and queries, which have the same columns, by ``cell``; in a cell candidates (not ``asked``) come first, by all columns.

    Every block of candidates meets every part of the queries once.
    """
    blocks, parts = max(1, -(-n_candidates // (block_rows or BLOCK_ROWS))), max(1, -(-n_queries // (part_rows or PART_ROWS)))
    columns = candidates.columns
    dealt = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), F.col(key)), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    one = candidates.select(dealt("block", blocks).alias("block"), each(parts).alias("part"), F.lit(False).alias("asked"), *columns)
    other = queries.select(dealt("part", parts).alias("part"), each(blocks).alias("block"), F.lit(True).alias("asked"), *columns)
    both = one.unionByName(other).select((F.col("block") * parts + F.col("part")).cast("long").alias("cell"), "asked", *columns)
    tasks = min(blocks * parts, MOST_TASKS)
    return both.repartitionById(tasks, F.pmod("cell", F.lit(tasks)).cast("int")).sortWithinPartitions("cell", "asked", key, *columns)


def walk(batches: Iterator[pa.RecordBatch], build: Callable[[pa.Table], object], ask: Callable[[object, pa.RecordBatch], pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    """Over rows of cells: ``build`` gets the candidates of a cell, and ``ask`` what that made and the cell's queries, by pieces."""
    cell, parts, state = None, [], None
    for batch in batches:
        number, asked = batch.column("cell").to_numpy(), batch.column("asked").to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((np.diff(number) != 0) | (asked[1:] != asked[:-1])) + 1
        for first, end in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
            if first == end:
                continue
            if number[first] != cell:
                cell, parts, state = number[first], [], None
            if not asked[first]:
                parts.append(batch.slice(first, end - first))
                continue
            if parts:
                state, parts = build(pa.Table.from_batches(parts)), []
            for at in range(first, end, PIECE_ROWS):
                found = None if state is None else ask(state, batch.slice(at, min(PIECE_ROWS, end - at)))
                if found is not None and found.num_rows:
                    yield found
