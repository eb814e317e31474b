"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quorum.sources.checkpoints import cut, shared_dir

#: A word is a run of characters that are neither a space nor one of the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows, and bytes beyond one row, that Python works on at a time.
PIECE_ROWS, PIECE_BYTES = 500, 4 << 20
#: A key with more rows than this is hot; the limit grows with the rows so that at most HOT_KEYS keys ever are.
HOT_ROWS, HOT_KEYS = 1_000, 10_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows as a table in the folder that all executors share, and its path, for ``removed`` once nothing reads it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table, or a model, from the shared folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def observed(rows: DataFrame, **what: Column) -> tuple[DataFrame, dict]:
    """The rows with their lineage cut, and aggregates of them, taken as they are written: no query more.

    Every query costs the driver memory, for its plans and for what it sends with each stage, whatever the rows.
    """
    seen = Observation()
    rows = cut(rows.observe(seen, *[c.alias(name) for name, c in what.items()]))
    return rows, seen.get


def unused(df: DataFrame, name: str) -> str:
    """The name, or one made from it that no column of the rows has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _runs(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of rows of these sizes, each within PIECE_ROWS and, beyond one row, PIECE_BYTES."""
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        reach = int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PIECE_BYTES, side="right"))
        end = min(max(reach, first + 1), first + PIECE_ROWS)
        yield first, end
        first = end


def _sizes(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def text_udf(returns: str, make: Callable[[], Callable[[list[str | None]], pa.Array]]) -> Callable[..., Column]:
    """A column function over texts: a task calls ``make`` once and the result on lists of bounded rows and bytes.

    Arrow's batches hold up to ten thousand rows; they stay in Arrow's memory and become Python objects by pieces.
    """

    @F.arrow_udf(returns)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = make()
        for batch in batches:
            parts = [of(batch.slice(first, end - first).to_pylist()) for first, end in _runs(_sizes(batch))]
            yield pa.concat_arrays(parts) if parts else of([])

    return run


def frames(batches: Iterator[pa.RecordBatch], large: str | None = None) -> Iterator[pd.DataFrame]:
    """The rows of Arrow batches as frames of bounded rows and, by the column that holds most, bytes."""
    for batch in batches:
        sizes = np.ones(batch.num_rows, np.int64) if large is None else _sizes(batch.column(large))
        for first, end in _runs(sizes):
            yield batch.slice(first, end - first).to_pandas()


def lookup(rows: DataFrame, known: DataFrame, key: str, n: str = "n") -> DataFrame:
    """The rows joined with ``known``, which has one row for each key and how many rows (``n``, left out) have that key.

    Hot keys, of which there are HOT_KEYS at most, are joined by broadcast, so that their rows stay where they are;
    the others by a shuffle.
    """
    known, seen = observed(known, total=F.coalesce(F.sum(n), F.lit(0)), most=F.coalesce(F.max(n), F.lit(0)))
    limit = max(HOT_ROWS, seen["total"] // HOT_KEYS)
    if seen["most"] <= limit:
        return rows.join(known.drop(n), key)
    hot, cold = known.where(F.col(n) > limit).drop(n), known.where(F.col(n) <= limit).drop(n)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and leaves every other letter alone."""
    return F.translate(c, UPPER, UPPER.lower())


def word_count(c: Column) -> Column:
    """The number of words; null has none."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def text_crc(doc_id: Column) -> Column:
    """crc32 of an id written as text, which deals rows into fixed folds; that of a null id is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0))
