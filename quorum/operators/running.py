"""Running sums over series of any length, in two levels, so that no task holds a series; joins by keys that may be null."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def earlier_sums(rows: DataFrame, by: Sequence[str], buckets: Sequence[str], order: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """The rows with, for each name in ``sums``, the sum of its column over all earlier rows of the same ``by``.

    Rows are ordered by ``buckets``, then ``order``. A bucket's total is a partial aggregate; only totals, one row a bucket,
    are summed up in the buckets' order, and rows are summed up within their bucket. Keys must not be null.
    """
    by, buckets = list(by), list(buckets)
    totals = rows.groupBy(*by, *buckets).agg(*[F.sum(c).alias(f"_{name}_before") for name, c in sums.items()])
    before = Window.partitionBy(*by).orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, *buckets, *[F.coalesce(F.sum(f"_{name}_before").over(before), F.lit(0)).alias(f"_{name}_before") for name in sums])
    within = Window.partitionBy(*by, *buckets).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({name: F.coalesce(F.sum(c).over(within), F.lit(0)) for name, c in sums.items()})
    rows = rows.join(offsets, [*by, *buckets])
    return rows.withColumns({name: F.col(name) + F.col(f"_{name}_before") for name in sums}).drop(*[f"_{name}_before" for name in sums])


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Left rows with the right's other columns; null keys are equal, and without keys the right side has one row at most."""
    if not keys:
        return left.join(F.broadcast(right), how=None if how == "inner" else how, on=None if how == "inner" else F.lit(True))
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(renamed, on, how).drop(*[f"_right_{k}" for k in keys])
