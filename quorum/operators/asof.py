"""As-of joins: each row with the last earlier version of what is valid for its key.

Rows and versions are put in one order of key and time. Carrying the last version forward within a key would make a hot key
one task, so time is cut into slices: within a slice the last version is carried by a window, and what a slice begins with is
the last version of the slices before, found among one row for each slice that has a version. Slices are ranges of time that
the caller sizes; versions are rarely as many as rows, but nothing here depends on that, and nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(rows: DataFrame, versions: DataFrame, keys: Sequence[str], at: str, since: str, values: Sequence[str], slice_seconds: int = 86_400) -> DataFrame:
    """The rows with ``values`` of the version of their keys whose ``since`` is the latest that isn't after their ``at``.

    Null where no version was valid yet or the time is null. Null keys are keys like others. Of versions of the same key and
    time the one with the greatest values counts. Versions without a time are never valid.
    """
    keys, values = list(keys), list(values)
    if set(values) & set(rows.columns):
        raise ValueError(f"the rows have columns of the names {sorted(set(values) & set(rows.columns))} already")
    own = F.struct(*rows.columns).alias("_row")
    new = F.struct(*values)
    left = rows.select(*keys, F.col(at).cast("timestamp").alias("_at"), F.lit(1).alias("_side"), own, F.lit(None).cast(versions.select(new.alias("v")).schema["v"].dataType).alias("_new"))
    right = versions.where(F.col(since).isNotNull()).groupBy(*keys, F.col(since).cast("timestamp").alias("_at")).agg(F.max(new).alias("_new"))
    right = right.select(*keys, "_at", F.lit(0).alias("_side"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), "_new")
    both = left.unionByName(right).withColumn("_slice", F.floor(F.unix_micros("_at") / F.lit(slice_seconds * 1_000_000)))
    within = Window.partitionBy(*keys, "_slice").orderBy("_at", "_side")  # a version holds from its own time on
    both = both.withColumn("_new", F.last("_new", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    ends = right.withColumn("_slice", F.floor(F.unix_micros("_at") / F.lit(slice_seconds * 1_000_000))).groupBy(*keys, "_slice").agg(F.max_by("_new", "_at").alias("_last"))
    slices = both.where("_side = 1").select(*keys, "_slice").distinct().withColumn("_wanted", F.lit(True))
    carried = slices.unionByName(ends.withColumn("_wanted", F.lit(False)), allowMissingColumns=True)
    carried = carried.groupBy(*keys, "_slice").agg(F.max("_last").alias("_last"), F.bool_or("_wanted").alias("_wanted"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # a row a slice
    carried = carried.withColumn("_carried", F.last("_last", ignorenulls=True).over(before)).where("_wanted")
    carried = carried.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_slice").alias("_of_slice"), "_carried")
    on = F.col("_slice") == F.col("_of_slice")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    found = both.where("_side = 1").join(carried, on, "left").withColumn("_new", F.when(F.col("_at").isNotNull(), F.coalesce("_new", "_carried")))
    return found.select("_row.*", *[F.col(f"_new.{v}").alias(v) for v in values])
