"""Column expressions that turn judgment rows into numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SINGLETON = "__singleton__:"
JUDGMENTS = ("first", "second", "tie")


def settled(average: Column) -> Column:
    """Nine digits and no negative zero: averages of averages differ in their last digits with the order of summation."""
    return F.round(average, 9) + F.lit(0.0)


def cluster_key(document: str = "source_doc_id", item: str = "item_id") -> Column:
    """The source document, or the item alone where there is none."""
    return F.coalesce(F.nullif(F.col(document).cast("string"), F.lit("")), F.concat(F.lit(SINGLETON), F.col(item).cast("string")))


def one_of(values: Column, low: Column, high: Column, message: Column) -> Column:
    """``values``, or an error where its least and greatest differ."""
    return F.when(low == high, values).otherwise(F.raise_error(message))


def pair_of(a: str, b: str) -> Column:
    """Whether a row compares the two variants, in either order."""
    first, second = F.col("variant_first"), F.col("variant_second")
    return ((first == a) & (second == b)) | ((first == b) & (second == a))


def checked(value: Column) -> Column:
    """``value`` where the judgment is known, an error elsewhere."""
    known = F.col("judgment").isin(*JUDGMENTS)
    return F.when(known, value).otherwise(F.raise_error(F.concat(F.lit("a judgment must be first, second or tie, not "), F.coalesce("judgment", F.lit("null")))))


def prefers(variant: str) -> Column:
    """1 where the variant was preferred, 0 where the other was, 0.5 for ties."""
    won = F.when(F.col("variant_first") == variant, F.lit("first")).otherwise("second")
    return checked(F.when(F.col("judgment") == "tie", 0.5).when(F.col("judgment") == won, 1.0).otherwise(0.0))


def prefers_first() -> Column:
    return checked(F.when(F.col("judgment") == "tie", 0.5).when(F.col("judgment") == "first", 1.0).otherwise(0.0))


def prefers_longer() -> Column:
    """1 where the response with more tokens was preferred; null where they have as many."""
    longer = F.when(F.col("tokens_first") > F.col("tokens_second"), "first").when(F.col("tokens_first") < F.col("tokens_second"), "second")
    return checked(F.when(longer.isNotNull(), F.when(F.col("judgment") == "tie", 0.5).when(F.col("judgment") == longer, 1.0).otherwise(0.0)))
