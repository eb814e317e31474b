"""Bloom filters over keys as tables of bitmap pages, which say of most new keys that no store can have them.

A key belongs to one page of 4 KB and sets HASHES bits of it, so a lookup is one equi-join by page and eight bit tests, all
on the JVM. Keys are made distinct and dealt by page before any bitmap is built: a task then holds one bitmap at a time, and
only whole pages leave it. Pages of several filters of the same size are merged by OR. A filter never denies a key that it
was given; at KEYS_A_PAGE keys to a page it admits about one new key in 7,000, and more as pages fill beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap of Spark's bitmap functions, and bits that a key sets.
PAGE_BITS, HASHES = 32_768, 8
#: Twenty bits to a key.
KEYS_A_PAGE = PAGE_BITS // 20


def pages_for(n_keys: int) -> int:
    """Pages at which a filter of so many keys errs as stated above."""
    return max(1, -(-n_keys // KEYS_A_PAGE))


def page_of(key: Column, n_pages: int) -> Column:
    """The page of a key; null for a null key."""
    return F.when(key.isNotNull(), F.pmod(F.xxhash64(F.lit("page"), key), F.lit(n_pages)))


def _positions(key: Column) -> list[Column]:
    h = F.xxhash64(F.lit("bits"), key)
    start, step = F.pmod(h, F.lit(PAGE_BITS)), F.shiftrightunsigned(h, 20).bitwiseOR(F.lit(1))
    return [F.pmod(start + F.lit(i) * step, F.lit(PAGE_BITS)) for i in range(HASHES)]


def bloom(keys: DataFrame, key: str, n_pages: int) -> DataFrame:
    """(page, bits) of the keys; null keys are left out, and pages that no key sets have no row."""
    rows = keys.select(F.col(key).alias("key")).where(F.col("key").isNotNull()).distinct()
    rows = rows.select(page_of(F.col("key"), n_pages).alias("page"), F.array(*_positions(F.col("key"))).alias("positions")).repartition("page")
    return rows.select("page", F.explode("positions").alias("position")).groupBy("page").agg(F.bitmap_construct_agg("position").alias("bits"))


def merged(filters: DataFrame) -> DataFrame:
    """(page, bits) of filters with the same number of pages: what any of them was given."""
    return filters.groupBy("page").agg(F.bitmap_or_agg("bits").alias("bits"))


def fill(filters: DataFrame) -> DataFrame:
    """(n_pages, mean_fill, max_fill, false_share): pages with a bit, the share of their bits that is set, and how many new keys pass."""
    full = F.bitmap_count("bits") / F.lit(PAGE_BITS)
    return filters.agg(F.count("*").alias("n_pages"), F.avg(full).alias("mean_fill"), F.max(full).alias("max_fill"), F.avg(F.pow(full, F.lit(HASHES))).alias("false_share"))


def with_maybe(rows: DataFrame, key: str, filters: DataFrame, n_pages: int, name: str) -> DataFrame:
    """The rows with a boolean ``name``: false where no filter was given the row's key. A null key was given to none."""
    page, bits = f"{name}_page", f"{name}_bits"
    met = rows.withColumn(page, page_of(F.col(key), n_pages)).join(filters.select(F.col("page").alias(page), F.col("bits").alias(bits)), page, "left")
    maybe = F.col(bits).isNotNull()
    for at in _positions(F.col(key)):
        byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        maybe = maybe & (byte.bitwiseAND(F.pow(F.lit(2), F.pmod(at, F.lit(8))).cast("int")) != 0)
    return met.withColumn(name, F.coalesce(maybe, F.lit(False))).drop(page, bits)


def absent(rows: DataFrame, known: DataFrame, key: str, n_pages: int) -> DataFrame:
    """The rows whose key isn't among the known ones, as by an anti-join, which only rows that the filter admits go through.

    Rows and columns stay as they are; rows with a null key are kept. It pays where most rows are new and wide.
    """
    maybe = "maybe"
    while maybe in rows.columns:
        maybe = f"_{maybe}"
    marked = with_maybe(rows, key, bloom(known, key, n_pages), n_pages, maybe)
    doubtful = marked.where(F.col(maybe)).join(known.select(key).distinct(), key, "left_anti")
    return marked.where(~F.col(maybe)).unionByName(doubtful).select(*rows.columns)
