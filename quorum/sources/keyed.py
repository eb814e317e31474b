"""A store of rows by key that isn't read whole to tell what it has.

Rows lie in folders by bucket, a range of pages of a Bloom filter that is kept beside them. A lookup meets the filter first,
and only folders of buckets that may hold one of the keys are read. An append writes the filter's new bits before its rows:
if it is lost in between, the filter admits keys that aren't there, which costs a look and loses nothing. One writer at a
time appends; readers need no lock. The filter's size is set at creation, and ``fill`` tells when a larger store is due.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quorum.operators import membership

BUCKET = "_bucket"
_MAYBE = "_maybe"
_FILTER = "page bigint, bits binary"


@dataclass(frozen=True)
class KeyedStore:
    """Where the store is, what its rows are, and into how many buckets, of how many pages each, its keys are dealt."""

    path: str
    schema: StructType
    key: str
    n_buckets: int
    bucket_pages: int

    @property
    def n_pages(self) -> int:
        return self.n_buckets * self.bucket_pages

    def bucket(self) -> Column:
        return F.floor(membership.page_of(F.col(self.key), self.n_pages) / self.bucket_pages).cast("int")

    def rows(self, spark: SparkSession, buckets: list[int] | None = None) -> DataFrame:
        """The stored rows, of these buckets only if given: folders of others aren't read."""
        schema = StructType([*self.schema.fields, StructField(BUCKET, IntegerType())])
        rows = spark.read.schema(schema).parquet(f"{self.path}/rows")
        return rows if buckets is None else rows.where(F.col(BUCKET).isin(buckets))

    def filters(self, spark: SparkSession) -> DataFrame:
        return membership.merged(spark.read.schema(_FILTER).parquet(f"{self.path}/filters"))


def create(spark: SparkSession, path: str, schema: StructType, key: str, expected_keys: int, n_buckets: int = 256) -> KeyedStore:
    """An empty store for about so many keys; a folder that exists is an error."""
    if key not in schema.names or {BUCKET, _MAYBE} & set(schema.names):
        raise ValueError(f"the rows need the key {key!r} and must not have columns {BUCKET!r} or {_MAYBE!r}")
    store = KeyedStore(path.rstrip("/"), schema, key, n_buckets, -(-membership.pages_for(expected_keys) // n_buckets))
    about = [(schema.json(), key, n_buckets, store.bucket_pages)]
    spark.createDataFrame(about, "schema string, key string, n_buckets int, bucket_pages int").write.json(f"{store.path}/about")
    spark.createDataFrame([], _FILTER).write.parquet(f"{store.path}/filters")
    spark.createDataFrame([], StructType([*schema.fields, StructField(BUCKET, IntegerType())])).write.partitionBy(BUCKET).parquet(f"{store.path}/rows")
    return store


def opened(spark: SparkSession, path: str) -> KeyedStore:
    """The store that was created there."""
    about = spark.read.json(f"{path.rstrip('/')}/about").first()
    return KeyedStore(path.rstrip("/"), StructType.fromJson(json.loads(about["schema"])), about["key"], about["n_buckets"], about["bucket_pages"])


def touched(tasks: DataFrame, store: KeyedStore) -> list[int]:
    """Buckets that may hold a key of the tasks: numbers below ``n_buckets``, however many tasks there are."""
    spark = tasks.sparkSession
    marked = membership.with_maybe(tasks.select(store.key), store.key, store.filters(spark), store.n_pages, _MAYBE)
    return sorted(r[0] for r in marked.where(F.col(_MAYBE)).select(store.bucket()).distinct().collect())


def pending(tasks: DataFrame, store: KeyedStore) -> DataFrame:
    """Tasks whose key the store doesn't have, as by an anti-join with all of it; rows with a null key are pending."""
    spark = tasks.sparkSession
    known = store.rows(spark, touched(tasks, store)).select(store.key)
    marked = membership.with_maybe(tasks, store.key, store.filters(spark), store.n_pages, _MAYBE)
    doubtful = marked.where(F.col(_MAYBE)).join(known, store.key, "left_anti")
    return marked.where(~F.col(_MAYBE)).unionByName(doubtful).select(*tasks.columns)


def append_new(rows: DataFrame, store: KeyedStore) -> None:
    """Appends one row for each key that the store doesn't have, so that a rerun adds nothing; a null key is an error.

    The rows are read three times: what costs much to make, or isn't the same when made again, is written first.
    """
    names = store.schema.names
    if set(rows.columns) != set(names):
        raise ValueError(f"the store's columns are {', '.join(names)}")
    key = F.when(F.col(store.key).isNull(), F.raise_error(F.lit("a stored row needs a key"))).otherwise(F.col(store.key))
    rows = rows.select(*[(key if f.name == store.key else F.col(f.name)).cast(f.dataType).alias(f.name) for f in store.schema.fields])
    fresh = pending(rows, store).dropDuplicates([store.key]).withColumn(BUCKET, store.bucket())
    membership.bloom(rows, store.key, store.n_pages).write.mode("append").parquet(f"{store.path}/filters")
    fresh.repartition(BUCKET).write.mode("append").partitionBy(BUCKET).parquet(f"{store.path}/rows")


def compact_filters(spark: SparkSession, store: KeyedStore) -> None:
    """Writes the filters of all appends as one and then deletes theirs; lost in between, bits are there twice."""
    folder = f"{store.path}/filters"
    old = spark.read.schema(_FILTER).parquet(folder).inputFiles()
    store.filters(spark).write.mode("append").parquet(folder)
    paths = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in old]
    files = paths[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()) if paths else None
    for p in paths:
        files.delete(p, False)


def union(stores: list[KeyedStore], spark: SparkSession) -> DataFrame:
    """The filter of several stores of the same size: what any of them may hold."""
    if len({(s.n_buckets, s.bucket_pages) for s in stores}) != 1:
        raise ValueError("only filters of the same size can be merged")
    return membership.merged(reduce(DataFrame.unionByName, [s.filters(spark) for s in stores]))
