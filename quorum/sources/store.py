"""Append-only stores of JSON lines or Parquet, and a cache of completions, as tables that jobs join with."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quorum.functions.ids import cache_key

_CORRUPT = "_corrupt_record"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): every line of text files with its number from 1 in its file, blank lines counted too.

    Lines are counted by split first, a pass that reads no more than line ends, and a split's lines go on from the sum over
    the splits before it; so a file of any length is read by many tasks, and only a row for each split meets in a window. A
    line's place within its split is its place in its task, less that of the split's first line; tasks read the same splits
    in both passes, as these follow from the files and settings alone.
    """
    split = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    lines = spark.read.text(path).select(*split, F.monotonically_increasing_id().alias("at"), "value")
    splits = lines.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    return lines.join(splits, ["file", "start"]).select("file", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line"), "value")


def _parsed(lines: DataFrame, schema: StructType) -> DataFrame:
    """The lines that aren't blank with their record; what is no JSON object of the schema's types is kept as corrupt."""
    whole = StructType([*schema.fields, StructField(_CORRUPT, StringType())])
    record = F.from_json("value", whole, {"columnNameOfCorruptRecord": _CORRUPT})
    return lines.where(F.trim("value") != "").withColumn("record", record)


def malformed_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """(file, line, value) of the lines that hold no record: all of them, where ``read_lines`` stops at one."""
    rows = _parsed(numbered_lines(spark, path), schema)
    return rows.where(F.col(f"record.{_CORRUPT}").isNotNull()).select("file", "line", "value")


def read_lines(spark: SparkSession, path: str, schema: StructType, numbered: bool = True) -> DataFrame:
    """The records of JSON lines; blank lines are skipped, a missing path is empty, and a malformed line is an error.

    The error names file, line and text. Counting lines reads the files once more; without ``numbered`` they are read once,
    and the error has the file and text only.
    """
    try:
        lines = numbered_lines(spark, path) if numbered else spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.lit(None).cast("long").alias("line"))
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise
    where = F.concat(F.coalesce(F.concat(F.lit("malformed line "), F.col("line")), F.lit("malformed line")), F.lit(" in "), F.col("file"))
    bad = F.concat(where, F.lit(": "), F.substring(F.col(f"record.{_CORRUPT}"), 1, 200))
    record = F.when(F.col(f"record.{_CORRUPT}").isNull(), F.col("record")).otherwise(F.raise_error(bad))
    return _parsed(lines, schema).withColumn("record", record).select(*[F.col("record")[f.name].alias(f.name) for f in schema.fields])


def append_new(rows: DataFrame, path: str, key: str, form: str = "parquet") -> None:
    """Appends the rows whose key the store doesn't have yet, so that a rerun adds nothing."""
    spark = rows.sparkSession
    try:
        known = spark.read.format(form).load(path).select(key).distinct()
        rows = rows.join(known, key, "left_anti")
    except AnalysisException as error:
        if not re.search("PATH_NOT_FOUND|UNABLE_TO_INFER_SCHEMA", error.getCondition() or ""):
            raise
    rows.dropDuplicates([key]).write.mode("append").format(form).save(path)


def written_keys(store: DataFrame, key: str) -> DataFrame:
    return store.select(key).distinct()


def with_cache_key(calls: DataFrame, name: str = "cache_key") -> DataFrame:
    """Adds the key of each call's completion from prompt, model, seed and params."""
    return calls.withColumn(name, cache_key(F.col("prompt"), F.col("model"), F.col("seed"), F.col("params")))


def write_csv(rows: DataFrame, path: str) -> None:
    """A result table as one CSV file with a header, for publication: the rows are a report's, not the data's."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
