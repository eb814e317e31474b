"""Judgments that arrive as files: each call once, and running estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quorum.functions import recode
from quorum.sources.store import append_new


def judgments(spark: SparkSession, folder: str, schema: StructType, form: str = "json", files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(form).load(folder)


def store_once(stream: DataFrame, path: str, checkpoint: str, key: str = "judge_call_id") -> StreamingQuery:
    """Appends each call that the store doesn't have; a batch that is run again adds nothing."""
    return stream.writeStream.foreachBatch(lambda rows, _: append_new(rows, path, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_win_rates(stream: DataFrame, variant: str, every: str = "1 hour", late: str = "1 day", time: str = "created_at", key: str = "judge_call_id") -> DataFrame:
    """(window, judge_model, n_calls, win_rate, tie_rate) by windows of event time; calls count once, late ones up to ``late``."""
    rows = stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key]).withColumn("y", recode.prefers(variant))
    return rows.groupBy(F.window(time, every), "judge_model").agg(F.count("*").alias("n_calls"), F.avg("y").alias("win_rate"), F.avg((F.col("judgment") == "tie").cast("double")).alias("tie_rate"))
