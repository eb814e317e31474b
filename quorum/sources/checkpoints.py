"""Lineage cut in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder: ``spark.checkpoint.dir``, or the one that the context was given.

    Only where neither is set, a session without executors takes a temporary folder, and a cluster one in its warehouse;
    a cluster whose warehouse is a folder of each machine is an error that names the setting.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        own = spark.conf.get("spark.checkpoint.dir", None)
        if own is None and context.master.startswith("local") and not context.master.startswith("local-cluster"):
            own = tempfile.mkdtemp(prefix="quorum-")
        if own is None:
            warehouse = spark.conf.get("spark.sql.warehouse.dir")
            path = context._jvm.org.apache.hadoop.fs.Path(warehouse)
            if path.getFileSystem(context._jsc.hadoopConfiguration()).getScheme() == "file":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            own = f"{warehouse}/checkpoints"
        context.setCheckpointDir(own)
    return context.getCheckpointDir()


def cut(rows: DataFrame) -> DataFrame:
    """The same rows with their lineage cut: computed once, read again by whatever follows.

    A session with ``spark.cleaner.referenceTracking.cleanCheckpoints`` deletes them once nothing refers to them.
    """
    shared_dir(rows.sparkSession)
    return rows.checkpoint()
