"""The folder that all of Spark's machines share, and what the session is set to."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch that goes to a Python worker, unless a single row is longer.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> SparkSession:
    """The session, whose Arrow batches are bounded by bytes and not by rows alone: what a Python function over whole texts
    holds doesn't grow with the table."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one where that is unset and all of Spark is on this machine."""
    have = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if have is None and (not master.startswith("local") or master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return have or tempfile.mkdtemp(prefix="siftline-")
