"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch that goes to a Python worker, unless a single row is longer.
BATCH_BYTES = 8 << 20


def prepared(spark: SparkSession) -> SparkSession:
    """The session, with two settings that these operators rely on: Arrow batches are bounded by bytes and not by rows alone,
    and a step's shuffle files go when the step has ended, as every step is written before the next one reads it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one where that is unset and all of Spark is on this machine."""
    have = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if have is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        have = tempfile.mkdtemp(prefix="siftline-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(have)
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: later reads start from its files and not from its lineage."""
    return Scratch(df.sparkSession).write(df, name)


class Scratch:
    """Tables of an operator's steps in the shared folder; clear() empties them once nothing will read them again."""

    def __init__(self, spark: SparkSession):
        self.spark = prepared(spark)
        self.paths: list[str] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = os.path.join(checkpoint_root(self.spark), f"{name}-{uuid.uuid4().hex}")
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        while self.paths:
            self.spark.range(0, numPartitions=1).write.mode("overwrite").parquet(self.paths.pop())


def if_small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """df, a written table of narrow rows, to be broadcast if it has no more than so many; else joins shuffle it."""
    return F.broadcast(df) if df.count() <= rows else df


def parts_of(spark: SparkSession) -> int:
    """Into how many parts a keyed exchange of this session is dealt."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")
