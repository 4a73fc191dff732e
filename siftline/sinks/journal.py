"""Rewriting files in batches with a journal: what was written is known after an interruption, and a rerun goes on there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from siftline.sinks.rows import write_back
from siftline.spec import SearchSpec

HEADER = "started_unix long, search_term string, replacement string, root string, regex boolean, batches int"
OUTCOME = "full_path string, failure string"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def journaled(changed: DataFrame, root: str, folder: str, spec: SearchSpec, replacement: str, batches: int = 16) -> DataFrame:
    """Writes (full_path, new_text, encoding) back in batches; returns (full_path, failure) of all.

    folder is shared and new for each operation.  The new texts are staged there first, by a hash of the path, so what is
    written does not depend on files that are rewritten already.  A batch's outcomes are committed when it ends.  Called again
    on the same folder, staged texts and ended batches are kept; a batch that was cut off writes the same texts again.
    """
    spark = changed.sparkSession
    if _read(spark, f"{folder}/header", HEADER) is None:
        staged = changed.select("full_path", "new_text", "encoding", F.pmod(F.xxhash64("full_path"), F.lit(batches)).cast("int").alias("batch"))
        staged.write.mode("overwrite").partitionBy("batch").parquet(f"{folder}/staged")
        head = spark.range(1).select(F.unix_timestamp().alias("started_unix"), F.lit(spec.term).alias("search_term"), F.lit(replacement).alias("replacement"), F.lit(root).alias("root"), F.lit(spec.regex).alias("regex"), F.lit(batches).alias("batches"))
        head.coalesce(1).write.mode("overwrite").json(f"{folder}/header")
    batches = _read(spark, f"{folder}/header", HEADER).first()["batches"]
    staged = spark.read.schema("full_path string, new_text string, encoding string, batch int").parquet(f"{folder}/staged")
    for k in range(batches):
        if _read(spark, f"{folder}/outcomes/{k}/_SUCCESS", OUTCOME) is None:
            write_back(staged.where(F.col("batch") == k), root).write.mode("overwrite").json(f"{folder}/outcomes/{k}", ignoreNullFields=False)
    spark.range(1).coalesce(1).write.mode("overwrite").json(f"{folder}/finished")
    return outcomes(spark, folder)


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """(full_path, failure) of the batches that have ended."""
    got = _read(spark, f"{folder}/outcomes/*", OUTCOME)
    return got if got is not None else spark.createDataFrame([], OUTCOME)


def residual(spark: SparkSession, folder: str) -> DataFrame | None:
    """The journal of an operation that was cut off: its header with the files modified and failed; None without any.

    One row for each file, or one row without a file where no batch has ended.  A corrupt journal is an error.
    """
    head = _read(spark, f"{folder}/header", HEADER)
    if head is None or _read(spark, f"{folder}/finished", "id long") is not None:
        return None
    files = outcomes(spark, folder).select("full_path", F.when(F.col("failure").isNull(), "modified").otherwise("failed").alias("status"), "failure")
    return F.broadcast(head).join(files, F.lit(True), "left")
