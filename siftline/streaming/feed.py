"""Changes of record files as a stream, an index that follows them, and counters that report at most so often."""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from siftline.operators.catalog import fields_of, located

#: Fixed value: seconds between reports of counters.
COUNTERS_EVERY = 0.25
#: What an index has of a record; the batch and whether the record was gone are in its files' folders.
ROWS = "collection string, record string, modified timestamp, props string"


def changed_records(spark: SparkSession, root: str, files_at_once: int = 1000) -> DataFrame:
    """(collection, record, modified, props) of record files as they arrive.

    Hidden folders, views and schema files are left out.  The file source sees a path once, and neither that its file is
    edited nor that it is gone; swept() does.
    """
    fixed = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(fixed).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").option("maxFilesPerTrigger", files_at_once).load(root)
    return _rows(raw, root)


def _rows(files: DataFrame, root: str, *content: Column) -> DataFrame:
    """Record files as rows of an index; without their content, fields come from elsewhere."""
    name, record = located(F.regexp_replace("path", F.lit("^file:/*"), F.lit("/")), root)
    props = content[0] if content else fields_of(F.col("content").cast("string"))
    return files.select(name.alias("collection"), record.alias("record"), F.col("modificationTime").alias("modified"), props.alias("props")).where("collection IS NOT NULL")


def followed(changes: DataFrame, index: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Adds each batch of changes to the index; a batch that is run again replaces what it wrote.

    Without `every` it ends once all files that are there have been read; else it looks again so often, until stopped.
    """

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{index}/batch={number}/sweep=0/gone=false")

    when = {"availableNow": True} if every is None else {"processingTime": every}
    return changes.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**when).start()


def entries(spark: SparkSession, index: str) -> DataFrame:
    """The rows of an index with batch, sweep and gone: what was merged, and what came or went since."""
    file = F.col("_metadata.file_path")
    number = lambda name: F.regexp_extract(file, rf"/{name}=(\d+)/", 1).cast("long").alias(name)
    changes = spark.createDataFrame([], f"{ROWS}, batch long, sweep long, gone boolean")
    if _numbers(spark, index, "batch=*"):
        changes = spark.read.schema(ROWS).parquet(f"{index}/batch=*/sweep=*/gone=*").select("*", number("batch"), number("sweep"), F.contains(file, F.lit("/gone=true/")).alias("gone"))
    upto = max(_numbers(spark, index, "merged=*/_SUCCESS"), default=None)
    if upto is None:
        return changes
    batch, sweep = upto
    base = spark.read.schema(ROWS).parquet(f"{index}/merged={batch}.{sweep}").select("*", F.lit(batch).cast("long").alias("batch"), F.lit(sweep).cast("long").alias("sweep"), F.lit(False).alias("gone"))
    return base.unionByName(changes.where((F.col("batch") > batch) | (F.col("batch") == batch) & (F.col("sweep") > sweep)))


def current(rows: DataFrame) -> DataFrame:
    """The latest state of each record of an index's entries, by batch and sweep, then by time of change; without those that
    are gone."""
    state = F.max_by(F.struct("modified", "props", "gone"), F.struct("batch", "sweep", "modified"))
    return rows.groupBy("collection", "record").agg(state.alias("s")).where("NOT s.gone").select("collection", "record", "s.modified", "s.props")


def swept(spark: SparkSession, root: str, index: str) -> DataFrame:
    """Compares the index with the files that are there, adds what is new or edited, marks what is gone, and returns its state.

    A renamed file is one gone and one new.  Files are compared by path and time of change; only those that changed since the
    earliest difference are read.  Run it between batches, not beside one.
    """
    now = current(entries(spark, index))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    there = _rows(files, root, F.lit(None).cast("string")).drop("props")
    changed = there.join(now, ["collection", "record", "modified"], "left_anti")
    gone = now.join(there, ["collection", "record"], "left_anti").withColumn("props", F.lit(None).cast("string"))
    batch, place = max([-1, *(b for b, _ in _numbers(spark, index, "batch=*") + _numbers(spark, index, "merged=*/_SUCCESS"))]), time.time_ns()
    since = changed.agg(F.min("modified")).first()[0]
    for rows, is_gone in ((_rows(files.where(F.col("modificationTime") >= F.lit(since)), root).join(changed, ["collection", "record", "modified"], "left_semi") if since else None, "false"), (gone, "true")):
        if rows is not None:
            rows.select("collection", "record", "modified", "props").write.mode("overwrite").parquet(f"{index}/batch={max(batch, 0)}/sweep={place}/gone={is_gone}")
    return current(entries(spark, index))


def merged(spark: SparkSession, index: str) -> DataFrame:
    """Writes the state of an index as one table in place of all that was written so far, and returns it; marks of gone
    records go.  The old folders are removed once the table is complete, and entries() reads no older one beside it."""
    batches, before, place = _numbers(spark, index, "batch=*"), _numbers(spark, index, "merged=*"), time.time_ns()
    if batches:
        upto = max(b for b, _ in batches)
        current(entries(spark, index)).write.parquet(f"{index}/merged={upto}.{place}")
        for folder in [*(f"batch={b}" for b, _ in batches), *(f"merged={b}.{s}" for b, s in before)]:
            system, where = _path(spark, f"{index}/{folder}")
            system.delete(where, True)
    return current(entries(spark, index))


def _path(spark: SparkSession, path: str) -> tuple:
    """A path's file system and the path, as Spark sees them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _numbers(spark: SparkSession, index: str, pattern: str) -> list[tuple[int, int]]:
    """The numbers, a batch's and a sweep's, in the names of an index's folders that match a pattern."""
    system, where = _path(spark, f"{index}/{pattern}")
    found = [re.search(r"/(?:batch|merged)=(\d+)(?:\.(\d+))?", f.getPath().toString()) for f in system.globStatus(where) or []]
    return [(int(m[1]), int(m[2] or 0)) for m in found]


class Counters(StreamingQueryListener):
    """Hands {files or rows read, batches} of all queries so far to a callback, at most once in so many seconds, and at the end."""

    def __init__(self, report: Callable[[dict[str, int]], None], every: float = COUNTERS_EVERY, clock: Callable[[], float] = time.monotonic):
        self.report, self.every, self.clock = report, every, clock
        self.counts, self.last = {"rows": 0, "batches": 0}, None

    def add(self, rows: int) -> None:
        self.counts = {"rows": self.counts["rows"] + rows, "batches": self.counts["batches"] + 1}
        if self.last is None or self.clock() - self.last >= self.every:
            self.last = self.clock()
            self.report(self.counts)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.add(event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.report(self.counts)
