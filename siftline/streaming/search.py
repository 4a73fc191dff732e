"""Searches over files as they arrive, with Structured Streaming."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftline.operators.search import content_rows
from siftline.sources import corpus
from siftline.spec import MAX_RESULTS, SearchSpec

#: Rows that a view takes at once, and seconds between two times.
ROWS_AT_ONCE, ROWS_EVERY = 4096, 0.016


def arriving_documents(spark: SparkSession, folder: str, schema: str, files_at_once: int = 16) -> DataFrame:
    """Rows of Parquet files as they arrive in a folder, as files to search."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)
    return corpus.documents(raw)


def search_stream(files: DataFrame, spec: SearchSpec, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands each batch's content rows to `each`, which must take a batch again after a failure.

    The searches of later files do not depend on earlier ones, so there is no state; stop() ends it between batches.
    """
    if spec.max_results is not None:
        raise ValueError(f"a stream has no order to take the first results of; {MAX_RESULTS} is no limit here either")
    rows = content_rows(files, spec)
    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(rows: DataFrame) -> DataFrame:
    """A Match event for each row and a FileScanned event for each file that has one."""
    match = rows.select(F.lit("Match").alias("event"), "full_path", "line_number")
    scanned = rows.select(F.lit("FileScanned").alias("event"), "full_path", F.lit(None).cast("long").alias("line_number")).distinct()
    return match.unionByName(scanned)


def windowed_events(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """An extension: counts of events by time window and type, with a watermark for late ones."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def handed_on(rows: DataFrame, take: Callable[[list[Row]], None], *, most: int = ROWS_AT_ONCE, every: float = ROWS_EVERY, clock: Callable[[], float] = time.monotonic) -> int:
    """Hands rows to a view as they come, at most so many at a time and no later than `every` seconds after the last time, if
    more have come; how many there were.

    Partitions are asked for one after the other while the one before is taken, so a slow view holds Spark back and the driver
    never has more than two.
    """
    held, total, last = [], 0, clock()
    for row in rows.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) >= most or clock() - last >= every:
            take(held)
            total, held, last = total + len(held), [], clock()
    if held:
        take(held)
    return total + len(held)
