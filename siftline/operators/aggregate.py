"""Aggregates of content rows: per file, over a whole search, and per skip reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.operators.predicates import classified
from siftline.operators.search import COLUMNS, content_rows
from siftline.spec import MAX_RESULTS, SearchSpec


def file_rows(rows: DataFrame, files: DataFrame, nested: bool = True) -> DataFrame:
    """A row for each matching file; files that are gone since have size 0 and no other data."""
    place = F.struct("line_number", "column_number")
    first = F.min_by(F.struct("match_preview_before", "match_preview_match", "match_preview_after"), place)
    every = [F.array_sort(F.collect_list(F.struct("line_number", "column_number", *(c for c in COLUMNS if c not in ("line_number", "column_number"))))).alias("preview_matches")] if nested else []
    per = rows.groupBy("full_path").agg(F.first("file_name").alias("file_name"), F.first("relative_path").alias("relative_path"), F.sum("match_count").alias("match_count"), F.min("line_number").alias("first_match_line_number"), first.alias("__first"), *every)
    data = files.select("full_path", "size", "extension", "encoding", F.col("mtime").alias("date_modified_unix"))
    out = per.join(data, "full_path", "left").withColumn("size", F.coalesce("size", F.lit(0).cast("long"))).withColumn("encoding", F.coalesce("encoding", F.lit("UTF-8")))
    return out.select("full_path", "relative_path", "file_name", "size", "match_count", "first_match_line_number", "__first.*", *(["preview_matches"] if nested else []), "extension", "encoding", "date_modified_unix")


def summary(files: DataFrame, spec: SearchSpec, walk_errors: int = 0) -> DataFrame:
    """One row: files scanned, matched and skipped, matches, and whether the engine's limit was reached."""
    seen = classified(files, spec).agg(F.count_if(F.col("skip_reason").isNull()).alias("files_scanned"), (F.count_if(F.col("skip_reason").isNotNull()) + walk_errors).alias("skipped_files"))
    rows = content_rows(files, spec)
    hits = rows.agg(F.countDistinct("full_path").alias("files_matched"), F.coalesce(F.sum("match_count"), F.lit(0)).alias("matches"), (F.lit(spec.max_results is None) & (F.count("*") >= MAX_RESULTS)).alias("capped"))
    # One row each.
    return seen.join(hits, F.lit(True)).select("files_scanned", "files_matched", "matches", "skipped_files", F.lit(False).alias("cancelled"), "capped")


def total(rows: DataFrame) -> DataFrame:
    return rows.agg(F.coalesce(F.sum("match_count"), F.lit(0)).alias("matches"))


def distinct_files(rows: DataFrame) -> DataFrame:
    return rows.select("full_path").distinct()


def files_in_order(rows: DataFrame) -> DataFrame:
    """The files that have rows, each once, in order of their paths' components."""
    return distinct_files(rows).orderBy(F.split("full_path", "/"))
