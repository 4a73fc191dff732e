"""Views over content rows: filters within results, sorting, files mode."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.patterns import is_extended, java_regex
from siftline.operators.search import path_order


def preview_line() -> Column:
    return F.concat("match_preview_before", "match_preview_match", "match_preview_after")


def within(rows: DataFrame, text: str, regex: bool = False) -> DataFrame:
    """Rows whose preview holds the text, cases apart, or matches the pattern, cases not apart; blank keeps all rows and a
    pattern that can't be used keeps none."""
    text = text.strip()
    if not text:
        return rows
    if not regex:
        return rows.where(F.contains(F.lower(preview_line()), F.lit(text.lower())))
    try:
        re.compile(text)
    except re.error:
        return rows.where(F.lit(False))
    if is_extended(text):
        return rows.where(F.lit(False))
    return rows.where(F.rlike(preview_line(), F.lit(java_regex(text, True))))


def sort_keys(column: str, ascending: bool = True) -> list[Column]:
    """Order by path, line or match; ties keep the search's order either way."""
    keys = {"path": [F.col("relative_path")], "line": [F.col("line_number"), F.col("column_number")], "match": [F.col("match_preview_match")]}[column]
    return [*(k.asc() if ascending else k.desc() for k in keys), *(F.asc(c) if isinstance(c, str) else c.asc() for c in (path_order(), "line_number", "column_number"))]


def sorted_view(rows: DataFrame, column: str = "path", ascending: bool = True, top: int | None = None) -> DataFrame:
    """rows in the view's order; with top only the first, which Spark takes without sorting all."""
    out = rows.orderBy(*sort_keys(column, ascending))
    return out if top is None else out.limit(top)


def ranked_by_file(rows: DataFrame, column: str = "line", ascending: bool = True) -> DataFrame:
    """rows with rank, the place of each in its file under the view's order."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("full_path").orderBy(*sort_keys(column, ascending))))


def files_mode(rows: DataFrame) -> DataFrame:
    """The first row of each file."""
    first = rows.groupBy("full_path").agg(F.min_by(F.struct(*(c for c in rows.columns if c != "full_path")), F.struct("line_number", "column_number")).alias("row"))
    return first.select("full_path", "row.*")
