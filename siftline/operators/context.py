"""Lines around matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most lines before and after.
MOST = 20


def clamped(n: int) -> int:
    return min(max(n, 1), MOST)


def context_lines(lines: DataFrame, is_match: str, before: int = 1, after: int = 1) -> DataFrame:
    """Of lines (full_path, line_number, line, a boolean column), those near a match, with is_match.

    A line is near if a match lies up to `after` lines before it or `before` lines after it.
    """
    w = Window.partitionBy("full_path").orderBy("line_number").rowsBetween(-clamped(after), clamped(before))
    near = F.max(F.col(is_match).cast("int")).over(w)
    return lines.withColumn("__near", near).where("__near = 1").drop("__near").withColumnRenamed(is_match, "is_match")


def preview(files: DataFrame, wanted: DataFrame, before: int = 2, after: int = 2) -> DataFrame:
    """For each (full_path, line_number) of wanted an array of (line_number, content, is_match) around it and
    match_line_index, its place there: null where the file has no such line."""
    from siftline.operators.search import line_array

    b, a = clamped(before), clamped(after)
    lines = line_array(F.col("text"))
    joined = wanted.where("line_number > 0").join(files.select("full_path", "text"), "full_path")
    first = F.greatest(F.lit(1).cast("long"), F.col("line_number") - b)
    window = F.slice(F.col("__lines"), first.cast("int"), (F.col("line_number") + a - first + 1).cast("int"))
    rows = F.transform(window, lambda x, i: F.struct((first + i).alias("line_number"), F.replace(x, F.lit("\0"), F.lit("�")).alias("content"), (first + i == F.col("line_number")).alias("is_match")))
    index = F.when(F.col("line_number") <= F.size("__lines"), F.col("line_number") - first)
    return joined.withColumn("__lines", lines).select("full_path", "line_number", rows.alias("lines"), index.alias("match_line_index"))
