"""Rows from the output of grep -rnH, as a remote search returns it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions import folding
from siftline.spec import PREVIEW_MATCH, PREVIEW_SIDE, SearchSpec

_NUL = r"(?s)^([^\x00]+)\x00(\d+):(.*)$"
_COLON = r"(?s)^([^:]+):(\d+):(.*)$"


def parsed(output: DataFrame, line: str = "line") -> DataFrame:
    """(container_path, line_number, content): path and number end with NUL and colon, or both with colons; others go."""
    rx = F.when(F.contains(line, F.lit("\0")), F.lit(_NUL)).otherwise(F.lit(_COLON))
    get = lambda k: F.when(F.contains(line, F.lit("\0")), F.regexp_extract(line, _NUL, k)).otherwise(F.regexp_extract(line, _COLON, k))
    out = output.where(F.rlike(line, rx)).select(get(1).alias("container_path"), get(2).alias("__n"), get(3).alias("content"))
    out = out.withColumn("line_number", F.expr("try_cast(__n AS LONG)")).where("line_number > 0")
    return out.select("container_path", "line_number", "content")


def occurrences(output: DataFrame, spec: SearchSpec, line: str = "line") -> DataFrame:
    """A row for each occurrence; a line in which none is found again has one at column 1; paths that are
    relative or step upwards are left out."""
    rows = parsed(output, line).where(safe_path(F.col("container_path"))).withColumn("__spans", folding.spans_column(F.col("content"), spec))
    spans = F.when(F.size("__spans") > 0, F.col("__spans")).otherwise(F.array(F.struct(F.lit(0).alias("start"), F.least(F.length("content"), F.lit(0)).alias("end"))))
    rows = rows.select("container_path", "line_number", "content", F.explode(spans).alias("s"))
    start, end = F.col("s.start"), F.col("s.end")
    return rows.select("container_path", "line_number", (start + 1).cast("long").alias("column_number"), F.substring("content", 1, PREVIEW_MATCH).alias("line_content"), F.substring(F.col("content"), start + 1, F.least(end - start, F.lit(PREVIEW_MATCH))).alias("match_preview_match"), F.substring(F.col("content"), F.lit(1), F.least(start, F.lit(PREVIEW_SIDE))).alias("match_preview_before"))


def moved(path, old_root: str, new_root: str):
    """A path under one root as the same path under another; others stay."""
    old = old_root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(old)), F.concat(F.lit(new_root.rstrip("/") + "/"), F.substring(path, F.lit(len(old) + 1), F.length(path)))).otherwise(path)


def safe_path(path):
    """Absolute and without a step upwards."""
    return F.startswith(path, F.lit("/")) & ~F.array_contains(F.split(path, "/"), "..")
