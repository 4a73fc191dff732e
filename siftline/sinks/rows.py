"""Content rows as text, CSV, JSON and Markdown, and rewritten files written back."""

from __future__ import annotations

import os
import stat
import tempfile
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.spec import SpecError


def printable(text: Column) -> Column:
    """Control characters but tabs as replacement characters, for terminals."""
    return F.regexp_replace(text, F.lit(r"[\p{Cc}&&[^\t]]"), F.lit("�"))


def csv_field(text: Column) -> Column:
    """Quoted if need be; a field that a spreadsheet would take for a formula begins with a quote mark."""
    guarded = F.when(F.rlike(text, F.lit(r"\A[=+\-@\t\r\n]")), F.concat(F.lit("'"), text)).otherwise(text)
    return F.when(F.rlike(guarded, F.lit('[",\r\n]')), F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(guarded)


def text_rows(rows: DataFrame, terminal: bool = False) -> DataFrame:
    content = printable(F.col("line_content")) if terminal else F.col("line_content")
    return rows.select(F.concat_ws(":", "full_path", F.col("line_number").cast("string"), F.col("column_number").cast("string"), content).alias("row"))


def csv_rows(rows: DataFrame) -> DataFrame:
    """File,Line,Column,Content,FullPath,MatchCount"""
    return rows.select(_csv_row().alias("row"))


def json_rows(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("row"))


def json_array(rows: DataFrame) -> DataFrame:
    """(line) of one JSON array, a row a line: [ and the first row, then the others with a comma before each, then ].

    Lines are in order of paths and line numbers; nothing is gathered in one row.
    """
    place = F.struct(F.split("full_path", "/").alias("path"), F.col("line_number").alias("number"))
    each = rows.select(place.alias("place"), F.to_json(F.struct(*rows.columns)).alias("row"))
    first = each.agg(F.min(F.struct("place", "row")).alias("first"))
    marked = each.join(F.broadcast(first), F.lit(True)).select("place", "row", F.when(F.struct("place", "row") == F.col("first"), "[").otherwise(",").alias("mark"))
    lines = marked.select(F.lit(0).alias("end"), "place", (F.col("mark") != "[").alias("later"), F.concat("mark", "row").alias("line"))
    last = first.select(F.lit(1).alias("end"), F.lit(None).cast(lines.schema["place"].dataType).alias("place"), F.lit(True).alias("later"), F.when(F.col("first").isNull(), "[]").otherwise("]").alias("line"))
    return lines.unionByName(last).orderBy("end", "place", "later", "line").select("line")


def csv_table(rows: DataFrame) -> DataFrame:
    """csv_rows() in order of paths, behind a line of the columns' names."""
    texts = rows.select(F.lit(1).alias("after"), F.split("full_path", "/").alias("path"), F.col("line_number").alias("number"), _csv_row().alias("row"))
    head = rows.sparkSession.createDataFrame([(0, "File,Line,Column,Content,FullPath,MatchCount")], "after int, row string")
    return head.unionByName(texts, allowMissingColumns=True).orderBy("after", "path", "number", "row").select("row")


def _csv_row() -> Column:
    return F.concat_ws(",", csv_field(F.col("file_name")), F.col("line_number").cast("string"), F.col("column_number").cast("string"), csv_field(F.col("line_content")), csv_field(F.col("full_path")), F.col("match_count").cast("string"))


def view_csv(rows: DataFrame) -> DataFrame:
    """path,line,column,match of visible rows."""
    match = F.concat("match_preview_before", "match_preview_match", "match_preview_after")
    return rows.select(F.concat_ws(",", csv_field(F.col("full_path")), F.col("line_number").cast("string"), F.col("column_number").cast("string"), csv_field(match)).alias("row"))


def view_json(rows: DataFrame) -> DataFrame:
    match = F.concat("match_preview_before", "match_preview_match", "match_preview_after")
    return rows.select(F.to_json(F.struct(F.col("full_path").alias("path"), F.col("line_number").alias("line"), F.col("column_number").alias("column"), match.alias("match"))).alias("row"))


def markdown_rows(rows: DataFrame) -> DataFrame:
    cell = lambda c: F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    match = F.concat("match_preview_before", "match_preview_match", "match_preview_after")
    return rows.select(F.concat(F.lit("| "), cell(F.col("full_path")), F.lit(" | "), F.col("line_number").cast("string"), F.lit(" | "), F.col("column_number").cast("string"), F.lit(" | "), cell(match), F.lit(" |")).alias("row"))


def exit_code(rows: DataFrame) -> int:
    """0 if there is a row, 1 if none; stops at the first."""
    return 1 if rows.isEmpty() else 0


def exit_code_of(plan: Callable[[], DataFrame]) -> int:
    """exit_code() of the rows that a function plans; 2 where they can't be asked for as they are, or Spark can't find them.
    An error of any other kind goes on."""
    try:
        return exit_code(plan())
    except (SpecError, PySparkException):
        return 2


def write_back(changed: DataFrame, root: str) -> DataFrame:
    """Writes (full_path, new_text, encoding) over its files, each at once and with its mode; returns (full_path, failure).

    Paths that leave the root, links, and encodings that can't be written are failures.
    """
    from siftline.sources.decode import encoded

    real = os.path.realpath(root)

    def write(batches):
        for pdf in batches:
            failures = []
            for path, text, label in zip(pdf.full_path, pdf.new_text, pdf.encoding):
                try:
                    if os.path.commonpath([os.path.realpath(path), real]) != real or os.path.islink(path):
                        raise ValueError("outside the root")
                    data = encoded(text, label)
                    mode = stat.S_IMODE(os.stat(path).st_mode)
                    with tempfile.NamedTemporaryFile(dir=os.path.dirname(path), delete=False) as f:
                        f.write(data)
                        f.flush()
                        os.fchmod(f.fileno(), mode)
                        os.fsync(f.fileno())
                    os.replace(f.name, path)
                    failures.append(None)
                except (OSError, ValueError, LookupError) as e:
                    failures.append(str(e))
            yield pdf[["full_path"]].assign(failure=failures)

    return changed.select("full_path", "new_text", "encoding").mapInPandas(write, "full_path string, failure string")
