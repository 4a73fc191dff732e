"""Tables of texts as files: full_path, relative_path, file_name, extension, size, mtime, text, encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.sources.shared import bounded_batches


def file_name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension_of(file_name: Column) -> Column:
    """After the last dot, in lower case; names that begin with their only dot have none."""
    return F.nullif(F.lower(F.regexp_extract(file_name, r"^.+\.([^.]+)$", 1)), F.lit(""))


def as_files(df: DataFrame, relative_path: Column, text: Column, root: str = "/corpus", mtime: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row of df as a file; null texts are files whose size is unknown."""
    bounded_batches(df.sparkSession)
    out = df.select(relative_path.alias("relative_path"), text.alias("text"), (mtime if mtime is not None else F.lit(None)).cast("long").alias("mtime"), *keep)
    name = file_name_of(F.col("relative_path"))
    return out.select(F.concat(F.lit(root.rstrip("/") + "/"), "relative_path").alias("full_path"), "relative_path", name.alias("file_name"), extension_of(name).alias("extension"), F.octet_length("text").cast("long").alias("size"), "mtime", "text", F.lit("UTF-8").alias("encoding"), *keep)


def documents(df: DataFrame) -> DataFrame:
    """documents: <lang>/<source>/<doc_id>.txt"""
    return as_files(df, F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))), F.col("text"))


def varied_documents(df: DataFrame) -> DataFrame:
    """documents under names that meet every rule of the predicates: hidden, system and binary ones among them."""
    k = F.col("doc_id") % 8
    folder = F.when(k == 0, ".cache").when(k == 1, "vendor").when(k == 2, "storage/framework").otherwise(F.col("source"))
    suffix = F.when(k == 3, ".PNG").when(k == 4, ".docx").when(k == 5, ".md").otherwise(".txt")
    return as_files(df, F.concat_ws("/", "lang", folder, F.concat(F.col("doc_id").cast("string"), suffix)), F.col("text"))


def pages(df: DataFrame) -> DataFrame:
    """pages: <host>/<page_id>.html"""
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    return as_files(df, F.concat_ws("/", host, F.concat(F.col("page_id").cast("string"), F.lit(".html"))), F.col("html"))


def conversations(df: DataFrame) -> DataFrame:
    """conversations, line by line: (full_path, line_number, line), a file for each conversation."""
    path = F.concat(F.lit("/conversations/"), F.col("conv_id").cast("string"), F.lit(".log"))
    return df.select(path.alias("full_path"), F.col("turn").cast("long").alias("line_number"), F.concat_ws(": ", "role", "text").alias("line"))
