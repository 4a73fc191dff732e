"""Directory trees as files tables.

Executors walk a tree in rounds, so it must be mounted where they run.  Files are then dealt out anew and read where they
land.  Stores that only Spark reads go through `stored`, which takes Spark's own reader and with it that reader's rule to
leave out names that begin with . or _.
"""

from __future__ import annotations

import os
import stat
import uuid
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siftline.sources import decode, extract, ignore
from siftline.sources.corpus import extension_of, file_name_of
from siftline.sources.shared import bounded_batches, shared_folder
from siftline.spec import MAX_DEPTH, MAX_FILE_BYTES, SearchSpec, SpecError

#: Rows of a walk: entries that were found, and directories that are still to be looked at.
WALKED = "directory string, name string, is_link boolean, walk_error string, open boolean"
LISTED = "full_path string, relative_path string, size long, mtime long, walk_error string"
#: Entries after which a task hands its open directories back, to be dealt out anew.
AT_ONCE = 20_000
ROWS_AT_ONCE = 4096


def _level(root: str, directory: str, spec: SearchSpec, stack: list[ignore.Rules]) -> Iterator[tuple[str, bool, bool, str | None]]:
    """(name, is directory, is link, error) of a directory's entries that the walk shows, as they come."""
    try:
        entries = os.scandir(os.path.join(root, directory))
    except OSError as e:
        yield "", False, False, f"IoError: {e.strerror}"
        return
    with entries:
        for e in entries:
            if e.name.startswith(".") and not spec.include_hidden or e.is_symlink() and not spec.include_symlinks:
                continue
            try:
                is_dir = e.is_dir(follow_symlinks=spec.include_symlinks)
            except OSError as err:
                yield e.name, False, True, f"IoError: {err.strerror}"
                continue
            if not (stack and ignore.ignored(f"{directory}/{e.name}" if directory else e.name, is_dir, stack)):
                yield e.name, is_dir, e.is_symlink(), None


def _walk(root: str, directories: Iterator[str], spec: SearchSpec, above: list[ignore.Rules]) -> Iterator[tuple]:
    """Rows of WALKED below directories given relative to the root.  Nothing is held but the names of open directories, and
    after AT_ONCE entries they are given back."""
    n = 0
    for first in directories:
        todo = [first]
        while todo:
            at = todo.pop()
            stack = list(ignore.stack_of(root, at, above)) if spec.respect_ignore else []
            deeper = spec.include_subfolders and (at.count("/") + 2 if at else 1) < MAX_DEPTH
            for name, is_dir, is_link, error in _level(root, at, spec, stack):
                n += 1
                if not is_dir:
                    yield at, name, is_link, error, False
                elif deeper:
                    path = f"{at}/{name}" if at else name
                    if n < AT_ONCE:
                        todo.append(path)
                    else:
                        yield path, None, is_link, None, True
            if n >= AT_ONCE:
                yield from ((path, None, False, None, True) for path in todo)
                todo = []


def listed(spark: SparkSession, root: str, spec: SearchSpec, shared: str | None = None) -> DataFrame:
    """full_path, relative_path, size, mtime and walk_error of every file that the walk shows.

    The walk goes in rounds: each deals the open directories out, and a task gives back those that it has no time for.  What a
    round found is written to the shared folder.  Sizes and times are asked for file by file after another dealing-out, so
    that the files of a single large directory are spread as well.
    """
    if not os.path.exists(root):
        raise SpecError(f"{root} does not exist")
    if not os.path.isdir(root):
        raise SpecError(f"{root} is no directory")
    root = os.path.realpath(root)
    above = ignore.rules_above(root, ignore.global_file()) if spec.respect_ignore else []
    names = [c.split()[0] for c in WALKED.split(", ")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _walk(root, (d for batch in batches for d in batch.column(0).to_pylist()), spec, above)
        while some := list(islice(rows, ROWS_AT_ONCE)):
            kinds = [pa.string(), pa.string(), pa.bool_(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], names=names)

    def looked_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([dict(zip(_LISTED.names, _stat(root, *row))) for row in zip(*(c.to_pylist() for c in batch.columns))], schema=_LISTED)

    tasks = spark.sparkContext.defaultParallelism
    folder = f"{shared or shared_folder(spark)}/walk-{uuid.uuid4().hex}"
    open_, number, found = spark.createDataFrame([("",)], "directory string"), 0, None
    while number == 0 or not open_.isEmpty():
        dealt = open_ if number == 0 else open_.repartition(4 * tasks)
        dealt.mapInArrow(walk, WALKED).write.parquet(f"{folder}/{number}")
        rows = spark.read.schema(WALKED).parquet(f"{folder}/{number}")
        open_, mine = rows.where("open").select("directory"), rows.where("NOT open").select("directory", "name", "is_link", "walk_error")
        found, number = mine if found is None else found.unionByName(mine), number + 1
    return found.repartition(4 * tasks, "directory", "name").mapInArrow(looked_at, LISTED)


_LISTED = pa.schema([("full_path", pa.string()), ("relative_path", pa.string()), ("size", pa.int64()), ("mtime", pa.int64()), ("walk_error", pa.string())])


def _stat(root: str, directory: str, name: str, is_link: bool, error: str | None) -> tuple:
    """A row of LISTED."""
    path = f"{directory}/{name}" if directory and name else directory or name
    full = os.path.join(root, path) if path else root
    if error is None:
        try:
            found = os.stat(full) if is_link else os.lstat(full)
            if stat.S_ISREG(found.st_mode):
                return full, path, found.st_size, int(found.st_mtime), None
            error = "IoError: not a regular file"
        except OSError as e:
            error = f"IoError: {e.strerror}"
    return full, path, None, None, error


def read(files: DataFrame) -> DataFrame:
    """files with file_name, extension, text and encoding; text is null, with walk_error, where reading failed.

    Documents give their extracted text, other files are decoded.  Files beyond MAX_FILE_BYTES are not opened.
    """
    name = file_name_of(F.col("relative_path"))
    files = files.withColumn("file_name", name).withColumn("extension", extension_of(name))
    schema = StructType(list(files.schema)).add("text", "string").add("encoding", "string")
    at = files.columns.index("walk_error")

    def content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a file at a time, as files may be large
                row = batch.slice(k, 1)
                text, label, error = None, None, row.column(at)[0].as_py()
                size = row.column("size")[0].as_py()
                if error is None and size is not None and size <= MAX_FILE_BYTES:
                    try:
                        with open(row.column("full_path")[0].as_py(), "rb") as f:
                            data = f.read()
                        text = extract.extracted(row.column("extension")[0].as_py(), data)
                        label = "UTF-8"
                        if text is None:
                            text, label = decode.decoded(data)
                    except OSError as e:
                        error = f"IoError: {e.strerror}"
                    except extract.ExtractError as e:
                        error = f"Extract: {e}"
                columns = [c if i != at else pa.array([error], pa.string()) for i, c in enumerate(row.columns)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([text], pa.string()), pa.array([label], pa.string())], names=[f.name for f in schema.fields])

    return files.mapInArrow(content, schema)


def tree(spark: SparkSession, root: str, spec: SearchSpec) -> DataFrame:
    """Every file of a tree with its text."""
    return read(listed(bounded_batches(spark), root, spec).repartition("full_path"))


def stored(spark: SparkSession, path: str) -> DataFrame:
    """Files of a store by Spark's reader: full_path, relative_path, size, mtime, text and so on."""
    raw = bounded_batches(spark).read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= MAX_FILE_BYTES)
    relative = F.regexp_replace("path", F.lit("^.*?" + path.rstrip("/").replace(".", r"\.") + "/"), F.lit(""))
    name = file_name_of(F.col("path"))

    @F.pandas_udf("struct<text:string,encoding:string>")
    def text(extension: pd.Series, content: pd.Series) -> pd.DataFrame:
        rows = []
        for e, c in zip(extension, content):
            try:
                got = extract.extracted(e, c)
                rows.append((got, "UTF-8") if got is not None else decode.decoded(c))
            except extract.ExtractError:
                rows.append((None, None))
        return pd.DataFrame(rows, columns=["text", "encoding"])

    out = raw.select(F.col("path").alias("full_path"), relative.alias("relative_path"), name.alias("file_name"), extension_of(name).alias("extension"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"), "content")
    return out.withColumn("t", text("extension", "content")).select("full_path", "relative_path", "file_name", "extension", "size", "mtime", "t.text", "t.encoding")
