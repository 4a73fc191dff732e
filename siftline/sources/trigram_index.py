"""An index of files by the byte trigrams of their lower-cased texts, for repeated searches.

The index only proposes files: every file that holds a literal is among its candidates, and a search verifies them like
any others.  Files are indexed in chunks of some thousands.  In a chunk a file is a small number, and a trigram's files are
the differences of their numbers, a byte each as a rule.  One shuffle deals the blocks out by chunk and trigram:

    <index>/share=<chunk modulo shares>/bucket=<trigram's bucket>/...   blocks, sorted by trigram
    <index>/share=<...>/bucket=-1/...                                   paths of the chunk's files

All blocks of a chunk are in one share, so a look-up needs no shuffle: a task takes a share, opens the folders of the
literal's trigrams alone, and intersects blocks chunk by chunk.  A trigram that most files have is spread over all shares.
Later batches of files are added as chunks of their own.
"""

from __future__ import annotations

import os
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StructType

from siftline.spec import SearchSpec

#: Files and bytes of text of a chunk, and bytes of text that are cut into trigrams at once.
CHUNK_FILES, CHUNK_BYTES, SLICE_BYTES = 4096, 64 << 20, 4 << 20
#: Folders in which the trigrams of a share are.
BUCKETS = 64
#: Name of the data source, and what its literal is called in filters.
SOURCE, LITERAL = "trigram_index", "literal"
BLOCKS = "share int, bucket int, chunk long, trigram int, files int, numbers binary, paths array<string>"
#: Letters whose lower case depends on what is around them, or is more than a letter.
UNSTABLE = "Σσςİ"


def bucket_of(trigram: np.ndarray, buckets: int) -> np.ndarray:
    return ((trigram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % buckets


def trigrams_of(literal: str) -> list[int]:
    """Trigrams that stand in each lower-cased text that holds the literal, in whatever case."""
    found: set[int] = set()
    for piece in re.split(f"[{UNSTABLE}]", literal):
        data = piece.lower().encode()
        found.update(int.from_bytes(data[k : k + 3], "big") for k in range(len(data) - 2))
    return sorted(found)


def literal_of(spec: SearchSpec) -> str | None:
    """What the index can be asked for on behalf of a search; null if it can't rule files out."""
    if spec.regex or spec.folded or (not spec.case_sensitive and not spec.term.isascii()):
        return None
    return spec.term


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def _pairs(texts: pa.Array, first: int) -> np.ndarray:
    """Distinct trigram << 16 | number of a batch of texts, whose numbers count from `first`."""
    raw = texts.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]].astype(np.int64)
    if len(data) < 3:
        return np.empty(0, np.int64)
    codes = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    owner = np.repeat(np.arange(len(raw)), np.diff(bounds))
    inside = owner[:-2] == owner[2:]
    return _distinct((codes[inside] << 16) | (owner[:-2][inside] + first))


def encoded(trigrams: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Blocks of sorted (trigram, number) pairs: each one's trigram, how many numbers it has, and their differences.

    A difference below 128 is a byte; others are two, the low seven bits first.  The first counts from -1.
    """
    new = np.r_[True, trigrams[1:] != trigrams[:-1]]
    steps = np.diff(numbers, prepend=-1)
    steps[new] = numbers[new] + 1
    long = steps >= 128
    at = np.cumsum(1 + long) - 1 - long
    out = np.zeros(int((1 + long).sum()), np.uint8)
    out[at] = np.where(long, (steps & 127) | 128, steps)
    out[at[long] + 1] = steps[long] >> 7
    begins = np.flatnonzero(new)
    offsets = np.append(at[begins], len(out)).astype(np.int32)
    blocks = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])
    return trigrams[begins], np.diff(np.append(begins, len(trigrams))), blocks


def decoded(block: bytes) -> np.ndarray:
    raw = np.frombuffer(block, np.uint8).astype(np.int64)
    second = np.r_[False, raw[:-1] >= 128] if len(raw) else np.zeros(0, bool)
    # A second byte may be 128 or more itself only if a difference had three bytes; numbers of 16 bits have two.
    steps = raw[~second] & 127
    steps[np.flatnonzero(raw[~second] >= 128)] |= raw[second] << 7
    return np.cumsum(steps) - 1


def _blocks(chunk: int, share: int, buckets: int, paths: list[str], pairs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    every = _distinct(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
    n = 0
    if len(every):
        trigrams, files, numbers = encoded(every >> 16, every & 0xFFFF)
        n = len(trigrams)
        bucket = bucket_of(trigrams, buckets)
    none = [pa.nulls(n, pa.list_(pa.string())), pa.array([paths], pa.list_(pa.string()))]
    columns = {
        "share": pa.array(np.full(n + 1, share), pa.int32()),
        "bucket": pa.array(np.append(bucket, -1) if n else [-1], pa.int32()),
        "chunk": pa.array(np.full(n + 1, chunk), pa.int64()),
        "trigram": pa.array(np.append(trigrams, -1) if n else [-1], pa.int32()),
        "files": pa.array(np.append(files, len(paths)) if n else [len(paths)], pa.int32()),
        "numbers": pa.chunked_array([*([numbers] if n else []), pa.nulls(1, pa.binary())]).combine_chunks(),
        "paths": pa.chunked_array(none).combine_chunks(),
    }
    yield pa.RecordBatch.from_pydict(columns)


def build(files: DataFrame, index: str, *, path: str = "full_path", text: str = "text", shares: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Writes an index of files to a folder that all executors share, or adds files to one; the index's blocks.

    Null texts have no trigrams, but their files stay candidates of literals without any.  An index has one number of
    shares and buckets: the first call settles them.  files must be the same if a task reads it again, as tables are.
    """
    spark = files.sparkSession
    have = settings(spark, index)
    shares, buckets = have if have else (shares or int(spark.conf.get("spark.sql.shuffle.partitions")), buckets)
    batch = uuid.uuid4().int & 0x7FFFFF

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, paths, pairs, filled = 0, [], [], 0

        def full() -> Iterator[pa.RecordBatch]:
            nonlocal number, paths, pairs, filled
            chunk = (batch << 40) | (TaskContext.get().partitionId() << 20) | number
            yield from _blocks(chunk, (chunk ^ (chunk >> 20)) % shares, buckets, paths, pairs)
            number, paths, pairs, filled = number + 1, [], [], 0

        for rows in batches:
            sizes = np.asarray(pc.fill_null(pc.binary_length(rows.column(1)), 0)).astype(np.int64)
            upto, lo = np.concatenate([[0], np.cumsum(sizes)]), 0
            while lo < rows.num_rows:
                hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + SLICE_BYTES, "right")) - 1)
                hi = min(hi, lo + CHUNK_FILES - len(paths))
                pairs.append(_pairs(rows.column(1).slice(lo, hi - lo), len(paths)))
                paths += rows.column(0).slice(lo, hi - lo).to_pylist()
                filled += int(upto[hi] - upto[lo])
                lo = hi
                if len(paths) >= CHUNK_FILES or filled >= CHUNK_BYTES:
                    yield from full()
        if paths:
            yield from full()

    blocks = files.select(F.col(path).alias("path"), F.lower(text).alias("text")).mapInArrow(cut, BLOCKS)
    dealt = blocks.repartition(shares, "share").sortWithinPartitions("share", "bucket", "trigram", "chunk")
    dealt.write.mode("append").partitionBy("share", "bucket").option("compression", "zstd").parquet(index)
    if not have:
        spark.createDataFrame([(shares, buckets)], "shares int, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{index}/_settings")
    return blocks_of(spark, index)


def settings(spark: SparkSession, index: str) -> tuple[int, int] | None:
    """Shares and buckets of an index; null where there is none yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{index}/_settings/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    row = spark.read.parquet(f"{index}/_settings").first()
    return row["shares"], row["buckets"]


def blocks_of(spark: SparkSession, index: str) -> DataFrame:
    """The blocks of an index, by Spark's reader: filters on share, bucket and trigram reach the files."""
    return spark.read.schema(BLOCKS).parquet(index)


def _common(rows: pa.Table, wanted: int) -> Iterator[tuple[int, list[str]]]:
    """(chunk, paths) of files that all wanted trigrams have, from blocks and paths of whole chunks."""
    by_chunk: dict[int, list[bytes]] = defaultdict(list)
    names: dict[int, pa.Scalar] = {}
    for k, (chunk, trigram) in enumerate(zip(rows.column("chunk").to_pylist(), rows.column("trigram").to_pylist())):
        if trigram < 0:
            names[chunk] = rows.column("paths")[k]
        else:
            by_chunk[chunk].append(rows.column("numbers")[k].as_py())
    for chunk, name in names.items():
        blocks = sorted(by_chunk[chunk], key=len)
        if len(blocks) < wanted:
            continue
        paths = name.values
        if wanted:
            found = decoded(blocks[0])
            for block in blocks[1:]:
                if not len(found):
                    break
                found = np.intersect1d(found, decoded(block), assume_unique=True)
            paths = paths.take(pa.array(found))
        yield chunk, paths.to_pylist()


def candidates(spark: SparkSession, index: str, literal: str, path: str = "full_path") -> DataFrame:
    """(path) of files that may hold a literal, by Spark's reader; wherever the index lies."""
    wanted = trigrams_of(literal)
    _, buckets = settings(spark, index)
    folders = [-1, *sorted(set(bucket_of(np.array(wanted, np.int64), buckets).tolist()))]
    rows = blocks_of(spark, index).where(F.col("bucket").isin(folders) & F.col("trigram").isin([-1, *wanted])).select("chunk", "trigram", "numbers", "paths")

    def look(rows: pa.Table) -> pa.Table:
        return pa.table({path: pa.array([p for _, paths in _common(rows, len(wanted)) for p in paths], pa.string())})

    return rows.groupBy("chunk").applyInArrow(look, f"{path} string")


class _Share(InputPartition):
    def __init__(self, folders: list[str]):
        self.folders = folders


class _Reader(DataSourceReader):
    def __init__(self, index: str, literal: str | None):
        self.index, self.literal = index, literal

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == (LITERAL,):
                if self.literal not in (None, f.value):
                    raise ValueError("one literal is looked up at a time")
                self.literal = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """A task for each share, with the folders that it opens and no others."""
        if self.literal is None:
            raise ValueError(f"ask for a {LITERAL}, as an option or by a filter")
        row = pads.dataset(f"{self.index}/_settings", format="parquet", exclude_invalid_files=True).to_table().to_pylist()[0]
        buckets = sorted(set(bucket_of(np.array(trigrams_of(self.literal), np.int64), row["buckets"]).tolist()))
        shares = [f"{self.index}/share={s}" for s in range(row["shares"])]
        return [_Share([f"{s}/bucket={b}" for b in (-1, *buckets) if os.path.isdir(f"{s}/bucket={b}")]) for s in shares if os.path.isdir(s)]

    def read(self, partition: _Share) -> Iterator[pa.RecordBatch]:
        wanted = trigrams_of(self.literal)
        columns = ["chunk", "trigram", "numbers", "paths"]
        test = pads.field("trigram").isin([-1, *wanted])
        tables = [pads.dataset(f, format="parquet").to_table(columns=columns, filter=test) for f in partition.folders]
        for _, paths in _common(pa.concat_tables(tables), len(wanted)) if tables else ():
            yield pa.RecordBatch.from_pydict({LITERAL: pa.array([self.literal] * len(paths), pa.string()), "full_path": pa.array(paths, pa.string())})


class TrigramIndex(DataSource):
    """spark.read.format("trigram_index").option("literal", ...).load(index): (literal, full_path) of candidates.

    For indexes on a file system that is mounted where tasks run; register() makes it known.  The literal may be given by a
    filter as well, so that SQL can look it up.
    """

    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> str:
        return f"{LITERAL} string, full_path string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"].removeprefix("file://"), self.options.get(LITERAL))


def register(spark: SparkSession) -> str:
    """Makes the data source known to a session, which gets the setting that it needs; its name."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TrigramIndex)
    return SOURCE


def searched(files: DataFrame, index: str, spec: SearchSpec) -> DataFrame:
    """The files that a search has to look at: the index's candidates, or all files where it can't rule any out."""
    literal = literal_of(spec)
    if literal is None or not trigrams_of(literal):
        return files
    return files.join(candidates(files.sparkSession, index, literal), "full_path", "left_semi")
