"""Packs: some megabytes of rows as one compressed row, and the exchange of sorted 64-bit keys between packs and buckets.

A step that must look up billions of keys sends one row per pack and bucket and not one per key.  Packs are written before
they are used, so every later step sees the same packs whatever becomes of the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.bytewords import slices
from siftline.llm.support import parts_of, written

#: Bytes of text in a pack, about.
PACK_BYTES = 4 << 20


def packed(rows: pa.RecordBatch | pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write(rows)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def packs_of(df: DataFrame, group: str | None = None, extra: Callable[[pa.Table], pa.RecordBatch] | None = None) -> DataFrame:
    """(pack, grp, rows): df's rows in packs, split by an integer column `group` if there is one.

    The last column but group is the text, whose bytes fill the packs.  A pack's number is made of its partition's and its
    place in it; it is fixed once written.  extra makes something of a pack's rows that later steps need, a column more.
    """
    names = [c for c in df.columns if c != group]
    ordered = df.select(*names, *([group] if group else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        held: dict[int, list[pa.RecordBatch]] = {}
        filled: dict[int, int] = {}

        def full(g: int) -> pa.RecordBatch:
            nonlocal number
            rows = pa.Table.from_batches(held.pop(g)).combine_chunks()
            filled.pop(g)
            number += 1
            out = {"pack": pa.array([number - 1], pa.int64()), "grp": pa.array([g], pa.int32()), "rows": pa.array([packed(rows)], pa.binary())}
            return pa.RecordBatch.from_pydict(out | ({"extra": pa.array([packed(extra(rows))], pa.binary())} if extra else {}))

        for batch in batches:
            for part in slices(batch, len(names) - 1, PACK_BYTES // 4):
                groups = np.asarray(part.column(len(names))) if group else np.zeros(part.num_rows, np.int32)
                data = part.select(names)
                for g in np.unique(groups).tolist():
                    some = data.filter(pa.array(groups == g))
                    held.setdefault(g, []).append(some)
                    filled[g] = filled.get(g, 0) + some.nbytes
                    if filled[g] >= PACK_BYTES:
                        yield full(g)
        for g in list(held):
            yield full(g)

    return written(ordered.mapInArrow(run, "pack long, grp int, rows binary" + ", extra binary" * bool(extra)), "packs")


def buckets_for(packs: DataFrame, per_part: int = 4) -> int:
    """Into how many buckets packs, a written table, deal their keys: some for each part of an exchange, and more of them the
    more packs there are, so that what meets in a bucket stays within a task.  A pack has no row for a bucket without keys, so
    rows are never more than the keys themselves would be."""
    return max(per_part * parts_of(packs.sparkSession), packs.count())


def bucket_bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among sorted keys; buckets cut the range of keys evenly."""
    edges = np.array([-(-(b << 64) // buckets) for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).astype(np.int64)


def encode(keys: np.ndarray) -> bytes:
    """Sorted distinct keys as differences, in as few bytes each as the largest needs."""
    steps = np.diff(keys, prepend=np.uint64(0)) if len(keys) else keys
    head = steps[:1].copy()
    steps[:1] = 0
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    body = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
    return bytes([width]) + head.astype("<u8").tobytes() + body.tobytes()


def decode(data: bytes) -> np.ndarray:
    width = data[0]
    if len(data) == 1:
        return np.empty(0, np.uint64)
    body = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(body), 8), np.uint8)
    steps[:, :width] = body
    steps = steps.reshape(-1).view("<u8").copy()
    steps[0] = np.frombuffer(data, "<u8", 1, 1)[0]
    return np.cumsum(steps)


def squeezed(numbers: np.ndarray) -> bytes:
    """Small integers, compressed."""
    raw = numbers.astype("<u4").tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueezed(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], n, codec="zstd", asbytes=True), "<u4") if n else np.empty(0, "<u4")


def only(df: DataFrame, *groups: int) -> DataFrame:
    return df.where(F.col("grp").isin(*groups))
