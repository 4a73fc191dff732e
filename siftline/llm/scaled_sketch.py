"""Threshold-scaled sketches of documents: all hashes of word shingles below a fixed share of their range.

A document's sketch keeps a fixed share of its distinct shingles, whatever its length, so the share of one sketch's hashes
that stand in another estimates containment between texts of very unequal lengths, and the sketch of a union is the union
of sketches.  A text none of whose hashes lies below the threshold keeps its least one, which is an estimate too: two texts
agree in it as often as their similarity says.  A merged sketch needs that one only if nothing lies below.

Sketches are ascending arrays of longs; comparing and merging are Spark expressions over them.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.bytewords import slices, texts_of
from siftline.llm.jaccard_join import sets_of
from siftline.llm.support import parts_of, prepared

#: Words of a shingle, and the share of hashes that are kept is one in SCALE.
WORDS, SCALE = 5, 4
#: Bytes of text sketched at once, and keys looked at for each bound between parts.
SLICE, KEYS = 2 << 20, 16


@dataclass(frozen=True)
class Rule:
    """Shingles of so many words; one hash in `scale` is below the threshold.  Hashes have 63 bits, so that they are longs."""

    words: int = WORDS
    scale: int = SCALE

    @property
    def threshold(self) -> int:
        return (1 << 63) // self.scale

    def sketches(self, column: pa.Array) -> list[np.ndarray]:
        """Of each text; texts without words have empty ones."""
        sets = sets_of(texts_of(column), self.words)
        # The most significant bits choose; the others are as good as any.
        values, first = sets.values >> np.uint64(1), sets.first
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            own = values[a:b]  # ascending
            out.append(np.unique(own[: max(1, int(np.searchsorted(own, np.uint64(self.threshold))))]).astype(np.int64))
        return out


def similarity(a: np.ndarray, b: np.ndarray, threshold: int) -> tuple[float, float, float]:
    """Estimates of Jaccard similarity, of a's share in b, and of b's share in a.

    Empty sketches are like each other and unlike all others.  A hash beyond the threshold stands for a whole text: it is
    compared with the other sketch's least one.
    """
    if not len(a) or not len(b):
        return (1.0,) * 3 if len(a) == len(b) else (0.0,) * 3
    if a[0] >= threshold or b[0] >= threshold:
        return (float(a[0] == b[0]),) * 3
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both), both / len(a), both / len(b)


def jaccard(a: Column, b: Column, rule: Rule = Rule()) -> Column:
    """similarity()'s first estimate, for columns of sketches."""
    return _estimate(a, b, rule, lambda both: both / (F.size(a) + F.size(b) - both))


def containment(a: Column, b: Column, rule: Rule = Rule()) -> Column:
    """The share of a's shingles that b has, for columns of sketches."""
    return _estimate(a, b, rule, lambda both: both / F.size(a))


def _estimate(a: Column, b: Column, rule: Rule, share) -> Column:
    least = [F.element_at(x, 1) for x in (a, b)]
    alone = F.greatest(*least) >= rule.threshold
    none = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(none, (F.size(a) == F.size(b)).cast("double")).when(alone, (least[0] == least[1]).cast("double")).otherwise(share(F.size(F.array_intersect(a, b)).cast("double")))


def merged(a: Column, b: Column, rule: Rule = Rule()) -> Column:
    """The sketch of two texts' shingles together."""
    every = F.array_sort(F.array_union(a, b))
    below = F.filter(every, lambda h: h < rule.threshold)
    return F.when(F.size(below) > 0, below).otherwise(F.slice(every, 1, 1))


def as_text(sketch: np.ndarray) -> str:
    """16 hexadecimal digits a hash."""
    return sketch.astype(">u8").tobytes().hex()


def sketch(docs: DataFrame, identifier: str = "doc_id", text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """(identifier, sketch) of every row.  Null and empty texts, and texts without words, have empty sketches; texts of
    fewer words than a shingle have one shingle, all their words.  Repeated rows stay; other columns are not read."""
    prepared(docs.sparkSession)
    kind = docs.schema[identifier].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 1, SLICE):
                found = pa.array(rule.sketches(some.column(1)), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([some.column(0), found], names=[identifier, "sketch"])

    return docs.select(identifier, text).mapInArrow(run, f"{identifier} {kind}, sketch array<long>")


def _key(known: bool, identifier: object, h: int) -> tuple:
    """What rows are ordered by; null identifiers come first."""
    return (known, identifier if known else 0, h)


def _bounds(rows: DataFrame, parts: int) -> list[tuple]:
    """Keys that cut rows into about equal parts: some KEYS for each part are looked at."""
    keys = rows.select("known", "id", "h").distinct()
    every = max(1, keys.count() // (KEYS * parts))
    some = sorted(_key(*r) for r in keys.where(F.pmod(F.xxhash64("h", "id"), F.lit(every)) == 0).collect())
    return [some[k * len(some) // parts] for k in range(1, parts)] if some else []


def _in_order(docs: DataFrame, identifier: str, text: str) -> DataFrame:
    """docs as (part, again, id, text), dealt out by order of identifier, parts in order and rows in order within them.

    Rows follow each other by identifier, null first, and by a hash of their text where identifiers are equal.  Every part
    ends with the first row of the next part that has any, again being true there; the last ends with the first of all.
    """
    spark = prepared(docs.sparkSession)
    parts = parts_of(spark)
    rows = docs.select(F.col(identifier).alias("id"), F.col(text).alias("text")).withColumns({"known": F.col("id").isNotNull(), "h": F.xxhash64("text")})
    bounds = _bounds(rows, parts)

    @F.arrow_udf("int")
    def part_of(known: pa.Array, identifiers: pa.Array, hashes: pa.Array) -> pa.Array:
        return pa.array([bisect.bisect_right(bounds, _key(*k)) for k in zip(known.to_pylist(), identifiers.to_pylist(), hashes.to_pylist())], pa.int32())

    rows = rows.withColumn("part", part_of("known", "id", "h"))
    heads = rows.groupBy("part").agg(F.min(F.struct("known", "id", "h")).alias("head")).orderBy("part").collect()  # a row for each part
    firsts = spark.createDataFrame(
        [(heads[k - 1]["part"], *r["head"]) for k, r in enumerate(heads)],
        f"to int, head_known boolean, head_id {docs.schema[identifier].dataType.simpleString()}, head_h long",
    )
    is_head = (F.col("known") == F.col("head_known")) & F.col("id").eqNullSafe(F.col("head_id")) & (F.col("h") == F.col("head_h"))
    # Of repeated rows one is enough.
    copies = rows.join(F.broadcast(firsts), is_head).groupBy("to").agg(F.min(F.struct("known", "id", "h", "text")).alias("r"))
    copies = copies.select("r.id", "r.text", "r.known", "r.h", F.col("to").alias("part"), F.lit(True).alias("again"))
    every = rows.withColumn("again", F.lit(False)).unionByName(copies)
    return every.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "again", "known", "id", "h").select("part", "again", "id", "text")


def compared(docs: DataFrame, identifier: str = "doc_id", text: str = "text", rule: Rule = Rule(), replaced: int = 4) -> DataFrame:
    """(identifier, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, held_by_next,
    holds_next) of every row.

    The edited text has its last n_chars / replaced code points, rounded down, replaced by the first as many, or all, of the
    next row's text.  Rows follow each other by identifier, null first, then by a hash of the text; after the last comes the
    first, so that a single row is its own next one.  near_ columns are Jaccard similarities estimated by the sketches, the
    last two are the containment of the row's shingles in the next row's and the other way.  Null texts are empty; empty
    sketches are alike (1) and unlike all others (0).  Equal rows stay apart and give equal results, but for the one
    that another row follows.  An empty table has no rows.  Other columns are not read.
    """
    rows = _in_order(docs, identifier, text)
    kind = docs.schema[identifier].dataType.simpleString()

    def finished(pairs: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        """pairs of (identifier, text, sketch, next text, next sketch)"""
        edited = []
        for _, t, _, after, _ in pairs:
            k = len(t) // replaced
            edited.append((t[: len(t) - k] + after[:k]) if k else t)
        marks = rule.sketches(pa.array(edited, pa.large_string()))
        near = [similarity(s, e, rule.threshold)[0] for (_, _, s, _, _), e in zip(pairs, marks)]
        following = [similarity(s, n, rule.threshold) for _, _, s, _, n in pairs]
        columns = {
            identifier: pa.array([p[0] for p in pairs], id_type),
            "n_chars": pa.array([len(p[1]) for p in pairs], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
            "fingerprint": pa.array([as_text(p[2]) for p in pairs]),
            "edited_fingerprint": pa.array([as_text(m) for m in marks]),
            "near_edited": pa.array(near, pa.float64()),
            "near_next": pa.array([f[0] for f in following], pa.float64()),
            "held_by_next": pa.array([f[1] for f in following], pa.float64()),
            "holds_next": pa.array([f[2] for f in following], pa.float64()),
        }
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose next one is still to come
        for batch in batches:
            for some in slices(batch, 3, SLICE):
                pairs = []
                part, again, identifiers, texts = (c.to_pylist() for c in some.columns)
                for p, a, i, t, s in zip(part, again, identifiers, texts, rule.sketches(some.column(3))):
                    t = t or ""
                    if held is not None and held[0] == p and not held[4]:
                        pairs.append((held[1], held[2], held[3], t, s))
                    held = (p, i, t, s, a)
                if pairs:
                    yield finished(pairs, some.column(2).type)

    schema = f"{identifier} {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, held_by_next double, holds_next double"
    return rows.mapInArrow(run, schema)
