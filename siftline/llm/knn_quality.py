"""Quality scores by nearest-neighbour voting in a latent semantic space.

A document's features are hashed byte trigrams and repeated words, weighted by inverse document frequency.  A truncated
singular value decomposition of a bounded sample of labelled documents gives the latent space; the sample's vectors and
labels, a few megabytes whatever the corpus, go to every task.  There, blocks of documents are multiplied with all sample
vectors, which gives exact cosines, and the nearest neighbours vote with their similarities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.bytewords import Texts, texts_of, words_of

#: Hashed features, latent dimensions, labelled documents learned from per label at most, and neighbours that vote.
HASHED, LATENT, PER_LABEL, NEIGHBOURS = 2048, 48, 1500, 25
#: All features: the hashed ones, and as many cells for repeated words as give them weight beside those.
FEATURES = HASHED + 64
#: Bytes of text turned into features at once, and documents multiplied at once.
CHUNK, BLOCK = 1 << 21, 512
#: Score from which a document counts as good.
ACCEPT = 0.7


@dataclass
class Model:
    """What a task needs to score: idf (FEATURES), axes (FEATURES x LATENT), unit vectors and votes of the sample."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    votes: np.ndarray
    prior: float


def features(texts: Texts) -> np.ndarray:
    """Counts of hashed byte trigrams and of words that repeat the word before, a row per text; digits are one letter."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    data = texts.data
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(texts.bounds, texts.bounds[lo] + CHUNK, "right")) - 1)
        hi = min(hi, len(texts))
        for begin in range(int(texts.bounds[lo]), int(texts.bounds[hi]), CHUNK):
            # One text may be longer than a chunk: its pieces overlap by two bytes and add up.
            end = min(begin + CHUNK + 2, int(texts.bounds[hi])) if hi == lo + 1 else int(texts.bounds[hi])
            b = data[begin:end].astype(np.uint32)
            if len(b) < 3:
                break
            b[(b >= 48) & (b <= 57)] = 48
            h = ((b[:-2] * np.uint32(65599) + b[1:-1]) * np.uint32(65599) + b[2:]) * np.uint32(2654435761)
            h >>= np.uint32(32 - 11)
            owner = np.repeat(np.arange(lo, hi), np.diff(texts.bounds[lo : hi + 1]))[: end - begin - 2] if hi > lo + 1 else np.full(end - begin - 2, lo)
            whole = np.arange(begin + 2, end) < texts.bounds[owner + 1]
            cell = (owner[whole] - lo) * HASHED + h[whole]
            out[lo:hi, :HASHED] += np.bincount(cell, minlength=(hi - lo) * HASHED).reshape(hi - lo, HASHED)
            if hi > lo + 1:
                break
        lo = hi
    words = words_of(texts)
    owner = words.owner()
    again = (words.hashes[1:] == words.hashes[:-1]) & (owner[1:] == owner[:-1])
    # One repeat happens in good prose too.
    out[:, HASHED:] = np.maximum(np.bincount(owner[1:][again], minlength=len(texts)) - 1, 0)[:, None]
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(norm > 1e-12, norm, 1)).astype(np.float32)


def fit(counts: np.ndarray, labels: np.ndarray, prior: float) -> Model:
    """From the sample's counts and labels; prior is the share of label 1 among all rows that may be learned from."""
    n = max(1, len(labels))
    idf = np.log((1 + n) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
    x = weighted(counts, idf)
    rng = np.random.default_rng(11)
    k = min(LATENT, max(1, min(x.shape)))
    q = rng.standard_normal((FEATURES, k + 8)).astype(np.float32)
    for _ in range(6):  # subspace iteration
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    axes = (q @ vt.T)[:, :k].astype(np.float32)
    share = labels.mean() if len(labels) else prior
    # The sample holds both labels in like numbers; votes weigh as the labels do among all rows.
    up, down = prior / max(share, 1e-9), (1 - prior) / max(1 - share, 1e-9)
    return Model(idf, axes, _unit(x @ axes), labels.astype(np.float32), np.where(labels == 1, up, down).astype(np.float32), prior)


def scores(model: Model, counts: np.ndarray) -> np.ndarray:
    """Scores of a block of documents; without a similar neighbour the score is the prior."""
    out = np.full(len(counts), model.prior)
    if not len(model.labels):
        return out
    k = min(NEIGHBOURS, len(model.labels))
    for lo in range(0, len(counts), BLOCK):
        cos = _unit(weighted(counts[lo : lo + BLOCK], model.idf) @ model.axes) @ model.vectors.T
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        sim = np.maximum(np.take_along_axis(cos, near, 1), 0).astype(np.float64) ** 4
        weight = sim * model.votes[near]
        total = weight.sum(1)
        # One vote of the prior keeps a few weak neighbours from deciding alone.
        out[lo : lo + BLOCK] = ((weight * model.labels[near]).sum(1) + 0.5 * model.prior) / (total + 0.5)
    return out


def train(docs: DataFrame, labels: DataFrame, *, identifier: str = "doc_id", text: str = "text", label: str = "quality", learn: Column) -> Model:
    """Fits on the PER_LABEL rows of each label with the lowest hashes of their identifiers, among rows that may be learned
    from (learn) and have a label of 0 or 1 and a document.

    The sample's texts stay on the executors; only its feature counts, PER_LABEL * 2 rows of FEATURES numbers at most,
    and the numbers of rows per label come to the driver.  An identifier with several
    labels or documents counts once, by its least label and text.
    """
    spark = docs.sparkSession
    mine = labels.select(F.col(identifier).alias("id"), F.col(label).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1)).groupBy("id").agg(F.min("y").alias("y"))
    mine = mine.join(docs.where(learn).select(F.col(identifier).alias("id")).distinct(), "id", "left_semi")
    sizes = {r["y"]: r["count"] for r in mine.groupBy("y").count().collect()}
    all_rows = sum(sizes.values())
    prior = sizes.get(1, 0) / all_rows if all_rows else 0.5
    sample = None
    for y in (0, 1):
        some = mine.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(PER_LABEL)
        sample = some if sample is None else sample.unionByName(some)
    chosen = sample.collect()
    if not chosen:
        return fit(np.zeros((0, FEATURES), np.float32), np.zeros(0), prior)
    small = spark.createDataFrame([(r["id"], r["y"]) for r in chosen], sample.schema)
    found = docs.select(F.col(identifier).alias("id"), F.col(text).alias("text")).join(F.broadcast(small), "id")
    # Of an identifier's texts the least one counts, so that reruns agree and as many rows come back as were chosen.
    found = found.groupBy("id", "y").agg(F.min("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                x = features(texts_of(part.column("text"))).astype(np.uint32)
                rows = [np.stack([np.flatnonzero(r), r[r > 0]]).astype("<u4").tobytes() for r in x]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), pa.array(rows, pa.binary())], names=["id", "y", "x"])

    rows = {r["id"]: r for r in found.select("id", "y", "text").mapInArrow(count, found.select("id", "y").schema.add("x", "binary")).collect()}
    counts = np.zeros((len(rows), FEATURES), np.float32)
    ids = sorted(rows)
    for i, key in enumerate(ids):
        where, how = np.frombuffer(rows[key]["x"], "<u4").reshape(2, -1)
        counts[i, where] = how
    return fit(counts, np.array([rows[key]["y"] for key in ids]), prior)


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns of every row with score (0 to 1) and predicted (1 from ACCEPT on).

    Null and empty texts, and any text under three bytes, have the prior as their score.  Repeated rows get equal scores.
    An empty table gives no rows; with no labelled row every score is the prior, 0.5 without any.  Columns outside keep do
    not matter; keep can't hold score or predicted.  One pass over the scan, no shuffle.
    """
    slim = docs.select(*(F.col(k) for k in keep), F.col(text).alias("__text"))
    schema = slim.drop("__text").schema.add("score", "double").add("predicted", "integer")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                s = scores(own, features(texts_of(part.column(part.num_columns - 1))))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(s, pa.float64()), pa.array((s >= ACCEPT).astype(np.int32), pa.int32())], names=schema.names)

    return slim.mapInArrow(run, schema)


def reject_poor(docs: DataFrame, labels: DataFrame, *, learn: Column) -> DataFrame:
    """docs without the rows that the classifier rejects; their columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, learn=learn))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                yield part.filter(pa.array(scores(shared.value, features(texts_of(part.column(at)))) >= ACCEPT))

    return docs.mapInArrow(run, docs.schema)
