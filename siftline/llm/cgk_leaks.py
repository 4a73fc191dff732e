"""Benchmark passages in documents, by CGK embedding, bit-sampling LSH and exact edit verification.

Symbols are words without punctuation, in lower case.  A CGK random walk reads a window from its start; at step t it puts
out the symbol at hand, and moves on if a random bit of (t, symbol) says so.  Two windows within a few edits of each other
soon walk in step again, so their outputs are near in Hamming distance.  Sampled places of the outputs are LSH keys; each
repetition has a walk and a sample of its own.  Windows that share a key with an item are verified by edit distance.

An item of n words is found if a passage is within d = n // 5 edits; one of under five words, word for word.  Cut into
d + 1 pieces, an item then keeps one piece whole: only windows around such a piece are embedded, which loses none within
reach.  Of a text and an item that have met, all places of whole pieces are then compared by edit distance, so what is
reported is their nearest passage.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.bytewords import MARKS, Words, mix, pair, slices, texts_of, words_of

#: An item's words for each edit allowed, repetitions, and sampled places in each.
WORDS_PER_EDIT, REPETITIONS, PLACES = 5, 40, 3
#: Fewest words of an item that makes a document go: shorter ones are phrases of the language.
LEAST_WORDS = 5
#: Items' bytes that one broadcast may hold; more are taken in blocks, a pass over the documents each.
BLOCK_BYTES = 16 << 20
#: Windows embedded at once.
WINDOWS = 1 << 17
_PAD = np.uint64(0x5851F42D4C957F2D)


def _words(column: pa.Array) -> Words:
    return words_of(texts_of(pc.utf8_lower(column.cast(pa.large_string()))), MARKS)


def _rolling(h: np.ndarray, n: int) -> np.ndarray:
    out = h[: max(0, len(h) - n + 1)]
    for k in range(1, n):
        out = pair(out, h[k : k + len(out)])
    return out


@dataclass
class Items:
    """Items of one block with their seeds and LSH keys; plain arrays, so that it can be broadcast."""

    ids: list
    words: list[np.ndarray]
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)
    places: np.ndarray = None
    keys: np.ndarray = None

    def __post_init__(self):
        self.n = np.array([len(w) for w in self.words], np.int64)
        self.d = self.n // WORDS_PER_EDIT
        found: dict[int, list] = {}
        for i, w in enumerate(self.words):
            cuts = np.linspace(0, len(w), int(self.d[i]) + 2).astype(int)
            for a, b in zip(cuts[:-1], cuts[1:]):
                found.setdefault(int(b - a), []).append((int(_rolling(w[a:b], int(b - a))[0]), i, int(a)))
        for size, rows in found.items():
            h = np.array([r[0] for r in rows], np.uint64)
            order = np.argsort(h, kind="stable")
            self.seeds[size] = (h[order], np.array([r[1] for r in rows])[order], np.array([r[2] for r in rows])[order])
        rng = np.random.default_rng(5)
        # Places early in a walk suffer from fewer edits, so half of the repetitions sample the first third.
        spread = np.where(np.arange(REPETITIONS) % 2, 3.0, 1.0)[:, None]
        self.places = np.sort((rng.random((len(self.ids), REPETITIONS, PLACES)) * spread * self.n[:, None, None]).astype(np.int64), axis=2)
        self.keys = np.empty((REPETITIONS, len(self.ids)), np.uint64)
        if self.ids:
            flat, first = np.concatenate(self.words), np.concatenate([[0], np.cumsum(self.n)])
            for r in range(REPETITIONS):
                self.keys[r] = self.embedded(flat, first[:-1], first[1:], np.arange(len(self.ids)), r)

    def embedded(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, item: np.ndarray, r: int) -> np.ndarray:
        """LSH keys in repetition r of windows words[starts:starts + n of their item], cut at ends."""
        ends = np.minimum(ends, starts + self.n[item])
        at, key, places = starts.copy(), np.zeros(len(starts), np.uint64), self.places[item, r]
        for t in range(int(places[:, -1].max(initial=-1)) + 1):
            symbol = np.where(at < ends, words[np.minimum(at, len(words) - 1)], _PAD)
            for p in range(PLACES):
                hit = places[:, p] == t
                if hit.any():
                    key[hit] = pair(key[hit], symbol[hit])
            at += (mix(symbol + np.uint64((r * 4099 + t) * 0x9E3779B97F4A7C15 % (1 << 64))) & np.uint64(1)).astype(np.int64)
        return key


def edits(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance of the item to any run of the text's words, and where the first such run ends."""
    n = len(item)
    steps = np.arange(n + 1)
    column = steps.copy()
    best, end = n, 0
    for j, w in enumerate(text):
        moved = np.empty(n + 1, np.int64)
        moved[0] = 0
        moved[1:] = np.minimum(column[:-1] + (item != w), column[1:] + 1)
        column = np.minimum.accumulate(moved - steps) + steps
        if column[n] < best:
            best, end = int(column[n]), j + 1
    return best, end


def nearest(items: Items, words: Words, text: int, item: int, starts: np.ndarray) -> tuple[int, int]:
    """(edits, end) of the passage nearest to an item around the starts that its whole pieces give, the first one of equals."""
    d, n = int(items.d[item]), int(items.n[item])
    low, high = int(words.first[text]), int(words.first[text + 1])
    best, end = n, 0
    starts = np.sort(starts)
    new = np.flatnonzero(np.concatenate([[True], np.diff(starts) > n + 2 * d]))
    for a, b in zip(new.tolist(), [*new[1:].tolist(), len(starts)]):  # starts whose reaches overlap are one stretch
        begin = max(low, int(starts[a]) - d)
        got, stop = edits(items.words[item], words.hashes[begin : min(high, int(starts[b - 1]) + n + d)])
        if got < best:
            best, end = got, begin + stop
    return best, end


def leaks(items: Items, words: Words) -> list[tuple[int, int, int, int]]:
    """(text, item, edits, word at which the passage ends) of a batch; the nearest passage of each text and item."""
    h, owner = words.hashes, words.owner()
    found = []
    for size, (seed, item, offset) in items.seeds.items():
        rolled = _rolling(h, size)
        if not len(rolled):
            continue
        low = np.searchsorted(seed, rolled)
        at = np.flatnonzero(seed[np.minimum(low, len(seed) - 1)] == rolled)
        at = at[owner[at] == owner[at + size - 1]]
        low, high = low[at], np.searchsorted(seed, rolled[at], "right")
        many = high - low
        which = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        found.append(np.stack([np.repeat(owner[at], many), item[which], np.repeat(at, many) - offset[which]], 1))
    if not found:
        return []
    hits = np.unique(np.concatenate(found), axis=0)
    # The pairs of text and item in order, and which hits are theirs.
    begin = np.flatnonzero(np.concatenate([[True], (hits[1:, :2] != hits[:-1, :2]).any(1)]))
    stop = np.append(begin[1:], len(hits))
    pair_of = np.repeat(np.arange(len(begin)), stop - begin)
    met: dict[int, tuple[int, int]] = {}
    for lo in range(0, len(hits), 1 << 13):
        block = hits[lo : lo + (1 << 13)]
        reach = items.d[block[:, 1]]
        wide = 2 * reach + 1
        shift = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide) - np.repeat(reach, wide)
        windows = np.repeat(np.column_stack([block, pair_of[lo : lo + len(block)]]), wide, axis=0)
        windows[:, 2] += shift
        first, last = words.first[windows[:, 0]], words.first[windows[:, 0] + 1]
        windows[:, 2] = np.clip(windows[:, 2], first, last - 1)
        windows = np.unique(windows, axis=0)
        for w in range(0, len(windows), WINDOWS):
            part = windows[w : w + WINDOWS]
            for r in range(REPETITIONS):
                part = part[~np.isin(part[:, 3], list(met))] if met else part
                if not len(part):
                    break
                same = items.embedded(h, part[:, 2], words.first[part[:, 0] + 1], part[:, 1], r) == items.keys[r, part[:, 1]]
                near, part = part[same], part[~same]
                for text, item, start, k in near[np.unique(near[:, [0, 1, 3]], axis=0, return_index=True)[1]].tolist():
                    d, n = int(items.d[item]), int(items.n[item])
                    low = max(int(words.first[text]), start - d)
                    if k not in met and edits(items.words[item], h[low : min(int(words.first[text + 1]), start + n + d)])[0] <= d:
                        met[k] = nearest(items, words, text, item, hits[begin[k] : stop[k], 2])
    return [(int(hits[begin[k], 0]), int(hits[begin[k], 1]), best, end - int(words.first[hits[begin[k], 0]])) for k, (best, end) in sorted(met.items())]


def blocks(items: DataFrame, least_words: int, identifier: str = "item_id", text: str = "text") -> Iterator[Items]:
    """The items of so many words or more in blocks of about BLOCK_BYTES, one at a time; null and empty ones are left out."""
    rows = items.select(F.col(identifier).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + total // BLOCK_BYTES
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == b)
        got = sorted(part.distinct().collect(), key=lambda r: (r["id"] is None, r["id"], r["text"]))
        words = _words(pa.array([r["text"] for r in got], pa.string()))
        each = [words.hashes[words.first[i] : words.first[i + 1]] for i in range(len(got))]
        keep = [i for i in range(len(got)) if len(each[i]) >= max(1, least_words)]
        if keep:
            yield Items([got[i]["id"] for i in keep], [each[i] for i in keep])


def find(docs: DataFrame, items: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each row of docs and item it holds: keep columns, item_id, edits, item_words, end_word.

    Items of any length are found, so a common word among them is found everywhere; item_words tells them apart.  Words are
    cut at marks and white space: an item without any, as in scripts that have no spaces, is one word.  end_word counts the text's words up to the passage's end.  Null and empty texts hold nothing; repeated rows give rows
    each; ties between passages go to the first.  Columns outside keep do not matter; keep can't hold the new names.
    """
    spark = docs.sparkSession
    slim = docs.select(*(F.col(k) for k in keep), F.col(text).alias("__text"))
    item_type = items.schema["item_id"].dataType
    schema = slim.drop("__text").schema.add("item_id", item_type).add("edits", "integer").add("item_words", "integer").add("end_word", "long")
    out = spark.createDataFrame([], schema)
    for block in blocks(items, 1):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                for part in slices(batch, batch.num_columns - 1):
                    rows = leaks(own, _words(part.column(part.num_columns - 1)))
                    take = pa.array([r[0] for r in rows], pa.int64())
                    new = [pa.array([own.ids[r[1]] for r in rows]), pa.array([r[2] for r in rows], pa.int32()), pa.array([int(own.n[r[1]]) for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int64())]
                    if rows:
                        yield pa.RecordBatch.from_arrays([*(c.take(take) for c in part.columns[:-1]), *new], names=schema.names)

        out = out.unionByName(slim.mapInArrow(run, schema))
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """docs without the rows that hold an item of least_words or more; what stays is unchanged, null and empty texts included."""
    spark, schema, at = docs.sparkSession, docs.schema, docs.columns.index(text)
    for block in blocks(items, least_words):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, at):
                    clean = np.ones(part.num_rows, bool)
                    clean[[r[0] for r in leaks(shared.value, _words(part.column(at)))]] = False
                    yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(run, schema)
    return docs
