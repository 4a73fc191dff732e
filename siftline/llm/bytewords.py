"""Vectorised word splitting and hashing over the UTF-8 bytes of an Arrow batch.

A word is a maximal run of bytes outside space and 0x09-0x0D; A-Z count as a-z.  Everything here works on whole
batches of texts as one byte array, so a task spends its time in numpy and not in a Python loop over words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Longer spans are hashed one by one.
_SHORT = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An order-sensitive hash of two hashes."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + mix(b + np.uint64(0x632BE59BD9B4E019)))


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as one number, without a copy for each; past the end there are zeros."""
    return np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of data[starts:ends] in two independent halves of 64 bits; equal bytes have equal hashes at any place.

    Every block of eight bytes goes through a mixer before the next one joins, so no rule of arithmetic makes different
    spans meet.  Spans beyond _SHORT bytes take a hash function of the standard library.
    """
    size = ends - starts
    n = size.astype(np.uint64)
    out = n * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x51ED270B), n * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x2545F491)
    eights = _eights(data)
    alive = np.flatnonzero(size <= _SHORT)
    done = 0
    while len(alive):
        some = slice(None) if len(alive) == len(size) else alive
        block = eights[starts[some] + done] & _MASKS[np.minimum(size[some] - done, 8)]
        out[0][some] = mix(out[0][some] ^ block)
        out[1][some] = mix((out[1][some] + block) * np.uint64(0xD6E8FEB86659FD93))
        done += 8
        alive = alive[size[alive] > done]
    for i in np.flatnonzero(size > _SHORT).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].data, digest_size=16).digest()
        out[0][i], out[1][i] = np.frombuffer(digest, "<u8")
    return out


def order_of(a: np.ndarray, *, alike: bool = False) -> np.ndarray:
    """The order of 64-bit numbers, equal ones as they stand; alike: many of them differ in their lowest bits only.

    Plain sorting is many times faster than sorting places, so places take the lowest bits of what is sorted.  That orders
    numbers by the bits above; where it is not enough, the lower bits are sorted by first.
    """
    bits = np.uint64(max(1, len(a) - 1).bit_length())
    low, places = (np.uint64(1) << bits) - np.uint64(1), np.arange(len(a), dtype=np.uint64)
    by = lambda high: (np.sort(high | places) & low).astype(np.int64)
    if not alike:
        order = by(a & ~low)
        sorted_ = a[order]
        if (sorted_[1:] >= sorted_[:-1]).all():
            return order
    first = by((a & low) << bits)  # up to 2 ** 32 numbers
    return first[by(a[first] & ~low)]


def distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs in order, and the place of each pair among them."""
    order = order_of(a)
    for _ in range(2):
        x, y = a[order], b[order]
        alike, apart = x[1:] == x[:-1], y[1:] != y[:-1]
        if not (alike & apart).any():
            break
        order = np.lexsort((b, a))  # first halves that agree are next to none
    new = np.ones(len(a), bool)
    new[1:] = ~alike | apart
    place = np.empty(len(a), np.int64)
    place[order] = np.cumsum(new) - 1
    return x[new], y[new], place


@dataclass
class Texts:
    """The bytes of a batch of texts; text i is data[bounds[i]:bounds[i+1]]. Nulls are empty."""

    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    low = int(bounds[0]) if len(bounds) else 0
    return Texts(data[low : int(bounds[-1])], bounds - low)


@dataclass
class Words:
    """Words of a batch in order: byte spans, both halves of their hashes, and first[i]:first[i+1] as the words of text i."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    more: np.ndarray
    first: np.ndarray

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Everything in ASCII but letters and digits, for words without punctuation.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(texts: Texts, space: np.ndarray = _SPACE) -> Words:
    inside = ~space[texts.data]
    # A word also ends where its text ends.
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = texts.bounds[1:-1]
    edges = edges[edges < len(inside)]
    begins[edges] |= inside[edges]
    starts = np.flatnonzero(begins)
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    before = texts.bounds[1:] - 1
    before = before[(before >= 0) & (before < len(inside))]
    stops[before] |= inside[before]
    ends = np.flatnonzero(stops) + 1
    return Words(starts, ends, *span_hashes(_LOWER[texts.data], starts, ends), np.searchsorted(starts, texts.bounds))


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, in two halves, of every n consecutive words of one text, and the owning text of each."""
    owner = words.owner()
    if len(owner) < n:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
    upto = len(owner) - n + 1
    halves = []
    for each in (words.hashes, words.more):
        h = each[:upto]
        for k in range(1, n):
            h = pair(h, each[k : upto + k])
        halves.append(h)
    same = owner[:upto] == owner[n - 1 :]
    return halves[0][same], halves[1][same], owner[:upto][same]


def slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of one text column; a longer text has a slice to itself."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(sizes)])
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi
