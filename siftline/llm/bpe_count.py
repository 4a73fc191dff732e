"""Token counts of byte-level BPE without producing identifiers.

A piece of text starts as one symbol per byte, in a doubly linked list.  A heap holds every adjacent pair with its merge
rank and place; the lowest rank, leftmost first, is popped and merged until no pair is left that has a rank.  The count
is the number of initial symbols minus the number of merges.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The split pattern of byte-level BPE files with "use_regex".
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Pieces remembered by a worker, and the longest of them: together they bound its memory.
REMEMBERED, LONGEST = 400_000, 48
_SHIFT = 32


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in such vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(shown))
    return [letters[b] for b in range(256)]


class Counter:
    """Counts tokens as the vocabulary file's library does; special strings inside texts are one token each."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.first = [vocab[x] for x in byte_letters()]
        self.rules: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.rules[vocab[a] << _SHIFT | vocab[b]] = (rank, vocab[a + b])
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pieces = regex.compile(PIECES)
        self.known: dict[str, int] = {}

    def merged(self, piece: str) -> int:
        """Tokens of one piece: its bytes minus the merges made."""
        symbols = [self.first[b] for b in piece.encode("utf-8")]
        n = left = len(symbols)
        rules = self.rules
        heap = []
        for i in range(n - 1):
            rule = rules.get(symbols[i] << _SHIFT | symbols[i + 1])
            if rule:
                heap.append((rule[0], i))
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if symbols[i] < 0 or j >= n:
                continue
            rule = rules.get(symbols[i] << _SHIFT | symbols[j])
            if rule is None or rule[0] != rank:  # an earlier merge took one of the two
                continue
            symbols[i], symbols[j] = rule[1], -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if pair := rules.get(symbols[i] << _SHIFT | symbols[k]):
                    heapq.heappush(heap, (pair[0], i))
            h = before[i]
            if h >= 0 and (pair := rules.get(symbols[h] << _SHIFT | symbols[i])):
                heapq.heappush(heap, (pair[0], h))
        return left

    def _plain(self, text: str) -> int:
        pieces, known = self.pieces.findall(text), self.known
        try:
            return sum(map(known.__getitem__, pieces))
        except KeyError:
            pass
        if len(known) > REMEMBERED:
            known.clear()
        long = 0
        for p in pieces:
            if p in known:
                long += known[p]
            elif len(p) <= LONGEST:
                long += known.setdefault(p, self.merged(p))
            else:
                long += self.merged(p)
        return long

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The worker's counter for a file, made once and kept across tasks."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns of every row with n_bytes and n_tokens of its whole text.

    Null and empty texts have 0 of both; repeated rows are counted each.  Columns of docs outside keep do not matter,
    whatever their names; keep itself can't hold n_bytes or n_tokens.  There is no shuffle: one pass over the scan.
    """
    slim = docs.select(*(F.col(k) for k in keep), F.col(text).alias("__text"))
    schema = slim.drop("__text").schema.add("n_bytes", "long").add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            tokens, sizes = [], []
            for value in texts:
                t = value.as_py()
                tokens.append(own.count(t))
                sizes.append(len(t.encode("utf-8")) if t else 0)
            columns = [*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return slim.mapInArrow(run, schema)
