"""Removal of long byte strings that occur elsewhere, with run-compressed Burrows-Wheeler indexes.

Every window of LONG bytes has an anchor, the least of its 32-byte grams by hash; equal windows have equal anchors.
Anchors that occur once in the corpus end the matter for their windows.  The others' windows go to buckets by anchor, as
strings that hold each window exactly once; a pack sends equal strings once.

Anchors with too many windows for one index are dealt out again: each of their windows goes by its own digest, and meets its
equals there.

A bucket indexes its strings, those that came more than once twice: of the Burrows-Wheeler transform of their concatenation
only the runs are kept, and at both ends of each run the text position and its match with the neighbouring suffix.  Within
a run the match of position j is one longer than that of j + 1, so the matching statistics of all positions stream out of
the samples, from the text's end to its beginning.  Windows whose match reaches LONG bytes are marked, and each pack is told
its marks.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.bytewords import Texts, mix, order_of, texts_of
from siftline.llm.packs import bucket_bounds, buckets_for, decode, encode, packs_of, squeezed, unpacked, unsqueezed
from siftline.llm.support import Scratch, written

#: Bytes of a string that counts as repeated, and of an anchor's gram, a power of two.
LONG, GRAM = 200, 32
#: Window starts whose anchors are sought at once, and bytes of strings indexed at once, whole anchors at a time.
STRETCH, INDEXED = 1 << 20, 1 << 20
#: Runs of windows beyond which an anchor is dealt out by windows: their strings would be more than INDEXED bytes.
HOT = INDEXED // (2 * LONG - GRAM)
#: Buckets of anchors for each part of an exchange; each is a group of its own, so more of them need less memory.
PER_PART = 8
#: Never a byte of UTF-8 text.
_SEPARATOR = 0xFF


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` neighbours, from running minima of blocks in both directions."""
    n = len(x)
    size = -(-n // width) * width
    padded = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def words8(data: np.ndarray, n: int) -> np.ndarray:
    """The eight bytes at each of n places as one number, first byte highest."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    return np.ndarray((n,), ">u8", padded.tobytes(), 0, (1,)).astype(np.uint64)


def anchored(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, anchor) of runs of window starts that share an anchor; each window of each text is in one run."""
    found = []
    data, bounds = texts.data, texts.bounds
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, min(len(texts), int(np.searchsorted(bounds, bounds[lo] + STRETCH, "right")) - 1))
        for a in range(int(bounds[lo]), int(bounds[hi]) - LONG + 1, STRETCH):
            b = min(a + STRETCH, int(bounds[hi]) - LONG + 1)  # window starts a..b-1
            piece = data[a : b + LONG - 1]
            n = len(piece) - GRAM + 1
            gram = words8(piece, len(piece) - 7)
            width = 8
            while width < GRAM:  # two halves make one twice as wide
                gram = gram[:-width] * np.uint64(0x9E3779B97F4A7C15) + gram[width:] * np.uint64(0xC2B2AE3D27D4EB4F)
                gram ^= gram >> np.uint64(31)
                width *= 2
            gram *= np.uint64(0xBF58476D1CE4E5B9)
            gram ^= gram >> np.uint64(29)
            gram *= np.uint64(0x94D049BB133111EB)
            least = _sliding_least((gram & np.uint64(0xFFFFFFFF << 32)) | np.arange(n, dtype=np.uint64), LONG - GRAM + 1)
            at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
            whole = np.ones(b - a, bool)
            at_end = bounds[1:][(bounds[1:] > a) & (bounds[1:] < b + LONG)].tolist()
            for end in at_end:  # windows that begin here would reach beyond their text
                whole[max(0, end - LONG + 1 - a) : end - a] = False
            new = np.ones(b - a, bool)
            new[1:] = (at[1:] != at[:-1]) | ~whole[:-1]
            new &= whole
            first = np.flatnonzero(new)
            if len(first):
                # A run ends before the next begins, or where windows cease to be whole.
                total = np.cumsum(whole)
                ends = np.concatenate([first[1:], [b - a]])
                last = first + (total[ends - 1] - total[first])
                # The least hashes are low ones: mixed again, they fill all buckets evenly.
                found.append((first + a, last + a, mix(gram[at[first]])))
        lo = hi
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(np.concatenate([x[k] for x in found]) for k in range(3))


def distinct_strings(texts: Texts, first: np.ndarray, last: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(representative run of each distinct string, string of each run, runs of each string), strings by anchor."""
    number: dict[bytes, int] = {}
    label = np.fromiter((number.setdefault(texts.data[a : b + LONG].tobytes(), len(number)) for a, b in zip(first, last)), np.int64, len(first))
    del number
    _, at, count = np.unique(label, return_index=True, return_counts=True)
    order = order_of(anchor[at])
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return at[order], place[label], count[order]


def hot_windows(texts: Texts, first: np.ndarray, last: np.ndarray, at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct digests in order, as pairs of numbers; digest of each window of each string; windows of each digest)."""
    if not len(at):
        return np.empty((0, 2), np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    data, out = memoryview(texts.data.tobytes()), []
    for i in at.tolist():
        out += [hashlib.blake2b(data[a : a + LONG], digest_size=16).digest() for a in range(int(first[i]), int(last[i]) + 1)]
    pairs = np.frombuffer(b"".join(out), ">u8").astype(np.uint64).reshape(-1, 2)
    keys, place = distinct_pairs(pairs)
    return keys, place, np.bincount(place, weights=np.repeat(count, last[at] - first[at] + 1), minlength=len(keys)).astype(np.int64)


def distinct_pairs(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct pairs in order, place of each pair among them)."""
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (pairs[order[1:]] != pairs[order[:-1]]).any(1)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return pairs[order[new]], place


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, rank of each), as if every separator were a sign of its own, ordered by place."""
    n = len(text)
    key = words8(text, n)
    near = np.zeros(n, bool)  # a separator within the first eight bytes: no other suffix begins alike
    for k in range(8):
        cut = np.flatnonzero(text[k:] == _SEPARATOR)
        near[cut] = True
        key[cut] &= np.uint64((1 << 64) - (1 << (56 - 8 * k)))
    order = order_of(key, alike=True)
    sorted_ = key[order]
    new = np.ones(n, bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    new |= near[order]
    # A rank is the place at which a group of suffixes that begin alike starts; only such groups are sorted further.
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[n] = -1
    last = np.ones(n, bool)
    last[:-1] = new[1:]
    open_ = np.flatnonzero(~(new & last))
    # A round sorts by as many stretches of `depth` bytes as ranks fit into 63 bits.
    depth, bits = 8, int(n + 1).bit_length()
    stretches = max(2, min(4, 63 // bits))
    while len(open_):
        mine = order[open_]
        key = rank[mine]
        for k in range(1, stretches):
            key = key << bits | (rank[np.minimum(mine + k * depth, n)] + 1)
        by = np.argsort(key)
        key, mine = key[by], mine[by]
        order[open_] = mine
        new = np.ones(len(open_), bool)
        new[1:] = key[1:] != key[:-1]
        rank[mine] = open_[np.maximum.accumulate(np.where(new, np.arange(len(open_)), 0))]
        last = np.ones(len(open_), bool)
        last[:-1] = new[1:]
        open_ = open_[~(new & last)]
        depth *= stretches
    return order, rank[:n]


def _matched(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes, up to LONG, that the suffixes at a and b have in common; words has the eight bytes at each place."""
    out = np.full(len(a), LONG, np.int64)
    alive = np.arange(len(a))
    for step in range(0, LONG, 8):
        differ = words[a[alive] + step] ^ words[b[alive] + step]
        apart = differ != 0
        stop = differ[apart]
        agree = np.zeros(len(stop), np.int64)
        for k in range(1, 8):
            agree += stop < np.uint64(1 << (64 - 8 * k))
        out[alive[apart]] = step + agree
        alive = alive[~apart]
    return np.minimum(out, LONG)


@dataclass
class RunIndex:
    """A text's Burrows-Wheeler transform by runs: the sign and length of each, and for both ends of every run the text
    position that it stands for, in order, and the match there with the neighbouring suffix outside the run."""

    signs: np.ndarray
    lengths: np.ndarray
    heads: tuple[np.ndarray, np.ndarray]
    tails: tuple[np.ndarray, np.ndarray]

    @classmethod
    def of(cls, text: np.ndarray) -> RunIndex:
        n = len(text)
        order, place = suffix_order(text)
        bwt = text[order - 1]
        # Separators are signs of their own, so none is in a run with another.
        change = np.flatnonzero((bwt[1:] != bwt[:-1]) | (bwt[1:] == _SEPARATOR)) + 1
        begin = np.concatenate([[0], change])
        ends = np.flatnonzero(text == _SEPARATOR)
        words = words8(np.concatenate([text, np.zeros(LONG + 16, np.uint8)]), n + LONG + 8)
        sampled = []
        for side, at in ((-1, begin), (1, np.append(change, n) - 1)):
            here = np.zeros(n, bool)
            here[order[at] - 1] = here[n - 1] = True
            j = np.flatnonzero(here)
            beside = place[j] + side
            inside = (beside >= 0) & (beside < n)
            match = np.zeros(len(j), np.int64)
            match[inside] = np.minimum(_matched(words, j[inside], order[beside[inside]]), ends[np.searchsorted(ends, j[inside])] - j[inside])
            sampled.append((j, match))
        return cls(bwt[begin], np.diff(np.append(begin, n)), *sampled)

    def text(self) -> np.ndarray:
        """The text again, from the runs alone; for texts with one separator, at the end."""
        bwt = np.repeat(self.signs, self.lengths)
        step = np.empty(len(bwt), np.int64)
        step[np.argsort(bwt, kind="stable")] = np.arange(len(bwt))
        out, at = [_SEPARATOR], len(bwt) - 1  # the separator's suffix comes last
        for _ in range(len(bwt) - 1):
            out.append(bwt[at])
            at = step[at]
        return np.array(out[::-1], np.uint8)

    def stream(self) -> np.ndarray:
        """For each position the longest match, exact below LONG, with another suffix; matches end at separators.  From each
        sample towards the text's beginning a match is one byte longer at each step."""
        places = np.arange(int(self.lengths.sum()))
        out = np.zeros(len(places), np.int64)
        for j, match in (self.heads, self.tails):
            next_ = np.repeat(np.arange(len(j)), np.diff(j, prepend=-1))
            out = np.maximum(out, match[next_] + (j[next_] - places))
        return out


def marks_of(strings: list[bytes], counts: np.ndarray) -> list[np.ndarray]:
    """For each distinct string, which of its windows occur more than once among all strings as often as counted."""
    again = [s for s, c in zip(strings, counts.tolist()) if c > 1]
    size = np.array([len(s) for s in strings])
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.frombuffer(b"\xff".join(strings + again) + b"\xff", np.uint8)
    long = RunIndex.of(text).stream() >= LONG
    return [long[a : a + n - LONG + 1] for a, n in zip(begin[:-1].tolist(), size.tolist())]


def _rows(table: pa.Table) -> tuple[pa.Table, Texts]:
    return table, texts_of(table.column("text").combine_chunks())


def _found(table: pa.Table) -> pa.RecordBatch:
    """The runs of windows of a pack."""
    first, last, anchor = anchored(_rows(table)[1])
    return pa.RecordBatch.from_arrays([pa.array(first.astype(np.int32)), pa.array((last - first).astype(np.int16)), pa.array(anchor)], names=["first", "more", "anchor"])


def _runs(extra: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first, more, anchor = (np.asarray(c.combine_chunks()) for c in unpacked(extra).columns)
    return first.astype(np.int64), first.astype(np.int64) + more, anchor


def _flags(replies: pa.Table, column: str) -> np.ndarray:
    """The answers of all buckets in one column, in the order of the questions."""
    some = replies.filter(pa.compute.is_valid(replies.column(column))).select(["bucket", column])
    rows = sorted(some.to_pylist(), key=lambda r: r["bucket"])
    return np.concatenate([np.unpackbits(np.frombuffer(pa.decompress(r[column][8:], -(-n // 8), codec="zstd", asbytes=True), np.uint8))[:n] for r in rows if (n := int.from_bytes(r[column][:8], "little"))] or [np.empty(0, np.uint8)])


def _flagged(bits: np.ndarray) -> bytes:
    return len(bits).to_bytes(8, "little") + pa.compress(np.packbits(bits).tobytes(), codec="zstd", asbytes=True)


def _shared(replies: pa.Table, n: int) -> np.ndarray:
    """Of each anchor of a pack: 0 if it occurs once, 2 if it is dealt out by windows, else 1."""
    rows = sorted(replies.to_pylist(), key=lambda r: r["bucket"])
    got = np.concatenate([unsqueezed(r["many"]) for r in rows] or [np.empty(0, "<u4")])
    if len(got) != n:
        raise RuntimeError(f"{n} anchors asked for, {len(got)} answered")
    return got


def remove_repeats(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_text: bool = False, hot: int = HOT) -> DataFrame:
    """keep columns of every row with n_bytes, n_removed, n_spans, kept_sha256, and kept, what is left, if with_text.

    A byte goes if a string of LONG bytes around it also starts anywhere else in any text; texts are judged as they came,
    so all copies go.  Null and empty texts have 0 bytes; shorter texts than LONG lose nothing; repeated rows repeat each
    other.  What is left of cut characters is replaced in kept, as it needn't be valid UTF-8.  Columns outside keep do not
    matter; keep can't hold the new names.  Anchors of more than hot runs are dealt out by windows; the result is the same.
    """
    slim = docs.select(*(F.col(k) for k in keep), F.col(text).alias("text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    packs = packs_of(slim, extra=_found).drop("grp")

    buckets = buckets_for(packs, PER_PART)

    def ask(batches):
        for batch in batches:
            for pack, extra in zip(batch.column("pack").to_pylist(), batch.column("extra").to_pylist()):
                _, _, anchor = _runs(extra)
                keys, count = np.unique(anchor, return_counts=True)
                at = bucket_bounds(keys, buckets)
                out = [(b, pack, encode(keys[at[b] : at[b + 1]]), squeezed(count[at[b] : at[b + 1]])) for b in range(buckets) if at[b] < at[b + 1]]
                yield pa.RecordBatch.from_pylist([dict(zip(asked.names, r)) for r in out], schema=asked)

    asked = pa.schema([("bucket", pa.int32()), ("pack", pa.int64()), ("keys", pa.binary()), ("own", pa.binary())])

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = [decode(r["keys"]) for r in rows]
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([unsqueezed(r["own"]) for r in rows]))
        many, lo, out = np.where(total > hot, 2, total > 1)[at], 0, []
        for r, mine in zip(rows, keys):
            out.append({"pack": r["pack"], "bucket": r["bucket"], "many": squeezed(many[lo : lo + len(mine)])})
            lo += len(mine)
        return pa.Table.from_pylist(out, schema=pa.schema([("pack", pa.int64()), ("bucket", pa.int32()), ("many", pa.binary())]))

    asks = packs.select("pack", "extra").mapInArrow(ask, "bucket int, pack long, keys binary, own binary")
    scratch = Scratch(docs.sparkSession)
    shared = scratch.write(asks.groupBy("bucket").applyInArrow(answer, "pack long, bucket int, many binary"), "anchors")

    def repeated(rows: bytes, extra: bytes, replies: pa.Table):
        """The pack's runs of windows whose anchors occur more than once, and their distinct strings: of common and of hot anchors."""
        table, texts = _rows(unpacked(rows))
        first, last, anchor = _runs(extra)
        keys, at = np.unique(anchor, return_inverse=True)
        many = _shared(replies, len(keys))[at]
        found = []
        for kind in (1, 2):
            of = many == kind
            runs = first[of], last[of], anchor[of]
            found.append((*runs, *distinct_strings(texts, *runs)))
        return table, texts, *found

    def cut(mine: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        for pack, rows, extra in zip(*(mine.column(c).to_pylist() for c in ("pack", "rows", "extra"))):
            _, texts, (first, last, anchor, at, _, count), common = repeated(rows, extra, replies)
            bounds = bucket_bounds(anchor[at], buckets)
            for b in range(buckets):
                some = at[bounds[b] : bounds[b + 1]]
                if len(some):
                    strings = [texts.data[first[i] : last[i] + LONG].tobytes() for i in some.tolist()]
                    out.append((b, pack, squeezed(np.array([len(s) for s in strings])), pa.compress(b"".join(strings), codec="zstd", asbytes=True), anchor[some].astype("<u8").tobytes(), squeezed(np.minimum(count[bounds[b] : bounds[b + 1]], 2))))
            keys, _, count = hot_windows(texts, *common[:2], common[3], common[5])
            bounds = bucket_bounds(keys[:, 0], buckets)
            for b in range(buckets):
                some = slice(bounds[b], bounds[b + 1])
                if len(keys[some]):
                    out.append((b, pack, None, None, keys[some].astype("<u8").tobytes(), squeezed(np.minimum(count[some], 2))))
        return pa.Table.from_pylist([dict(zip(strung.names, r)) for r in out], schema=strung)

    strung = pa.schema([("bucket", pa.int32()), ("pack", pa.int64()), ("sizes", pa.binary()), ("strings", pa.binary()), ("anchors", pa.binary()), ("own", pa.binary())])

    def told(rows: list[dict]) -> list[dict]:
        """Which digests of hot anchors' windows occur more than once."""
        pairs = [np.frombuffer(r["anchors"], "<u8").reshape(-1, 2) for r in rows]
        _, at = distinct_pairs(np.concatenate(pairs))
        many = (np.bincount(at, weights=np.concatenate([unsqueezed(r["own"]) for r in rows])) > 1)[at]
        cuts = np.split(many, np.cumsum([len(p) for p in pairs])[:-1])
        return [{"pack": r["pack"], "bucket": r["bucket"], "marks": None, "windows": _flagged(bits)} for r, bits in zip(rows, cuts)]

    def index(table: pa.Table) -> pa.Table:
        digests = table.filter(pa.compute.is_null(table.column("strings"))).to_pylist()
        out = told(digests) if digests else []
        rows = table.filter(pa.compute.is_valid(table.column("strings"))).to_pylist()
        if rows:
            out += indexed(rows)
        return pa.Table.from_pylist(out, schema=pa.schema([("pack", pa.int64()), ("bucket", pa.int32()), ("marks", pa.binary()), ("windows", pa.binary())]))

    def indexed(rows: list[dict]) -> list[dict]:
        number: dict[bytes, int] = {}
        labels, own, anchors = [], [], []
        for r in rows:
            sizes = unsqueezed(r["sizes"]).astype(np.int64)
            data = pa.decompress(r["strings"], int(sizes.sum()), codec="zstd", asbytes=True)
            end = np.cumsum(sizes).tolist()
            labels.append(np.array([number.setdefault(data[b - n : b], len(number)) for b, n in zip(end, sizes.tolist())]))
            own.append(unsqueezed(r["own"]))
            anchors.append(np.frombuffer(r["anchors"], "<u8"))
        label, strings = np.concatenate(labels), list(number)
        count = np.bincount(label, weights=np.concatenate(own)).astype(np.int64)
        anchor = np.zeros(len(strings), np.uint64)
        anchor[label] = np.concatenate(anchors)
        # Whole anchors at a time, as windows of different anchors can't be equal.
        order = order_of(anchor)
        upto = np.cumsum([len(strings[i]) for i in order.tolist()])
        marks: list[np.ndarray] = [None] * len(strings)
        lo = 0
        while lo < len(order):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + INDEXED, "right")))
            while hi < len(order) and anchor[order[hi]] == anchor[order[hi - 1]]:
                hi += 1
            some = order[lo:hi]
            for i, m in zip(some.tolist(), marks_of([strings[i] for i in some.tolist()], count[some])):
                marks[i] = m
            lo = hi
        out = []
        for r, mine in zip(rows, labels):
            bits = np.concatenate([marks[i] for i in mine.tolist()])
            out.append({"pack": r["pack"], "bucket": r["bucket"], "marks": _flagged(bits), "windows": None})
        return out

    strings = packs.groupBy("pack").cogroup(shared.groupBy("pack")).applyInArrow(cut, "bucket int, pack long, sizes binary, strings binary, anchors binary, own binary")
    marked = strings.groupBy("bucket").applyInArrow(index, "pack long, bucket int, marks binary, windows binary")
    replies = shared.unionByName(marked, allowMissingColumns=True)
    replies = written(replies, "marks")
    scratch.clear()

    def finish(mine: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        many = replies.filter(pa.compute.is_valid(replies.column("many")))
        for rows, extra in zip(*(mine.column(c).to_pylist() for c in ("rows", "extra"))):
            table, texts, seldom, common = repeated(rows, extra, many)
            starts = []
            for (first, last, _, at, label, count), column in ((seldom, "marks"), (common, "windows")):
                bits, wide = _flags(replies, column), last[at] - first[at] + 1
                if column == "windows":
                    keys, place, _ = hot_windows(texts, first, last, at, count)
                    if len(keys) != len(bits):
                        raise RuntimeError(f"{len(keys)} digests asked for, {len(bits)} answered")
                    bits = bits[place]
                if wide.sum() != len(bits):
                    raise RuntimeError(f"{wide.sum()} windows asked for, {len(bits)} answered")
                begin = np.cumsum(wide) - wide
                # Every run's windows, and their marks in its string.
                n = last - first + 1
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                hit = bits[np.repeat(begin[label], n) + step] > 0
                starts.append((np.repeat(first, n) + step)[hit])
            starts = np.concatenate(starts)
            edge = np.bincount(starts, minlength=len(texts.data) + 1) - np.bincount(starts + LONG, minlength=len(texts.data) + 1)
            gone = np.cumsum(edge[:-1]) > 0 if len(texts.data) else np.zeros(0, bool)
            bounds = texts.bounds.tolist()
            removed, spans, digests, kept = [], [], [], []
            for a, b in zip(bounds[:-1], bounds[1:]):
                g = gone[a:b]
                left = texts.data[a:b][~g].tobytes()
                removed.append(b - a - len(left))
                spans.append(int((g & ~np.concatenate([[False], g[:-1]])).sum()) if b > a else 0)
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode("utf-8", "replace") if with_text else None)
            columns = {k: table.column(k) for k in keep} | {"n_bytes": pa.array(np.diff(texts.bounds), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digests)}
            out.append(pa.table(columns | ({"kept": pa.array(kept, pa.string())} if with_text else {})))
        return pa.concat_tables(out)

    done = packs.groupBy("pack").cogroup(replies.groupBy("pack")).applyInArrow(finish, f"{fields}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text)
    return done
