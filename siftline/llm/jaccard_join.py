"""Documents linked by the Jaccard similarity of their word n-grams, exactly, and the components of those links.

Equal sets form a class, and only classes go on.  Sets of sizes that can be similar meet in a space; there, each is cut
by its n-grams' hashes into more parts than two similar sets can differ in, so that they agree in whole parts, and classes
that agree in a part become candidates.  Candidates' components are the blocks: within a block the product of the
document-by-n-gram incidence matrix with its transpose is accumulated for some documents at a time, and pairs whose
overlap is below the bound that their sizes set are discarded.

Components need a link to each member, not all links within a group: once most of a block hangs together, only documents
outside its largest component still need to be multiplied with all.  Blocks too large for a task lose the documents that can
link with none and are formed anew by their documents' rarest n-grams; those still too large are multiplied in shares of
bounded bytes, first with a few of their documents, then with all that are still outside.

Classes are told apart by 128 bits of all their n-grams.  Within a block, n-grams are compared by 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siftline.llm.bytewords import Texts, distinct, mix, pair, shingles, slices, texts_of, words_of
from siftline.llm.components import Links, components, forest
from siftline.llm.packs import bucket_bounds, decode, encode, squeezed, unsqueezed
from siftline.llm.support import Scratch, if_small, parts_of, written

#: Parts beyond those that two similar sets can differ in; parts that are empty are left out while they are no more.
SPARE = 3
#: Classes and n-grams of a block that a task may hold, and n-grams of a share of a larger one; a single set may have more.
TASK_CLASSES, TASK_GRAMS, SHARE_GRAMS = 512, 1 << 19, 1 << 21
#: Sets multiplied at once, and turns in which so many of each large block are, before all that are left take theirs.
AT_ONCE, TURNS = 64, 2
#: Cells of a product held at once, and n-grams or matches that go into them at once.
CELLS, MATCHES = 1 << 21, 1 << 20
#: Signatures that a task combines before it sends them.
HELD_SIGNS = 1 << 19
#: Bytes of texts or sets that a task works on at once.
SLICE = 2 << 20
#: Bytes of n-grams that meet in a bucket, about.
BUCKET = 32 << 20
#: Bits of an n-gram's fingerprint where only whether it occurs twice matters: a collision keeps a set, and loses none.
FINGERPRINT = 40


@dataclass(frozen=True)
class Rule:
    """N-grams of `words` words; two sets link when den * overlap >= num * union."""

    words: int
    num: int
    den: int

    def linked(self, overlap: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.num + self.den) * overlap >= self.num * (a + b)

    def largest(self, n: int) -> int:
        """Size of the largest set that can link with one of size n."""
        return n * self.den // self.num

    @lru_cache(maxsize=None)
    def spaces(self, upto: int) -> tuple[np.ndarray, np.ndarray]:
        """First sizes of bands up to a size, and the parts of the space of each band with the next; 0: no need."""
        first = [1]
        while first[-1] <= upto:
            first.append(max(first[-1] + 1, self.largest(first[-1]) + 1))
        first.append(max(first[-1] + 1, self.largest(first[-1]) + 1))
        parts = []
        for a, b in zip(first[:-1], first[1:]):
            # Of sizes s together, linked sets differ in s * (den - num) / (den + num) n-grams at most.
            differ = (b - 1 + self.largest(b - 1)) * (self.den - self.num) // (self.den + self.num)
            parts.append(differ + 1 + SPARE if differ else 0)
        return np.array(first), np.array(parts)


@dataclass
class Sets:
    """Distinct n-gram hashes of a batch, ascending within each text: text i has values[first[i]:first[i+1]]; more has the
    other halves of the hashes."""

    values: np.ndarray
    first: np.ndarray
    more: np.ndarray = None

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.first)


def sets_of(texts: Texts, n: int) -> Sets:
    """Texts of fewer than n words have one n-gram, the whole sequence; texts without words have none."""
    words = words_of(texts)
    h, m, owner = shingles(words, n)
    count = np.diff(words.first)
    for k in range(1, n):
        at = words.first[:-1][count == k]
        if len(at):
            few = [np.full(len(at), 0x1234567 * k, np.uint64) for _ in range(2)]
            for j in range(k):
                few = [pair(f, x[at + j]) for f, x in zip(few, (words.hashes, words.more))]
            h, m, owner = np.concatenate([h, few[0]]), np.concatenate([m, few[1]]), np.concatenate([owner, np.flatnonzero(count == k)])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return Sets(h, np.searchsorted(owner, np.arange(len(texts) + 1)), m[order[new]])


def _sums(cell: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2**64 of x by cell; both halves stay exact as doubles."""
    low = np.bincount(cell, weights=(x & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n).astype(np.uint64)
    high = np.bincount(cell, weights=(x >> np.uint64(32)).astype(np.float64), minlength=n).astype(np.uint64)
    return low + (high << np.uint64(32))


def classes_of(sets: Sets) -> np.ndarray:
    """Sixteen bytes for each set, the same for equal sets; the first eight name the class among candidates."""
    owner = np.repeat(np.arange(len(sets.sizes)), sets.sizes)
    out = np.empty((len(sets.sizes), 2), ">u8")
    for k, half in enumerate((sets.values, sets.more)):
        out[:, k] = mix(_sums(owner, mix(half + np.uint64(0xA24BAED4963EE407 + k)), len(sets.sizes)) + sets.sizes.astype(np.uint64))
    return out


def _bytes(classes: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(classes), [None, pa.py_buffer(classes.tobytes())]).cast(pa.binary())


def signatures(sets: Sets, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """(text, signature): texts that link but differ have one in common."""
    sizes = sets.sizes
    first, parts = rule.spaces(int(sizes.max(initial=1)))
    band = np.searchsorted(first, sizes, "right") - 1
    texts, found = [], []
    for lower in (0, 1):
        space = band - lower
        m = np.where((space >= 0) & (sizes > 0), parts[np.maximum(space, 0)], 0)
        begin = np.concatenate([[0], np.cumsum(m)])
        owner = np.repeat(np.arange(len(sizes)), np.where(m > 0, sizes, 0))
        x = sets.values[np.repeat(m > 0, sizes)]
        part = (mix(x + np.uint64(77)) >> np.uint64(33)) * m[owner].astype(np.uint64) >> np.uint64(31)
        cell = begin[owner] + part.astype(np.int64)
        sums, filled = _sums(cell, mix(x + np.uint64(1999)), int(begin[-1])), np.bincount(cell, minlength=int(begin[-1])) > 0
        whose = np.repeat(np.arange(len(sizes)), m)
        empty = np.bincount(whose[~filled], minlength=len(sizes))
        use = filled | (empty > SPARE)[whose]
        label = (np.repeat(space, m) * 1_000_003 + np.arange(int(begin[-1])) - np.repeat(begin[:-1], m)).astype(np.uint64)
        texts.append(whose[use])
        found.append(pair(sums[use], label[use]))
    return np.concatenate(texts), np.concatenate(found)


def overlaps(values: np.ndarray, first: np.ndarray, pivots: list[np.ndarray]) -> np.ndarray:
    """Sparse product: for each pivot set (column) and each set values[first[i]:first[i+1]] (row), n-grams in common."""
    n, columns = len(pivots), np.concatenate(pivots)
    order = np.argsort(columns, kind="stable")
    columns, whose = columns[order], np.repeat(np.arange(n), [len(p) for p in pivots])[order]
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = np.zeros((len(first) - 1) * n, np.int64)
    for lo in range(0, len(values), MATCHES):
        some = values[lo : lo + MATCHES]
        begin = np.searchsorted(columns, some)
        hit = np.flatnonzero(columns[np.minimum(begin, len(columns) - 1)] == some)
        begin, many = begin[hit], np.searchsorted(columns, some[hit], "right") - begin[hit]
        upto = np.cumsum(many)
        a = 0
        while a < len(hit):  # as many rows of matches as fit, one at least
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + MATCHES, "right")))
            m = many[a:b]
            at = np.repeat(begin[a:b] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            cell = np.repeat(row[lo + hit[a:b]], m) * n + whose[at]
            low, high = int(row[lo + hit[a]]) * n, (int(row[lo + hit[b - 1]]) + 1) * n
            out[low:high] += np.bincount(cell - low, minlength=high - low)
            a = b
    return out.reshape(-1, n)


class Forest:
    """Disjoint sets of 0..n-1, the least member being the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)

    def roots(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.up))])


def block_components(sets: list[np.ndarray], rule: Rule) -> np.ndarray:
    """Roots of the components of a block that one task holds."""
    sizes = np.array([len(s) for s in sets])
    first, values = np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(sets)
    forest, done = Forest(len(sets)), np.zeros(len(sets), bool)
    # The sets whose n-grams are most common in the block come first: their links tend to reach most others.
    _, back, count = np.unique(values, return_inverse=True, return_counts=True)
    common = np.bincount(np.repeat(np.arange(len(sets)), sizes), weights=count[back], minlength=len(sets)) / np.maximum(sizes, 1)
    turn = np.argsort(-common, kind="stable")
    at_once = 4
    while True:
        roots = forest.roots()
        largest = np.bincount(roots).argmax()
        next_ = [i for i in turn.tolist() if not done[i] and (roots[i] != largest or len(sets) == 1 or not done.any())][:at_once]
        if not next_:
            return roots
        done[next_] = True
        both = rule.linked(overlaps(values, first, [sets[i] for i in next_]), sizes[:, None], sizes[next_][None, :])
        for i, j in zip(*np.nonzero(both)):
            forest.join(int(i), next_[int(j)])
        at_once = min(8 * at_once, max(AT_ONCE, CELLS // len(sets)))


def _joinable(sets: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """sets (block, cls, grams) without those that can link with no other of their block.

    To link, num / den of a set's n-grams must be in another set.  Sets send their fingerprints to buckets, which count
    for each set how many of its own occur in another set of the block.
    """
    held = sets.agg(F.sum(F.octet_length("grams"))).first()[0] or 0
    buckets, shards = max(4 * parts_of(sets.sparkSession), held // BUCKET), parts_of(sets.sparkSession)
    cut = np.uint64(64 - FINGERPRINT)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, SLICE):
                grams = texts_of(part.column(2))
                sizes = np.diff(grams.bounds) // 8
                values = np.frombuffer(grams.data.tobytes(), "<u8")
                owner = np.repeat(np.arange(len(sizes)), sizes)
                block = np.asarray(part.column(0)).view(np.uint64)
                keys = pair(values, block[owner]) >> cut
                order = np.argsort(keys, kind="stable")
                keys, owner = keys[order], owner[order].astype("<u4")
                node = np.array([int.from_bytes(c[:8], "big", signed=True) for c in part.column(1).to_pylist()], "<i8")
                at = bucket_bounds(keys << cut, buckets)
                out = []
                for b in np.flatnonzero(np.diff(at)).tolist():
                    some = slice(at[b], at[b + 1])
                    whose, which = np.unique(owner[some], return_inverse=True)
                    out.append((b, encode(keys[some]), squeezed(which), node[whose].tobytes()))  # only nodes that have a key here
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), *(pa.array([r[k] for r in out], pa.binary()) for k in (1, 2, 3))], names=["bucket", "keys", "owners", "nodes"])

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = [decode(r["keys"]) for r in rows]
        nodes = [np.frombuffer(r["nodes"], "<i8")[unsqueezed(r["owners"])] for r in rows]
        keys, nodes = np.concatenate(keys), np.concatenate(nodes)
        _, at = np.unique(keys, return_inverse=True)
        many = np.bincount(at)[at] > 1
        node, n = np.unique(nodes[many], return_counts=True)
        # Nodes are hashes: their ranges are shards, and a bucket has a row for each.
        cuts = np.searchsorted(node.astype(np.float64), np.linspace(-(2.0**63), 2.0**63, shards + 1)[1:-1])
        out = [(k, x.tobytes(), squeezed(y)) for k, (x, y) in enumerate(zip(np.split(node, cuts), np.split(n, cuts))) if len(x)]
        return pa.table([pa.array([r[0] for r in out], pa.int32()), *(pa.array([r[k] for r in out], pa.binary()) for k in (1, 2))], names=["shard", "nodes", "counts"])

    def added(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        node, at = np.unique(np.concatenate([np.frombuffer(r["nodes"], "<i8") for r in rows]), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([unsqueezed(r["counts"]) for r in rows])).astype(np.int64)
        return pa.table({"node": pa.array(node, pa.int64()), "n": pa.array(n, pa.int64())})

    asks = sets.select("block", "cls", "grams").mapInArrow(ask, "bucket int, keys binary, owners binary, nodes binary")
    found = asks.groupBy("bucket").applyInArrow(answer, "shard int, nodes binary, counts binary").groupBy("shard").applyInArrow(added, "node long, n long")
    enough = F.col("n") * rule.den >= F.octet_length("grams") / 8 * rule.num
    return sets.withColumn("node", _node()).join(if_small(scratch.write(found, "found")), "node").where(enough).select("block", "cls", "grams")


def _node() -> Column:
    """The name of a class among candidates: its first eight bytes."""
    return F.conv(F.hex(F.substring("cls", 1, 8)), 16, -10).cast("long")


def _combined(sig: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    """(key, node, least) rows: of each signature at hand its least node, with the signature as key, and links that connect
    all nodes that share one here, with the node as key."""
    order = np.lexsort((node, sig))
    s, x = sig[order], node[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    low = x[np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))]
    u, v = forest(x[x != low], low[x != low])
    least = pa.array(np.concatenate([np.zeros(int(new.sum()), np.int64), v]), mask=np.arange(int(new.sum()) + len(u)) < new.sum())
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([s[new], u])), pa.array(np.concatenate([x[new], u])), least], names=["key", "node", "least"])


def _combining(signed: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Signatures and nodes as they come, combined HELD_SIGNS at a time: a signature that very many nodes share is sent once
    each time."""
    held, n = [], 0
    for sig, node in signed:
        held.append((sig.view(np.int64), node.view(np.int64)))
        n += len(sig)
        if n >= HELD_SIGNS:
            yield _combined(*(np.concatenate([h[k] for h in held]) for k in range(2)))
            held, n = [], 0
    if n:
        yield _combined(*(np.concatenate([h[k] for h in held]) for k in range(2)))


def _blocks(signs: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, block) of nodes that share a signature with another, from rows of _combining."""

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by key and node: nodes with a signature in common, as stars, and the links that came."""
        sig, least, links = None, None, Links()
        out = lambda x: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in x], names=["u", "v"])
        for batch in batches:
            linked = np.asarray(batch.column("least").is_valid())
            came = batch.filter(pa.array(linked))
            yield from map(out, links.add(np.asarray(came.column("node")), np.asarray(came.column("least"))))
            s, x = (np.asarray(batch.column(k))[~linked] for k in range(2))
            if not len(s):
                continue
            new = np.ones(len(s), bool)
            new[1:] = s[1:] != s[:-1]
            start = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
            low = x[start]
            if s[0] == sig:
                low[: int(np.argmax(new[1:])) + 1 if new[1:].any() else len(s)] = least
            sig, least = s[-1], low[-1]
            yield from map(out, links.add(x[x != low], low[x != low]))
        yield out(links.flat())

    signs = signs.repartition(parts_of(signs.sparkSession), "key").sortWithinPartitions("key", "node")
    return scratch.write(components(signs.mapInArrow(stars, "u long, v long"), scratch).select(F.col("id").alias("node"), F.col("root").alias("block")), "candidates")


def _sized(names: DataFrame, scratch: Scratch) -> DataFrame:
    """names (block, n) of classes in blocks of more than one, with large: more than a task may hold."""
    per = names.groupBy("block").agg(F.count("*").alias("__all"), F.sum("n").alias("__grams")).where("__all > 1")
    per = if_small(scratch.write(per.select("block", ((F.col("__all") > TASK_CLASSES) | (F.col("__grams") > TASK_GRAMS)).alias("large")), "sizes"))
    return names.join(per, "block").drop("n")


def _linked_in_blocks(sets: DataFrame, rule: Rule) -> DataFrame:
    """(id, root) of the classes of sets (block, cls, grams) in blocks that a task can hold."""

    def small(table: pa.Table) -> pa.Table:
        names = table.column("cls").to_pylist()
        roots = block_components([np.frombuffer(g, "<u8") for g in table.column("grams").to_pylist()], rule)
        return pa.table([pa.array(names, pa.binary()), pa.array([names[r] for r in roots], pa.binary())], names=["id", "root"])

    return sets.select("block", "cls", "grams").groupBy("block").applyInArrow(small, "id binary, root binary").distinct()


def _rarest(sets: DataFrame, rule: Rule) -> DataFrame:
    """Rows of _combining for sets (block, cls, grams): two sets of a block that link have a key in common.

    N-grams are put in order by the number of sets that have them.  Of two sets that link, the first n-gram in common stands
    so early in both that the rest still holds num / den of each; so only that many of the rarest are keys, and passages that
    many sets share are none.  N-grams of one set alone come first and are not sent on.  A set is never gathered: ranks come
    from a sort by set, and a key that very many sets share is combined within tasks.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, SLICE):
                grams = texts_of(part.column(2))
                sizes = np.diff(grams.bounds) // 8
                node = np.array([int.from_bytes(c[:8], "big", signed=True) for c in part.column(1).to_pylist()], np.int64)
                block = np.asarray(part.column(0)).view(np.uint64)
                gram = pair(np.frombuffer(grams.data.tobytes(), "<u8"), np.repeat(block, sizes)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (gram, np.repeat(node, sizes), np.repeat(sizes, sizes).astype(np.int64))], names=["gram", "node", "n"])

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _combining((np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches)

    grams = sets.select("block", "cls", "grams").mapInArrow(each, "gram long, node long, n long")
    often = grams.groupBy("gram").agg(F.count("*").alias("sets")).where("sets > 1")
    of_set = Window.partitionBy("node")
    # Equal ranks for equal n-grams, as a repeated identifier may bring a class twice.
    ranked = grams.join(often, "gram").withColumn("rank", F.dense_rank().over(of_set.orderBy("sets", "gram"))).withColumn("known", F.max("rank").over(of_set))
    least = F.ceil(F.col("n") * rule.num / rule.den)
    return ranked.where(F.col("rank") <= F.col("known") - least + 1).select("gram", "node").mapInArrow(combined, "key long, node long, least long")


def _reblocked(sets: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """sets (block, cls, grams) in the blocks that their rarest n-grams form, with large; sets alone in theirs go."""
    blocks = _blocks(_rarest(sets, rule), scratch)
    names = sets.select("cls", (F.octet_length("grams") / 8).alias("n")).distinct().withColumn("node", _node()).join(if_small(blocks), "node").drop("node")
    names = scratch.write(_sized(names, scratch), "names")
    return scratch.write(sets.drop("block").join(if_small(names), "cls").select("block", "large", "cls", "grams"), "grams")


def _shares(sets: DataFrame, name: str) -> DataFrame:
    """Of each block, into how many shares its sets are dealt."""
    return sets.groupBy("block").agg(F.ceil(F.sum(F.octet_length("grams")) / 8 / SHARE_GRAMS).cast("int").alias(name))


def _products(rows: DataFrame, pivots: DataFrame, rule: Rule, scratch: Scratch, alike: bool = False) -> DataFrame:
    """(u, v) links between rows (block, share, shares, cls, grams) and the pivots of their block, enough to connect all that
    link: the incidence matrix of a share of rows times that of a share of pivots, in a task of its own each.

    alike: rows and pivots are the same sets, so half of the products will do.
    """
    if alike:
        turn, turns = F.col("share"), F.col("share")
    else:
        pivots = scratch.write(pivots, "pivots")
        per = if_small(scratch.write(_shares(pivots, "turns"), "turns"))
        pivots, rows = pivots.join(per, "block"), rows.join(per, "block")
        turn, turns = F.pmod(F.xxhash64(F.lit(1), "cls"), "turns").cast("int"), F.col("turns") - 1
    begin = turn if alike else F.lit(0)
    pivots = pivots.select("block", F.explode(F.sequence(begin, F.col("shares") - 1)).alias("share"), turn.alias("turn"), "cls", "grams")
    rows = rows.select("block", "share", F.explode(F.sequence(F.lit(0), turns)).alias("turn"), "cls", "grams")

    def link(mine: pa.Table, others: pa.Table) -> pa.Table:
        seen, out, linked_to = set(), [], {}
        if mine.num_rows and others.num_rows:
            cls, names = mine.column("cls").to_pylist(), others.column("cls").to_pylist()
            grams = texts_of(mine.column("grams"))
            values, begin = np.frombuffer(grams.data.tobytes(), "<u8"), grams.bounds // 8
            sets = [np.frombuffer(g, "<u8") for g in others.column("grams").to_pylist()]
            at_once = max(AT_ONCE, CELLS // len(cls))
            for lo in range(0, len(sets), at_once):
                some = sets[lo : lo + at_once]
                both = rule.linked(overlaps(values, begin, some), np.diff(begin)[:, None], np.array([len(p) for p in some])[None, :])
                for i, j in zip(*(x.tolist() for x in np.nonzero(both))):
                    if i not in linked_to:
                        linked_to[i] = lo + j
                        out.append((cls[i], names[lo + j]))
                    elif (pair_ := (names[linked_to[i]], names[lo + j])) not in seen:
                        seen.add(pair_)
                        out.append(pair_)
        return pa.table([pa.array([x[k] for x in out], pa.binary()) for k in range(2)], names=["u", "v"])

    key = ("block", "share", "turn")
    found = rows.groupBy(*key).cogroup(pivots.groupBy(*key)).applyInArrow(link, "u binary, v binary")
    return found.where(F.col("u") != F.col("v")).distinct()


def _large_links(sets: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """(u, v) links of classes that connect the components of large blocks; sets has block, cls, grams.

    In each of the first TURNS about AT_ONCE sets of a block, chosen by a hash, are multiplied with all of it; then those
    that are still outside its largest component are, all of them.  No set leaves the executors.
    """
    sets = sets.join(if_small(scratch.write(_shares(sets, "shares"), "shares")), "block")
    sets = scratch.write(sets.withColumn("share", F.pmod(F.xxhash64("cls"), "shares").cast("int")), "shares")
    links = sets.select(F.col("cls").alias("u"), F.col("cls").alias("v")).limit(0)
    state = sets.select("block", "cls", F.col("cls").alias("root"), F.lit(False).alias("done"))
    for turn in range(TURNS + 1):
        per = state.groupBy("block", "root").count().groupBy("block").agg(F.max_by("root", F.struct("count", "root")).alias("largest"), F.count("*").alias("roots"))
        open_ = state.join(if_small(scratch.write(per.where("roots > 1"), "largest")), "block").where(~F.col("done"))
        open_ = open_.select("block", "cls") if turn == 0 else open_.where(F.col("root") != F.col("largest")).select("block", "cls")
        if turn < TURNS:
            n = if_small(scratch.write(open_.groupBy("block").count(), "open"))
            open_ = open_.join(n, "block").where(F.pmod(F.xxhash64("cls", F.lit(turn)), F.lit(1 << 30)) / float(1 << 30) < AT_ONCE / F.col("count"))
        chosen = scratch.write(open_.select("cls"), "pivots")
        if chosen.isEmpty():
            continue
        chosen = if_small(chosen)
        if turn < TURNS:
            found = _products(sets, sets.join(chosen, "cls"), rule, scratch)
        else:
            pivots = scratch.write(sets.join(chosen, "cls"), "pivots")
            found = _products(pivots, pivots, rule, scratch, alike=True).unionByName(_products(sets.join(chosen, "cls", "left_anti"), pivots, rule, scratch))
        links = scratch.write(links.unionByName(found), "links")
        if turn < TURNS:
            roots = components(links, scratch).withColumnRenamed("id", "cls")
            state = state.drop("root").join(roots, "cls", "left").join(chosen.withColumn("now", F.lit(True)), "cls", "left")
            state = scratch.write(state.select("block", "cls", F.coalesce("root", "cls").alias("root"), (F.col("done") | F.coalesce("now", F.lit(False))).alias("done")), "state")
    return links


def _lookup(slim: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """Of (doc_id, text): (doc_id, n_shingles, cls) of every row, and (cls, component_id, best_cls) of the classes in
    components of more than one row: the component's least identifier and the class that has it."""
    n, scratch = rule.words, Scratch(slim.sparkSession)
    rows = written(_classified(slim, rule, "text").drop("text"), "classes")

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for batch in batches:
                for part in slices(batch, 0, SLICE):
                    sets = sets_of(texts_of(part.column(0)), n)
                    name = classes_of(sets).astype(np.uint64)
                    place = distinct(name[:, 0], name[:, 1])[2]
                    once = np.zeros(len(name), bool)
                    once[np.unique(place, return_index=True)[1]] = True
                    whose, sig = signatures(sets, rule)
                    yield sig[once[whose]], name[whose[once[whose]], 0]

        yield from _combining(each())

    blocks = _blocks(slim.select("text").mapInArrow(signed, "key long, node long, least long"), scratch)

    # A document of each class that is in a block; its set is made again from its text.
    by_class = scratch.write(rows.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.max("n_shingles").alias("n")), "by-class")
    chosen = by_class.withColumn("node", _node()).join(if_small(blocks), "node").select(F.col("least").alias("__id"), "cls", "block", "n")
    chosen = if_small(scratch.write(_sized(chosen, scratch), "chosen"))
    texts = slim.join(chosen, F.col("doc_id").eqNullSafe(F.col("__id"))).select("block", "large", "cls", "text")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 3, SLICE):
                sets = sets_of(texts_of(part.column(3)), n)
                same = [a == bytes(b) for a, b in zip(part.column(2).to_pylist(), classes_of(sets))]
                data = [sets.values[a:b].astype("<u8").tobytes() for a, b in zip(sets.first[:-1], sets.first[1:])]
                out = pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(data, pa.binary())], names=["block", "large", "cls", "grams"])
                yield out.filter(pa.array(same, pa.bool_()))

    # Rows that repeat an identifier may bring a class twice: harmless, as equal sets link.
    sets = scratch.write(texts.mapInArrow(grams, "block long, large boolean, cls binary, grams binary"), "grams")

    across = _linked_in_blocks(sets.where(~F.col("large")), rule)
    big = sets.where("large").drop("large")
    # Sets that can link with none, and passages that many sets share, hold large blocks together; without them most fall apart.
    if not big.isEmpty():
        left = _reblocked(scratch.write(_joinable(big, rule, scratch), "joinable"), rule, scratch)
        across = across.unionByName(_linked_in_blocks(left.where(~F.col("large")), rule))
        big = left.where("large").drop("large")
    if not big.isEmpty():
        across = across.unionByName(components(_large_links(big, rule, scratch), scratch))
    across = scratch.write(across, "components")

    known = scratch.write(by_class.join(across.withColumnRenamed("id", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls")), "known")
    # The least identifier of each component, null ones last, and the class that has it.
    best = known.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "cls")).alias("best"), F.sum("copies").alias("all"))
    # Classes that share their component with no other row need no lookup.
    lookup = written(known.join(best.where("all > 1"), "root").select("cls", F.col("best.least").alias("component_id"), F.col("best.cls").alias("best_cls")), "lookup")
    scratch.clear()
    return rows, lookup


def _classified(docs: DataFrame, rule: Rule, text: str) -> DataFrame:
    """docs with n_shingles and cls; the names of docs must not clash."""
    at, n = docs.columns.index(text), rule.words
    schema = StructType(list(docs.schema)).add("n_shingles", "long").add("cls", "binary")

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at, SLICE):
                sets = sets_of(texts_of(part.column(at)), n)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sets.sizes, pa.int64()), _bytes(classes_of(sets))], names=schema.names)

    return docs.mapInArrow(classes, schema)


def linked(docs: DataFrame, rule: Rule, identifier: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: component_id is the least identifier reachable by links.

    Null and empty texts, and those of white space, have 0 n-grams and stand alone.  Repeated rows have equal sets and so
    link.  A null identifier is never the least one, unless there is no other.  An empty table gives no rows.  Columns of
    docs beside the two are not read.
    """
    rows, lookup = _lookup(docs.select(F.col(identifier).alias("doc_id"), F.col(text).alias("text")), rule)
    found = rows.join(if_small(lookup), "cls", "left")
    component = F.when(F.col("best_cls").isNotNull() & (F.col("n_shingles") > 0), F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"))


def keep_one(docs: DataFrame, rule: Rule, identifier: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of every component, that of the least identifier; rows without n-grams or links all stay.

    Of rows that repeat that identifier and set one stays, whichever; their columns are returned as they are.
    """
    names = docs.columns
    plain = docs.toDF(*(f"__column{i}" for i in range(len(names))))
    own, body = (plain.columns[names.index(c)] for c in (identifier, text))
    rows, lookup = _lookup(plain.select(F.col(own).alias("doc_id"), F.col(body).alias("text")), rule)
    lookup = if_small(lookup)
    found = _classified(plain, rule, body).join(lookup, "cls", "left")
    alone = F.col("best_cls").isNull() | (F.col("n_shingles") == 0)
    best = (F.col("n_shingles") > 0) & (F.col("cls") == F.col("best_cls"))
    kept = found.where(alone | (best & F.col(own).eqNullSafe(F.col("component_id"))))
    twice = rows.join(lookup, "cls").where(best & F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("cls").count().where("count > 1")
    if not twice.isEmpty():  # an identifier came with the same set more than once
        kept = kept.where(alone).unionByName(kept.where(~alone).dropDuplicates(["cls"]))
    return kept.select(*plain.columns).toDF(*names)
