"""Spelling variants: words within one edit of each other, by a positional q-gram index with a count filter.

A pair of words within one edit agrees in all letters before some place and in all after it.  Cut the shorter word's
places into two halves: the edit lies in one of them, and the other half is the same in both words.  So words are dealt
out by length and by what is outside an interval of places, and only words that agree there meet.  A group with more words
than a task should hold is dealt again by halves of its interval, so no group is bounded by the corpus but by the alphabet.

Within a task, the letters inside the interval are cut into 2-grams with their positions, which index the words.  One edit
changes at most two of a word's grams, so of its three rarest one at least stands in every near word, at its own place or
one further.  The postings of those are merged by one sort into pairs, pairs that share fewer grams than one edit leaves
are dropped, and the rest is verified letter by letter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.bytewords import texts_of
from siftline.llm.support import Scratch, parts_of

#: Maximal runs of letters; all of them are in Latin-1, so a letter is a byte inside tasks.
LETTERS = "A-Za-zÀ-ÿ"
#: A run is changed if this divides its hash.
EVERY = 31
#: Code points of the shortest word, its occurrences, and how many times as frequent a word's form has to be.
SHORTEST, LEAST, TIMES = 7, 2, 10
#: Words of a group beyond which it is dealt again, and the shortest interval that is cut.
MOST_WORDS, CUT = 100_000, 4
#: Letters that a task works on at once, and postings merged at once.
LETTERS_AT_ONCE, POSTINGS = 1 << 21, 1 << 21
#: Grams that an edit leaves at least one of.
PROBES = 3


def occurrences(docs: DataFrame, identifier: str = "doc_id", text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """(word) for each run of letters of at least so many code points, in lower case, after the change that its hash asks for.

    The hash is the CRC-32 of `<identifier>:<run>`; where EVERY divides it, the letter at hash modulo length goes.
    """
    source = F.coalesce(F.col(identifier).cast("string"), F.lit(""))
    # Possessive and at least as long as the shortest word: shorter runs are never given out.
    runs = docs.select(source.alias("id"), F.explode(F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{shortest},}}+"), 0)).alias("run"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    runs = runs.select("id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", upper, upper.lower())).otherwise(F.col("run")).alias("run"))
    run, h = F.col("run"), F.col("h")
    at = (h % F.length(run)).cast("int")
    runs = runs.select("run", F.crc32(F.concat("id", F.lit(":"), run)).alias("h"))
    changed = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return runs.select(F.when(h % EVERY == 0, changed).otherwise(run).alias("word")).where(F.length("word") >= shortest)


def _groups(words: DataFrame, spans: Column) -> DataFrame:
    """(word, n, short, lo, hi, grp): a row for each interval of spans, an array of (short, lo, hi).

    short is the length of a pair's shorter word; words of short and short + 1 letters meet that agree in the first lo
    letters of it and in those from hi on.
    """
    out = words.withColumn("s", F.explode(spans)).select("word", "n", "s.*")
    rest = F.col("short") - F.col("hi")
    outside = F.concat_ws(":", "short", "lo", "hi", F.substring("word", F.lit(1), F.col("lo")), F.substring(F.col("word"), F.length("word") - rest + 1, rest))
    return out.withColumn("grp", outside)


def _cut(short: Column, lo: Column, hi: Column) -> list[Column]:
    mid = F.floor((lo + hi) / 2).cast("int")
    return [F.struct(short.cast("int").alias("short"), a.cast("int").alias("lo"), b.cast("int").alias("hi")) for a, b in ((lo, mid), (mid, hi))]


def _dealt(words: DataFrame, shortest: int, scratch: Scratch) -> list[DataFrame]:
    """Tables of groups, none of which has more than MOST_WORDS unless its interval is too short to be cut."""
    n = F.length("word")
    spans = F.filter(F.array(*_cut(n, F.lit(0), n), *_cut(n - 1, F.lit(0), n - 1)), lambda s: s["short"] >= shortest)
    level, out = _groups(words, spans), []
    while True:
        level = scratch.write(level, "spelling-groups")
        sizes = level.groupBy("grp").count().where(F.col("count") > MOST_WORDS)
        large = scratch.write(sizes.select("grp"), "spelling-large")  # at most a row for each MOST_WORDS of level's
        if large.isEmpty():
            return [*out, level]
        wide = F.col("hi") - F.col("lo") >= CUT
        out.append(level.join(large, "grp", "left_anti").unionByName(level.where(~wide).join(large, "grp", "left_semi")))
        again = level.where(wide).join(large, "grp", "left_semi").withColumn("spans", F.array(*_cut(F.col("short"), F.col("lo"), F.col("hi"))))
        level = _groups(again.select("word", "n", "spans"), F.col("spans"))


def latin(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of letters, one byte each and 0 behind the last, and their lengths."""
    texts = texts_of(column)
    lead = texts.data == 0xC3
    byte = texts.data.copy()
    byte[1:][lead[:-1]] += 0x40
    upto = np.concatenate([[0], np.cumsum(~lead)])
    bounds, byte = upto[texts.bounds], byte[~lead]
    size = np.diff(bounds)
    rows = np.zeros((len(size), max(1, int(size.max(initial=0)))), np.uint8)
    rows[np.arange(rows.shape[1]) < size[:, None]] = byte
    return rows, size


def _lcp(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.cumprod(a == b, axis=1, dtype=np.uint8).sum(1, dtype=np.int64)


def near_pairs(inside: np.ndarray, width: np.ndarray, short: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, common first letters) of words of one group within one edit, b equally long or a letter longer; pairs may come
    twice.

    inside has each word's letters inside its group's interval, width the interval's width and short says which words
    have no letter more.  Groups are ascending.
    """
    size = width + ~short
    # A gram has the letter before it as well; before the first and behind the last are the same in all of a group.
    letters = np.pad(inside, ((0, 0), (1, 1))).astype(np.int64)
    grams = (letters[:, :-1] << 8) | letters[:, 1:]
    place = np.arange(grams.shape[1])
    has = place <= size[:, None]
    key = (group[:, None].astype(np.int64) << 36) | (place << 16) | grams
    owners = np.nonzero(has)[0]
    flat = key[has]
    order = np.argsort(flat, kind="stable")
    keys, owners = flat[order], owners[order]
    runs = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    often = np.empty(len(flat), np.int64)
    often[order] = np.repeat(np.diff(np.append(runs, len(keys))), np.diff(np.append(runs, len(keys))))
    count = np.full(key.shape, len(keys) + 1)
    count[has] = often
    askers = np.flatnonzero(short)
    probes = np.argpartition(count[askers], min(PROBES, count.shape[1]) - 1, axis=1)[:, :PROBES]
    for shift in (0, 1):  # grams of near words stand at their own place, or one further in a longer word
        a, at = np.repeat(askers, probes.shape[1]), probes.ravel()
        fits = has[a, at]
        a, wanted = a[fits], key[a[fits], at[fits]] + (shift << 16)
        lo, hi = np.searchsorted(keys, wanted), np.searchsorted(keys, wanted, "right")
        n = hi - lo
        upto = np.concatenate([[0], np.cumsum(n)])
        first = 0
        while first < len(a):  # all probes of a word are in one share
            last = max(first + 1, int(np.searchsorted(upto, upto[first] + POSTINGS, "right")) - 1)
            while last < len(a) and a[last] == a[last - 1]:
                last += 1
            some, base = n[first:last], upto[first]
            posting = owners[np.repeat(lo[first:last] - (upto[first:last] - base), some) + np.arange(some.sum())]
            asker = np.repeat(a[first:last], some)
            first = last
            # Lengths: of equally long words the later one answers, longer ones answer shorter ones.
            keep = ~short[posting] | ((posting > asker) & (shift == 0))
            pairs = np.sort(asker[keep] * len(inside) + posting[keep])
            pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]] if len(pairs) else pairs
            yield from _verified(*np.divmod(pairs, len(inside)), inside, grams, has, width, short)


def _verified(a: np.ndarray, b: np.ndarray, inside: np.ndarray, grams: np.ndarray, has: np.ndarray, width: np.ndarray, short: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The pairs, counted and verified some at a time."""
    step = max(1, POSTINGS // grams.shape[1])
    for k in range(0, len(a), step):
        x, y = a[k : k + step], b[k : k + step]
        same, more = grams[x] == grams[y], np.zeros(len(x), bool)
        further = np.zeros_like(same)
        further[:, :-1] = grams[x][:, :-1] == grams[y][:, 1:]
        more = ~short[y]
        shared = ((same | (further & more[:, None])) & has[x]).sum(1)
        # Of the width + 1 grams of the shorter word an edit changes two at most, an inserted letter only one.
        enough = shared >= np.where(more, width[x], width[x] - 1)
        x, y, more, same, further = x[enough], y[enough], more[enough], same[enough], further[enough]
        first = np.minimum(_lcp(inside[x], inside[y]), width[x])
        differ = ((inside[x] != inside[y]) & (np.arange(inside.shape[1]) < width[x][:, None])).sum(1)
        # Behind the inserted letter, the rest is one place further.
        tail = np.zeros((len(x), inside.shape[1]), bool)
        tail[:, :-1] = inside[x][:, :-1] != inside[y][:, 1:]
        place = np.arange(inside.shape[1])
        off = (tail & (place >= first[:, None]) & (place < width[x][:, None])).sum(1)
        good = np.where(more, off == 0, differ == 1)
        yield x[good], y[good], first[good]


def _answers(rows: pa.Table) -> pa.RecordBatch:
    """(word, near, best_n, best) of words with near ones in these whole groups."""
    letters, size = latin(rows.column("word").combine_chunks())
    short_len, lo, hi, n = (rows.column(c).to_numpy().astype(np.int64) for c in ("short", "lo", "hi", "n"))
    codes = rows.column("grp").combine_chunks().dictionary_encode()
    group = np.asarray(codes.indices).astype(np.int64)
    short, width = size == short_len, hi - lo
    at = np.minimum(lo[:, None] + np.arange(int((width + 1).max(initial=1))), letters.shape[1] - 1)
    inside = np.where(np.arange(at.shape[1]) < (width + ~short)[:, None], np.take_along_axis(letters, at, 1), 0)
    found = [(x, y) for x, y, first in near_pairs(inside, width, short, group) for keep in [(lo[x] + first < hi[x]) | (hi[x] == short_len[x])] for x, y in [(x[keep], y[keep])]]
    a, b = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in range(2))
    pairs = np.unique(a * len(size) + b)
    a, b = np.divmod(pairs, max(1, len(size)))
    one, other = np.concatenate([a, b]), np.concatenate([b, a])
    rank = np.empty(len(size), np.int64)
    rank[np.argsort(np.ascontiguousarray(letters).view(f"S{letters.shape[1]}").ravel(), kind="stable")] = np.arange(len(size))
    order = np.lexsort((rank[other], -n[other], one))
    one, other = one[order], other[order]
    begins = np.flatnonzero(np.r_[True, one[1:] != one[:-1]]) if len(one) else np.empty(0, np.int64)
    near = np.diff(np.append(begins, len(one)))
    words = rows.column("word").combine_chunks()
    return pa.RecordBatch.from_pydict({"word": words.take(pa.array(one[begins])), "near": pa.array(near, pa.int64()), "best_n": pa.array(n[other[begins]], pa.int64()), "best": words.take(pa.array(other[begins]))})


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole groups together, as many as fit; rows come sorted by length and group."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        lengths = np.asarray(batch.column(2))
        edges = np.flatnonzero(lengths[1:] != lengths[:-1]) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
            some = batch.slice(lo, hi - lo)
            if held and some.num_rows and (n + some.num_rows) * (int(lengths[lo]) + 1) > LETTERS_AT_ONCE:
                other = pc.not_equal(some.column(5), held[-1].column(5)[-1])
                end = pc.index(other, True).as_py()
                if end >= 0:
                    yield _answers(pa.Table.from_batches([*held, some.slice(0, end)]))
                    held, n, some = [], 0, some.slice(end)
            if some.num_rows:
                held.append(some)
                n += some.num_rows
    if held:
        yield _answers(pa.Table.from_batches(held))


def near_words(words: DataFrame, shortest: int, scratch: Scratch) -> DataFrame:
    """(word, near, best_n, best), some rows for each word of (word, n) that has near ones: how many, and the one of largest n."""
    parts = parts_of(words.sparkSession)
    answers = None
    for level in _dealt(words, shortest, scratch):
        sorted_ = level.repartition(parts, "grp").sortWithinPartitions("short", "grp").select("word", "n", "short", "lo", "hi", "grp")
        found = sorted_.mapInArrow(_compare, "word string, near long, best_n long, best string")
        answers = found if answers is None else answers.unionByName(found)
    return answers


def variants(docs: DataFrame, identifier: str = "doc_id", text: str = "text", *, shortest: int = SHORTEST, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of at least `least` occurrences, n, in docs.

    n_near counts the words within one inserted, deleted or replaced code point.  form is the most frequent of them, ties
    by code points, if it is `times` as frequent as the word or more; root is where forms lead to.  Null and empty texts
    have no words, a null identifier hashes as an empty one, repeated rows count as often as they stand, an empty table
    has no rows.  Other columns are not read.  Words are compared whole, however long.
    """
    if times < 2:
        raise ValueError("a form has to be at least twice as frequent as the word")
    scratch = Scratch(docs.sparkSession)
    counted = occurrences(docs, identifier, text, shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    words = scratch.write(counted, "spelling-words")
    own = words.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    near = near_words(words, shortest, scratch).select("word", F.lit(None).cast("long").alias("n"), "near", "best_n", "best")
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("k"), F.col("best").alias("best"))))
    each = own.unionByName(near).groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), best.alias("b"))
    enough = -F.col("b.k") >= times * F.col("n")
    each = each.select("word", "n", "n_near", F.when(enough, F.col("b.best")).alias("form"), F.when(enough, -F.col("b.k")).alias("form_n"))
    each = scratch.write(each, "spelling-forms")
    # Each form is `times` as frequent as the one before it, which bounds the steps; every join doubles those taken.
    steps, most = 0, (words.agg(F.max("n")).first()[0] or 0)
    while times > 1 and least * times ** (steps + 1) <= most:
        steps += 1
    roots = each.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    taken = 1
    while taken < steps:
        roots = scratch.write(roots, "spelling-roots")
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        roots = roots.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"))
        taken *= 2
    return each.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
