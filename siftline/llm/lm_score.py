"""Log probabilities of texts under a word n-gram model with deleted interpolation.

The model mixes maximum-likelihood estimates of all orders and a uniform share:

    p(w | h) = sum over orders k of lambda[b][k] * count(h_k w) / count(h_k)  +  lambda[b][0] / (V + 1)

where b is the bucket of the history: its longest part that was seen, and the logarithm of how often.  The weights of each
bucket are learned by expectation-maximisation on texts held out of the counts (deleted from them); final scores then use
the counts of all training texts.

Counts are looked up in an exchange of packs: each pack of texts sends its distinct n-grams, as sorted hashes of 80 bits, to
buckets by hash range, with its own counts; each bucket adds up those of training texts and answers each pack.  Orders take
turns, and each asks for what the order before has left open: if all occurrences of an n-gram are in one pack, so are those
of the longer n-grams that hold it, and that pack counts them by itself.  Nothing is broadcast but the weights.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.bytewords import distinct, pair, texts_of, words_of
from siftline.llm.packs import bucket_bounds, buckets_for, decode, encode, only, packs_of, squeezed, unpacked, unsqueezed
from siftline.llm.support import written

#: Groups of texts: counted while weights are learned; held out of the counts then; never learned from.
COUNTED, DELETED, HELD_OUT = 0, 1, 2
#: Rounds of expectation-maximisation, and cells per power of two in which probabilities are gathered for it.
ROUNDS, STEPS = 60, 4
_END, _BEGIN = np.uint64(0x7D3A5B1C9E8F6421), np.uint64(0x1F2E3D4C5B6A7988)
_ORDER_SALT = 0x9FB21C651E98DF25


@dataclass
class Grams:
    """N-grams of a pack: of each order the sorted distinct hashes in both halves, the place of each token's among them, and
    one token of each."""

    keys: list[tuple[np.ndarray, np.ndarray]]
    places: list[np.ndarray]
    some: list[np.ndarray]
    owner: np.ndarray
    begins: np.ndarray
    texts: int


def grams_of(column: pa.Array, order: int) -> Grams:
    words = words_of(texts_of(column))
    counts = np.diff(words.first)
    n = len(counts)
    ends = np.cumsum(counts + 1) - 1  # of each text's end token
    is_end = np.zeros(len(words.hashes) + n, bool)
    is_end[ends] = True
    tokens = []
    for half in (words.hashes, words.more):
        tokens.append(np.empty(len(is_end), np.uint64))
        tokens[-1][is_end], tokens[-1][~is_end] = _END, half
    begins = np.zeros(len(is_end), bool)
    begins[ends - counts] = True
    keys, places, some = [], [], []
    # The hash of order k ends at each token; histories that reach back before the text's start hold a begin mark.
    gram = tokens
    since = np.arange(len(is_end)) - np.repeat(ends - counts, counts + 1)
    for k in range(1, order + 1):
        if k > 1:
            earlier = [np.where(since >= k - 1, np.concatenate([np.full(k - 1, _BEGIN), t])[: len(t)], _BEGIN) for t in tokens]
            gram = [pair(g, e + np.uint64(k * _ORDER_SALT % (1 << 64))) for g, e in zip(gram, earlier)]
        a, b, at = distinct(gram[0], (gram[1] >> np.uint64(48)).astype(np.uint16))
        token = np.empty(len(a), np.int64)
        token[at] = np.arange(len(at))
        keys.append((a, b))
        places.append(at)
        some.append(token)
    return Grams(keys, places, some, np.repeat(np.arange(n), counts + 1), begins, n)


def _counts(g: Grams, grp: int, replies: pa.Table, column: str, orders: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Of the first orders, which are answered, the count of every distinct n-gram in all training texts ("total") or in the
    counted ones ("counted"); and which n-grams of the next order are to be asked for."""
    rows = sorted(replies.select(["ord", "bucket", "total", "counted", "alone"]).to_pylist(), key=lambda r: (r["ord"], r["bucket"]))
    counts, asked = [], np.ones(len(g.keys[0][0]), bool)
    for k in range(orders):
        mine = [r for r in rows if r["ord"] == k]
        own = np.bincount(g.places[k], minlength=len(asked))
        each = {"total": own if grp != HELD_OUT else np.zeros_like(own), "counted": own if grp == COUNTED else np.zeros_like(own), "alone": np.ones_like(own)}
        for c in {"total", "alone", column}:
            answers = np.concatenate([unsqueezed(r[c]) for r in mine] or [np.empty(0, "<u4")])
            if len(answers) != asked.sum():
                raise RuntimeError(f"{asked.sum()} n-grams asked for, {len(answers)} answered")
            each[c] = each[c].copy()
            each[c][asked] = answers
        counts.append(each[column])
        if k + 1 < len(g.keys):
            # All of them are here, or none is in a training text: so it is with each n-gram that ends in it or begins with it.
            here = ((each["alone"] > 0) | (each["total"] == 0))[g.places[k]]
            before = np.concatenate([[False], here[:-1]]) & ~g.begins
            asked = ~(here | before)[g.some[k + 1]]
    return counts, asked


def _answered(packs: DataFrame, k: int, before: DataFrame | None, buckets: int) -> DataFrame:
    """Answers to every pack's n-grams of k + 1 words that the answers before have left open, written; for single words also
    rows of totals, with pack -1."""

    def asks(pack: int, grp: int, rows: bytes, replies: pa.Table | None) -> pa.RecordBatch:
        g = grams_of(unpacked(rows).column("text").combine_chunks(), k + 1)
        open_ = _counts(g, grp, replies, "total", k)[1] if replies is not None else np.ones(len(g.keys[0][0]), bool)
        a, b = (x[open_] for x in g.keys[k])
        mine = np.bincount(g.places[k], minlength=len(open_))[open_]
        bounds, out = bucket_bounds(a, buckets), []
        for at in range(buckets):
            lo, hi = bounds[at], bounds[at + 1]
            if lo < hi:
                out.append((at, pack, grp, encode(a[lo:hi]), b[lo:hi].astype("<u2").tobytes(), squeezed(mine[lo:hi])))
        return pa.RecordBatch.from_pylist([dict(zip(asked.names, r)) for r in out], schema=asked)

    asked = pa.schema([("bucket", pa.int32()), ("pack", pa.int64()), ("grp", pa.int32()), ("keys", pa.binary()), ("more", pa.binary()), ("own", pa.binary())])
    plain = "bucket int, pack long, grp int, keys binary, more binary, own binary"

    def ask(batches):
        for batch in batches:
            for pack, grp, rows in zip(*(batch.column(c).to_pylist() for c in ("pack", "grp", "rows"))):
                yield asks(pack, grp, rows, None)

    def ask_on(mine: pa.Table, replies: pa.Table) -> pa.Table:
        return pa.Table.from_batches([asks(*(mine.column(c)[i].as_py() for c in ("pack", "grp", "rows")), replies) for i in range(mine.num_rows)], schema=asked)

    def answer(table: pa.Table) -> pa.Table:
        out, rows = [], table.to_pylist()
        keys = [decode(r["keys"]) for r in rows]
        u, _, at = distinct(np.concatenate(keys), np.concatenate([np.frombuffer(r["more"], "<u2") for r in rows]))
        cuts = np.cumsum([0, *map(len, keys)]).tolist()
        sums = [np.zeros(len(u), np.int64) for _ in range(3)]  # in counted, deleted and held-out texts
        own = [unsqueezed(r["own"]).astype(np.int64) for r in rows]
        for r, lo, hi, x in zip(rows, cuts, cuts[1:], own):
            sums[r["grp"]][at[lo:hi]] += x
        counted, total = sums[COUNTED], sums[COUNTED] + sums[DELETED]
        for r, lo, hi, x in zip(rows, cuts, cuts[1:], own):
            some = at[lo:hi]
            out.append((r["pack"], r["bucket"], k, squeezed(total[some]), squeezed(counted[some]) if r["grp"] == DELETED else None, squeezed(total[some] + sums[HELD_OUT][some] == x), 0, 0, 0, 0))
        if k == 0:
            out.append((-1, rows[0]["bucket"], 0, None, None, None, int(total.sum()), int((total > 0).sum()), int(counted.sum()), int((counted > 0).sum())))
        return pa.Table.from_pylist([dict(zip(answered.names, r)) for r in out], schema=answered)

    answered = pa.schema([("pack", pa.int64()), ("bucket", pa.int32()), ("ord", pa.int32()), ("total", pa.binary()), ("counted", pa.binary()), ("alone", pa.binary()), ("n", pa.int64()), ("v", pa.int64()), ("n0", pa.int64()), ("v0", pa.int64())])
    if before is None:
        sent = packs.mapInArrow(ask, plain)
    else:
        sent = packs.groupBy("pack").cogroup(before.groupBy("pack")).applyInArrow(ask_on, plain)
    return written(sent.groupBy("bucket").applyInArrow(answer, "pack long, bucket int, ord int, total binary, counted binary, alone binary, n long, v long, n0 long, v0 long"), "answers")


def exchange(packs: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """Answers (pack, bucket, ord, total, counted, alone) to every pack's n-grams, and a row of totals over the training texts."""
    answers, sums, buckets = None, None, buckets_for(packs)
    for k in range(order):
        got = _answered(packs, k, answers, buckets)
        if k == 0:
            sums = got.where("pack < 0").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "n0", "v0")))
        got = got.where("pack >= 0").select("pack", "bucket", "ord", "total", "counted", "alone")
        answers = got if answers is None else answers.unionByName(got)
    return answers, sums


def _looked_up(g: Grams, grp: int, replies: pa.Table, column: str, texts: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Counts of every token's n-gram and of its history, by order; texts is the number of training texts."""
    gram = [c[at].astype(np.float64) for c, at in zip(_counts(g, grp, replies, column, len(g.keys))[0], g.places)]
    return gram, [np.where(g.begins, float(texts), np.concatenate([[0.0], c[:-1]])) for c in gram[:-1]]


def _bucket(history: list[np.ndarray]) -> np.ndarray:
    """64 * (orders of the longest history seen) + log2 of its count."""
    out = np.zeros(len(history[0]) if history else 0, np.int64)
    for k, h in enumerate(history):
        out = np.where(h > 0, 64 * (k + 1) + np.log2(np.maximum(h, 1)).astype(np.int64), out)
    return out


def _estimates(gram: list[np.ndarray], history: list[np.ndarray], n: float, v: float) -> list[np.ndarray]:
    """Of each order, uniform first, the probability of every token."""
    p = [np.full(len(gram[0]), 1.0 / (v + 1)), gram[0] / max(n, 1.0)]
    for c, h in zip(gram[1:], history):
        p.append(np.where(h > 0, np.minimum(c / np.maximum(h, 1.0), 1.0), 0.0))
    return p


def learned(bucket: np.ndarray, p: np.ndarray, tokens: np.ndarray) -> dict[int, np.ndarray]:
    """Weights of each bucket by expectation-maximisation, from cells of tokens: the bucket of each, the probabilities that
    the orders give its tokens (a column each, the uniform share first), and their number."""
    out: dict[int, np.ndarray] = {}
    for b in np.unique(bucket).tolist():
        mine, n = p[bucket == b], tokens[bucket == b].astype(np.float64)
        w = np.full(p.shape[1], 1.0 / p.shape[1])
        for _ in range(ROUNDS):
            share = mine * w
            share /= share.sum(1, keepdims=True)
            w = (share * n[:, None]).sum(0) + 1e-3  # no estimate loses all its weight
            w /= w.sum()
        out[b] = w
    return out


def _cells(bucket: np.ndarray, p: list[np.ndarray], fine: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, steps of each order, tokens, sum of each order's probabilities) of tokens alike: a step s > 0 is a range of
    probabilities around 2 ** (-(s - 1) / fine), 0 is none.  Sums keep the cell's average exact."""
    steps = np.stack([np.where(x > 0, 1 + np.rint(-np.log2(np.maximum(x, 1e-300)) * fine), 0).astype(np.int64) for x in p], 1)
    cell = bucket
    for k in range(steps.shape[1]):
        _, cell = np.unique((cell << 20) + steps[:, k], return_inverse=True)
    _, at, tokens = np.unique(cell, return_index=True, return_counts=True)
    return bucket[at], steps[at], tokens, np.stack([np.bincount(cell, weights=x, minlength=len(at)) for x in p], 1)


def _mixed(p: list[np.ndarray], bucket: np.ndarray, weights: dict[int, np.ndarray]) -> np.ndarray:
    """Buckets without held-out tokens take the weights of the nearest bucket below, or of the lowest."""
    order = len(p) - 1
    known = np.array(sorted(weights), np.int64)
    if not len(known):
        return sum(p) / (order + 1)
    table = np.stack([weights[b] for b in known.tolist()])
    row = np.maximum(np.searchsorted(known, bucket, "right") - 1, 0)
    return sum(p[k] * table[row, k] for k in range(order + 1))


def score(docs: DataFrame, group: Column, *, order: int = 2, steps: int = STEPS, identifier: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, grp, n_tokens, n_known, train_tokens, base_score, score) of every row; scores are log10 probabilities.

    group gives each row COUNTED, DELETED or HELD_OUT; the first two are learned from.  Null and empty texts are one end
    token.  steps cells per power of two gather tokens of like probabilities for the weights.  Repeated rows count each time they occur and get equal scores.  Without training texts every token has the
    uniform share.  An empty table gives no rows.  Columns of docs beside the two are read by group alone.
    """
    slim = docs.select(F.col(identifier).alias("doc_id"), group.cast("int").alias("grp"), F.col(text).alias("text"))
    id_type = slim.schema["doc_id"].dataType.simpleString()
    sizes = {r["grp"]: r["count"] for r in slim.groupBy("grp").count().collect()}
    texts = {"total": sizes.get(COUNTED, 0) + sizes.get(DELETED, 0), "counted": sizes.get(COUNTED, 0)}
    packs = packs_of(slim, "grp")
    answers, sums = exchange(packs, order)
    sums = sums.first()

    def each(found: Callable, column: str) -> Callable:
        def run(mine: pa.Table, replies: pa.Table) -> pa.Table:
            out = []
            for grp, rows in zip(mine.column("grp").to_pylist(), mine.column("rows").to_pylist()):
                table = unpacked(rows)
                g = grams_of(table.column("text").combine_chunks(), order)
                out.append(found(table, grp, g, *_looked_up(g, grp, replies, column, texts[column])))
            return pa.concat_tables(out)

        return run

    def gathered(table, grp, g, gram, history):
        p = _estimates(gram, history, sums["n0"], sums["v0"])
        bucket, step, tokens, sum_ = _cells(_bucket(history) if history else np.zeros(len(gram[0]), np.int64), p, steps)
        return pa.table({"bucket": pa.array(bucket), "steps": pa.array(step.tolist(), pa.list_(pa.int64())), "tokens": pa.array(tokens, pa.int64()), **{f"p{k}": pa.array(sum_[:, k]) for k in range(order + 1)}})

    # A cell per bucket and step of each order: bounded by their ranges, not by the corpus.  Each bucket's weights are learned
    # in a task of their own; only they come to the driver.
    pairs = lambda p: p.groupBy("pack").cogroup(answers.join(p.select("pack"), "pack", "left_semi").groupBy("pack"))
    names = [f"p{k}" for k in range(order + 1)]
    cells = pairs(only(packs, DELETED)).applyInArrow(each(gathered, "counted"), "bucket long, steps array<long>, tokens long" + "".join(f", {c} double" for c in names))
    cells = cells.groupBy("bucket", "steps").agg(*(F.sum(c).alias(c) for c in ("tokens", *names))).select("bucket", "tokens", *names)

    def mixture(table: pa.Table) -> pa.Table:
        tokens = table.column("tokens").to_numpy()
        shares = np.stack([table.column(c).to_numpy() for c in names], 1) / np.maximum(tokens, 1)[:, None]
        rows = sorted(learned(table.column("bucket").to_numpy(), shares, tokens).items())
        return pa.table({"bucket": pa.array([b for b, _ in rows], pa.int64()), "weights": pa.array([w.tolist() for _, w in rows], pa.list_(pa.float64()))})

    weights = {r["bucket"]: np.array(r["weights"]) for r in cells.groupBy("bucket").applyInArrow(mixture, "bucket long, weights array<double>").collect()}
    n, v = float(sums["n"]), float(sums["v"])

    def scored(table, grp, g, gram, history):
        p = _estimates(gram, history, n, v)
        mixed = _mixed(p, _bucket(history) if history else np.zeros(len(p[0]), np.int64), weights)
        base = np.log10((gram[0] + 0.5) / (n + 0.5 * (v + 1)))
        add = lambda x: np.bincount(g.owner, weights=x, minlength=g.texts)
        tokens = np.bincount(g.owner, minlength=g.texts)
        return pa.table({"doc_id": table.column("doc_id"), "grp": pa.array([grp] * g.texts, pa.int32()), "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(add(gram[0] > 0).astype(np.int64)), "train_tokens": pa.array([int(n)] * g.texts, pa.int64()), "base_score": pa.array(add(base)), "score": pa.array(add(np.log10(mixed)))})

    return packs.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(each(scored, "total"), f"doc_id {id_type}, grp int, n_tokens long, n_known long, train_tokens long, base_score double, score double")
