"""Spelling variants, whitening and sketches by brute force, and on nulls, empty and long texts, ties, repeats and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftline.llm import queries, scaled_sketch, spelling, whitening

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASH = "doc_id long, text string, word string, n string, grp string, id string, part string, again string, h string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, *["x"] * 7) for i, t in rows], CLASH)


# Spelling variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants(rows, times=10):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and v != w and one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, n[w], len(near[w]), form[w], form[w] and n[form[w]], root(w)) for w in n)


def got_variants(df):
    return sorted(tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect())


def edited(rng, word):
    k = rng.randrange(len(word) + 1)
    return rng.choice([word[:k] + rng.choice("abcéÿ÷") + word[k:], word[:k] + word[k + 1 :], word[:k] + rng.choice("xyzàß") + word[k + 1 :]])


def spelled(seed):
    """Words at all edits of each other, chains of forms, ties, long words and letters beyond ASCII."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé") for _ in range(rng.choice([7, 8, 9, 12]))) for _ in range(30)] + ["étranger", "straßen" * 9, "aaaaaaaa", "aaaaaaaaa"]
    bag = []
    for w in base:
        bag += [w] * rng.choice([2, 30, 400])
        for _ in range(8):
            v = edited(rng, w)
            bag += [v] * rng.choice([2, 3, 30])
            bag += [edited(rng, v)] * 2
    rng.shuffle(bag)
    return [(i, " ".join(w.title() if rng.random() < 0.2 and w[0].isascii() else w for w in bag[i::40])) for i in range(40)]


@pytest.mark.parametrize("seed,most,letters,postings", [(1, 10**6, 1 << 21, 1 << 21), (2, 5, 1 << 21, 1 << 21), (3, 1, 300, 50)])
def test_variants_by_brute_force(spark, monkeypatch, seed, most, letters, postings):
    """Also with groups that are dealt again to the shortest interval, and with little at once."""
    monkeypatch.setattr(spelling, "MOST_WORDS", most)
    monkeypatch.setattr(spelling, "LETTERS_AT_ONCE", letters)
    monkeypatch.setattr(spelling, "POSTINGS", postings)
    rows = [*spelled(seed), (None, "zzzzzzzz zzzzzzzy"), (None, "zzzzzzzz zzzzzzzy"), (900, None), (901, ""), (902, "w" * 3000 + " " + "w" * 2999), (902, "w" * 3000 + " " + "w" * 2999)]
    want = variants(rows)
    got = got_variants(spelling.variants(table(spark, rows)))
    assert got == want
    assert any(r[5] not in (r[0], r[3]) for r in want) and any(r[2] > 1 for r in want)


def test_near_words_of_all_short_words(spark):
    """All words of seven letters of two, so that every group is full."""
    words = ["".join("ab"[k >> j & 1] for j in range(7)) for k in range(128)]
    rows = [(i, " ".join(w for w in words for _ in range(3 + 40 * (w == "aaaaaaa")))) for i in range(3)]
    assert got_variants(spelling.variants(table(spark, rows))) == variants(rows)


def test_variants_of_empty_tables(spark):
    assert spelling.variants(table(spark, [(1, "Hello")]).limit(0)).count() == 0
    assert spelling.variants(table(spark, [(1, None), (2, "short words")])).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(table(spark, [(1, "a")]), times=1)


def test_variants_query_by_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    assert got_variants(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"))) == variants(rows)


# Whitening


def whitened(rows, k=16):
    """rows of (identifier, vector): what is left, the distinct vectors, components and eigenvalues by NumPy's eigh."""
    x = [(i, np.array([int(np.floor(np.float64(np.float32(c)) * 64)) + 1_000_000 for c in v], object)) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fitted = np.array(sorted({tuple(v) for _, v in x}), object)
    n, s = len(fitted), fitted.sum(0)
    c = np.array([[float((n * a - b) / n) for a, b in zip(v, s)] for v in fitted])
    e, vectors = np.linalg.eigh(c.T @ c / n)
    return x, n, s, e[::-1][:k], vectors[:, ::-1][:, :k], e.sum()


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", "x") for i, v in rows], "vec_id long, embedding array<float>, x string, id string")


def check(spark, rows, df):
    x, n, s, e, v, trace = whitened(rows)
    got = {}
    for r in df.collect():
        got.setdefault(r.vec_id, []).append(r)
    assert Counter(i for i, _ in x) == {i: len(rs) // len(e) for i, rs in got.items()}
    signs = None
    for i, xs in x:
        rs = sorted(got[i], key=lambda r: r.component)[:: len(got[i]) // len(e)]
        assert {r.n for r in rs} == {n} and {r.deviation for r in rs} == {sum(int((n * a - b) ** 2) for a, b in zip(xs, s))}
        want = np.array([float((n * a - b) / n) for a, b in zip(xs, s)]) @ v / np.sqrt(e)
        mine = np.array([r.whitened for r in rs])
        signs = np.sign(want * mine) if signs is None else signs
        assert np.allclose(mine, want * signs, rtol=1e-6, atol=1e-8)
        assert np.allclose([r.explained for r in rs], e / trace, rtol=1e-8) and all(r.identity_error < 1e-9 for r in rs)


@pytest.mark.parametrize("parts", [1, 40])
def test_whitening_by_brute_force(spark, monkeypatch, parts):
    """Also in a tree of merges; with repeated rows, and rows that have no vector."""
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    monkeypatch.setattr(whitening, "AT_ONCE", 7)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(120, 20)) * np.linspace(3, 0.1, 20) + 7
    rows = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(base)]
    rows += [(1000 + k, rows[3][1]) for k in range(50)] + [(None, rows[4][1])]
    bad = [(2000, None), (2001, []), (2002, [None, *rows[0][1][1:]]), (2003, [float("nan"), *rows[0][1][1:]]), (2004, [float("-inf"), *rows[0][1][1:]]), (2005, [1.0])]
    check(spark, rows, whitening.whiten(vectors(spark, rows + bad).repartition(parts)))


def test_whitening_query_by_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(spark, rows, queries.op12_whitened_vectors(spark, SF))


def test_factors_agree_with_one_factorisation(spark):
    """The merged R has the singular values of all centred rows, even where the covariance would lose them."""
    rng = np.random.default_rng(2)
    u = np.linalg.qr(rng.normal(size=(300, 4)))[0]
    x = (u * [1e9, 1e6, 1e3, 30] @ np.linalg.qr(rng.normal(size=(4, 4)))[0]).round().astype(int)
    df = spark.createDataFrame([(v,) for v in x.tolist()], "x array<long>").repartition(9)
    model = whitening.fit(df)
    want = np.linalg.svd(x - x.mean(0), compute_uv=False)
    assert np.allclose(np.sqrt(model.eigenvalues * 300), want, rtol=1e-9)
    assert whitening.identity_error(df, model) < 1e-6  # rounding times the condition number, 3e7


def test_whitening_without_variance(spark):
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0])]).limit(0)).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    flat = whitening.whiten(vectors(spark, [(k, [float(k), 2.0, -float(k)]) for k in range(9)])).collect()
    assert len(flat) == 9 and {r.component for r in flat} == {1} and abs(flat[0].explained - 1) < 1e-12


def test_deviations_beyond_a_long():
    model = whitening.Whitening(3, (3 << 61, 0), np.eye(2), np.ones(2), 1.0)
    x = np.array([[1 << 61, 5], [(1 << 61) + 1, 0], [-(1 << 62), 0]])
    assert model.squares(x) == [225, 9, None]
    assert model.centred(x)[:2].tolist() == [[0, 5], [1, 0]]


def test_grid(spark):
    df = spark.createDataFrame([([0.01, -0.01, 3.0],), ([None],), (None,), ([],), ([float("nan")],)], "v array<float>")
    assert [r[0] for r in df.select(whitening.on_grid(F.col("v"))).collect()] == [[1000000, 999999, 1000192], None, None, [], None]


# Sketches


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def share(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def prose(rng, n):
    return " ".join(f"w{rng.randrange(60)}" for _ in range(n))


def documents():
    rng = random.Random(9)
    rows = [(7 * k % 101, prose(rng, rng.choice([1, 3, 5, 30, 80]))) for k in range(60)]
    rows += [(200, None), (201, ""), (202, " \t "), (203, "É ß 日本 " * 40), (204, prose(rng, 20_000)), (205, rows[0][1]), (206, rows[0][1])]
    rng.shuffle(rows)
    return rows


def followed(rows):
    order = sorted(rows)
    out = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        k = len(t) // 4
        out.append((i, t, t[: len(t) - k] + after[:k], after))
    return out


@pytest.mark.parametrize("parts", [1, 4, 50])
def test_sketches_by_brute_force(spark, parts):
    """With all hashes kept, likeness is the similarity of shingle sets."""
    rows = documents()
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.doc_id: r for r in scaled_sketch.compared(table(spark, rows), rule=scaled_sketch.Rule(scale=1)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    want = followed(rows)
    assert len(got) == len(want)
    for i, t, e, after in want:
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert abs(r.near_edited - share(shingles(t), shingles(e))) < 1e-12 and abs(r.near_next - share(shingles(t), shingles(after))) < 1e-12
        held = len(shingles(t) & shingles(after)) / len(shingles(t)) if shingles(t) and shingles(after) else share(shingles(t), shingles(after))
        assert abs(r.held_by_next - held) < 1e-12 and len(r.fingerprint) == 16 * len(shingles(t))
    assert got[205].fingerprint == got[206].fingerprint == got[next(i for i, t in rows if t == rows[[x for x, _ in rows].index(205)][1])].fingerprint


def test_sketch_query_by_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r for r in queries.op13_scaled_sketches(spark, SF).collect()}
    want = followed(rows)
    assert len(got) == len(want)
    off = []
    for i, t, e, after in want:
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        off.append(r.near_edited - share(shingles(t), shingles(e)))
    assert abs(np.mean(off)) < 0.02 and np.abs(off)[[len(t) > 2000 for _, t, _, _ in want]].max() < 0.15
    by_text = {}
    for i, t, _, _ in want:
        by_text.setdefault(t, set()).add(got[i].fingerprint)
    assert all(len(f) == 1 for f in by_text.values())


def test_repeated_identifiers_and_rows(spark):
    """Rows of one identifier follow each other by their text's hash; equal rows stay."""
    rows = [(1, "a b c d e f g h")] * 5 + [(1, f"t{k} " * 9) for k in range(40)] + [(None, "n " * 20), (None, "m " * 20), (2, "z " * 30)]
    got = scaled_sketch.compared(table(spark, rows)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    again = scaled_sketch.compared(table(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert scaled_sketch.compared(table(spark, rows).limit(0)).count() == 0
    alone = scaled_sketch.compared(table(spark, rows[-1:])).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
    big = [(2**60 + k, f"{k} " * 12) for k in range(60)] + [(None, "null " * 12)]
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    after = {r.doc_id: r for r in scaled_sketch.compared(table(spark, big)).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    for i, t, e, _ in followed([(i or 0, t) for i, t in big]):
        assert after[i or None].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
    no_ids = scaled_sketch.compared(table(spark, [(None, "p q r s t"), (None, None)])).collect()
    assert len(no_ids) == 2


def test_sketches_merge_and_contain(spark):
    """A union's sketch is the union of sketches, and small texts in large ones are contained."""
    rng = random.Random(4)
    rule = scaled_sketch.Rule()
    small, other = prose(rng, 400), prose(rng, 9_000)
    texts = [small, other, f"{other} {small}", "one", "two", "one", "", None]
    column = {k: s for k, s in enumerate(rule.sketches(pa.array(texts)))}
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    made = scaled_sketch.sketch(df)
    assert {r.doc_id: r.sketch for r in made.collect()} == {k: s.tolist() for k, s in column.items()}
    a, b = made.toDF("i", "a"), made.toDF("j", "b")
    ab = a.join(b, F.col("i") <= F.col("j")).select("i", "j", scaled_sketch.jaccard(F.col("a"), F.col("b")).alias("near"), scaled_sketch.containment(F.col("a"), F.col("b")).alias("held"), scaled_sketch.merged(F.col("a"), F.col("b")).alias("m"))
    for r in ab.collect():
        near, held, _ = scaled_sketch.similarity(column[r.i], column[r.j], rule.threshold)
        assert (r.near, r.held) == pytest.approx((near, held))
        both = sorted({*column[r.i].tolist(), *column[r.j].tolist()})
        assert r.m == ([h for h in both if h < rule.threshold] or both[:1])
    assert scaled_sketch.similarity(column[0], column[2], rule.threshold)[1] > 0.95
    assert scaled_sketch.similarity(column[3], column[5], rule.threshold) == (1.0,) * 3 and scaled_sketch.similarity(column[3], column[4], rule.threshold)[0] < 1
