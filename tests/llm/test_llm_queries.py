"""The numbered queries and the pipeline over the smallest tables."""

import itertools
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftline.llm import cgk_leaks, jaccard_join, queries
from siftline.llm.support import table

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_lm_score": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op2_quality_votes": "doc_id held_out score predicted",
    "op3_repeat_removal": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op4_html_text": "page_id url text n_chars",
    "op5_benchmark_leaks": "doc_id item_id",
    "op6_hamming_topk": "query_id rank vec_id distance",
    "op7_jaccard_join": "doc_id n_shingles component_id",
    "op8_secret_scans": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op9_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op10_source_mix": "doc_id size source_size target taken",
    "op11_spelling_variants": "word form root n n_near form_n",
    "op12_whitened_vectors": "vec_id component n deviation whitened explained identity_error",
    "op13_scaled_sketches": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_rows_and_columns(spark, name):
    df = queries.queries()[name](spark, SF)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    if "doc_id" in df.columns and name != "op5_benchmark_leaks":
        assert Counter(r.doc_id for r in df.select("doc_id").collect()) == Counter(r.doc_id for r in table(spark, SF, "documents").select("doc_id").collect())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    res = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(map(str, res.fetchall())) == sorted(str(tuple(r)) for r in queries.queries()[name](spark, SF).select(*names).collect())


def test_leaks_against_brute_force(spark):
    """Items that stand in a document word for word are all found."""
    norm = lambda t: " ".join("".join(c if c.isalnum() or ord(c) > 127 else " " for c in (t or "").lower()).split())
    docs = {r.doc_id: f" {norm(r.text)} " for r in table(spark, SF, "documents").collect()}
    items = {r.item_id: f" {norm(r.text)} " for r in table(spark, SF, "benchmark").collect()}
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    got = {(r.doc_id, r.item_id) for r in queries.op5_benchmark_leaks(spark, SF).collect() if r.edits == 0}
    assert want and got == want


def shingled(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def test_near_copies_by_brute_force(spark):
    """Every pair of documents, with no part of the library."""
    docs = table(spark, SF, "documents")
    sets = {r.doc_id: shingled(r.text) for r in docs.collect()}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            low, high = sorted((top(a), top(b)))
            root[high] = low
    want = {i for i in sets if top(i) == i}
    got = corpus_pipeline.near_copies(spark, docs, SF).collect()
    assert len(want) < len(sets) and sorted(r.doc_id for r in got) == sorted(want)


def edits(item, words):
    """The least number of words changed, added or left out between the item and any passage."""
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        last, row = row, [i]
        for j, y in enumerate(words, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
    return min(row)


def test_benchmark_passages_by_brute_force(spark):
    """What goes holds an item within a fifth of its words; what holds one word for word goes."""
    norm = lambda t: "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (t or "").lower()).split()
    docs = {r.doc_id: norm(r.text) for r in table(spark, SF, "documents").collect()}
    items = [norm(r.text) for r in table(spark, SF, "benchmark").collect()]
    kept = {r.doc_id for r in corpus_pipeline.benchmark_passages(spark, table(spark, SF, "documents"), SF).collect()}
    whole = {d for d, w in docs.items() if any(f" {' '.join(x)} " in f" {' '.join(w)} " for x in items if len(x) >= 5)}
    assert whole and not whole & kept and kept <= docs.keys()
    for d in docs.keys() - kept - whole:
        assert any(5 * edits(x, docs[d]) <= len(x) for x in items if len(x) >= 5)


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, SF).cache()
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    kept = {r.doc_id for r in good.collect()}
    clean = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in clean) >= 0.95 * len(clean)
    one = stages["near_copies"](spark, good, SF).cache()
    found = {r.doc_id: r.component_id for r in jaccard_join.linked(good, corpus_pipeline.NEAR).collect()}
    assert {r.doc_id for r in one.collect()} == set(found.values()) and one.count() == len(set(found.values()))
    clear = stages["benchmark_passages"](spark, one, SF).cache()
    hit = {r.doc_id for r in cgk_leaks.find(one, table(spark, SF, "benchmark")).collect()}
    assert {r.doc_id for r in clear.collect()} == {r.doc_id for r in one.collect()} - hit
    masked = stages["secrets"](spark, clear, SF).cache()
    assert masked.count() == clear.count() and masked.where(F.col("n_chars") != F.length("text")).count() == 0
    assert masked.where(F.col("text").contains("[SECRET]")).count() > 0
    for df in (good, one, clear, masked):
        assert df.columns == columns
    last = stages["mixture"](spark, masked, SF)
    assert last.count() == masked.count() and last.where("taken > 3 * size").count() == 0
    assert corpus_pipeline.run(spark, SF).count() == masked.count()


def test_crc(spark):
    df = spark.createDataFrame([(7,), (None,)], "doc_id long").select(queries.remainder("doc_id", 5))
    assert [r[0] for r in df.collect()] == [zlib.crc32(b"7") % 5, None]


def test_lm_score_reads_three_word_context(spark, tmp_path):
    group = {k: [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == k] for k in range(5)}
    learned = [i for k in (0, 2, 3, 4) for i in group[k]]
    rows = [(i, ("a b c", "x b d")[n % 2]) for n, i in enumerate(learned)]
    rows += [(group[1][0], "a b c"), (group[1][1], "a b d")]  # alike in all single words and pairs
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["score"] for r in queries.op1_lm_score(spark, str(tmp_path)).where("held_out").collect()}
    assert got[group[1][0]] > got[group[1][1]] + 0.2
