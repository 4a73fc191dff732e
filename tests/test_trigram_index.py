"""The trigram index: no file is lost, few are proposed, and searches by way of it find the same rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftline.operators import search
from siftline.sources import corpus, trigram_index
from siftline.spec import SearchSpec

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    index = str(tmp_path_factory.mktemp("index") / "trigrams")
    files = corpus.documents(spark.read.parquet(f"{SF}/documents.parquet"))
    trigram_index.build(files, index, shares=3, buckets=8)
    return files, index


def paths(df):
    return {r["full_path"] for r in df.select("full_path").collect()}


@pytest.mark.parametrize("literal", ["license", "the", "THE", "schön", "ï", "über", "ab", "", "no such text 123", "0", "é la", "Apache License, Version"])
def test_candidates_hold_every_match(spark, indexed, literal):
    files, index = indexed
    truth = paths(files.where(F.contains(F.lower("text"), F.lower(F.lit(literal)))))
    by_spark = paths(trigram_index.candidates(spark, index, literal))
    trigram_index.register(spark)
    by_source = paths(spark.read.format("trigram_index").option("literal", literal).load(index))
    assert truth <= by_spark == by_source
    if len(literal) < 3 and literal.isascii():
        assert by_spark == paths(files)


def test_few_texts_are_read(spark, indexed):
    files, index = indexed
    proposed = trigram_index.searched(files, index, SearchSpec("license"))
    assert 0 < proposed.count() < files.count() / 10


def test_literals_by_filter_and_in_sql(spark, indexed):
    files, index = indexed
    trigram_index.register(spark)
    files.createOrReplaceTempView("indexed_files")
    spark.read.format("trigram_index").load(index).createOrReplaceTempView("index_of_files")
    got = spark.sql("SELECT full_path FROM index_of_files JOIN indexed_files USING (full_path) WHERE literal = 'license' AND contains(lower(text), 'license')")
    assert paths(got) == paths(files.where(F.contains(F.lower("text"), F.lit("license"))))
    with pytest.raises(Exception, match="literal"):
        spark.read.format("trigram_index").load(index).count()


@pytest.mark.parametrize("spec", [SearchSpec("license"), SearchSpec("The", case_sensitive=True), SearchSpec("the", whole_word=True), SearchSpec("ete", diacritic_sensitive=False), SearchSpec("li[a-z]+se", regex=True), SearchSpec("É", case_sensitive=True)])
def test_searches_find_the_same_rows(spark, indexed, spec):
    files, index = indexed
    rows = lambda f: sorted(map(str, search.content_rows(f, spec).collect()))
    assert rows(trigram_index.searched(files, index, spec)) == rows(files)


def test_letters_whose_case_depends_on_neighbours(spark, tmp_path):
    texts = ["ΟΔΟΣ εδώ", "οδός", "İstanbul", "K2 KELVIN", "ab\U0001f600cd", None, "", "xy"]
    files = corpus.as_files(spark.createDataFrame([(f"{k}.txt", t) for k, t in enumerate(texts)], "p string, t string"), F.col("p"), F.col("t"))
    index = str(tmp_path / "ix")
    trigram_index.build(files, index, shares=2)
    for literal in ("ΟΔΟΣ", "οδος", "İstanbul", "KELVIN", "kelvin", "\U0001f600cd", "stanbul"):
        truth = paths(files.where(F.contains("text", F.lit(literal)) | F.contains(F.lower("text"), F.lower(F.lit(literal)))))
        assert truth <= paths(trigram_index.candidates(spark, index, literal)), literal


def test_added_files_and_small_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trigram_index, "CHUNK_FILES", 5)
    monkeypatch.setattr(trigram_index, "SLICE_BYTES", 40)
    rng = random.Random(1)
    rows = [(f"{k}.txt", " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randrange(30)))) for k in range(60)]
    table = spark.createDataFrame(rows, "p string, t string")
    files = corpus.as_files(table, F.col("p"), F.col("t"))
    index = str(tmp_path / "ix")
    trigram_index.build(files.where(F.col("relative_path") < "3"), index, shares=2)
    trigram_index.build(files.where(F.col("relative_path") >= "3"), index, shares=9)
    for literal in ("alpha", "a b", "gamma gamma"):
        truth = {f"/corpus/{p}" for p, t in rows if literal in t}
        assert truth <= paths(trigram_index.candidates(spark, index, literal)) <= {f"/corpus/{p}" for p, t in rows}
    trigram_index.build(files.limit(0), str(tmp_path / "empty"))
    assert trigram_index.candidates(spark, str(tmp_path / "empty"), "alpha").count() == 0


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    pairs = np.unique(rng.integers(0, 50, 5000) << 16 | rng.integers(0, 4096, 5000))
    trigrams, files, blocks = trigram_index.encoded(pairs >> 16, pairs & 0xFFFF)
    for t, n, b in zip(trigrams, files, blocks.to_pylist()):
        want = (pairs & 0xFFFF)[pairs >> 16 == t]
        assert n == len(want) and (trigram_index.decoded(b) == want).all()


def test_distinct_of_a_slice():
    texts = pa.array(["abcd", "zz", "abc", None])
    got = trigram_index._pairs(texts.slice(1), 7)
    assert got.tolist() == [int.from_bytes(b"abc", "big") << 16 | 8]
