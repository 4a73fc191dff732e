"""Every registered query of the search engine against its SQL, at the smallest scale."""

import math

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftline.plans import queries as plans
from siftline.sources.shared import BATCH_BYTES

SF = "/root/testdata/sf0.001"
TABLES = "customer events documents pages labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    tidy = lambda x: None if isinstance(x, float) and math.isnan(x) else x
    return sorted((tuple(tidy(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in plans.SQL:
        assert df.columns
        return
    res = duck.execute(plans.SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(names, res.fetchall())


def test_entry_has_rows(spark):
    assert plans.entry(spark, SF).count() == 3


@pytest.mark.parametrize("name", ["charset_guess", "docs_extract", "docs_extract_all", "decode_text", "replace_regex", "folded_text", "sql_functions"])
def test_batches_of_whole_texts_are_bounded_by_bytes(spark, name):
    """What a Python function is given at once, after a query over whole texts was built."""

    @F.pandas_udf("long")
    def given(texts: pd.Series) -> pd.Series:
        return pd.Series([texts.str.len().sum()] * len(texts))

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    plans.QUERIES[name](spark, SF)
    wide = spark.range(0, 600, 1, 1).select(F.repeat(F.lit("x"), 50_000).alias("text"))
    assert wide.select(given("text").alias("n")).agg(F.max("n")).head()[0] <= BATCH_BYTES + 50_000
