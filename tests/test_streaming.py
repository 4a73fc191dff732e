from siftline.streaming import search as stream
from siftline.spec import SearchSpec

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stream(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    for k, text in enumerate(("the license", "nothing", "License\nlicense")):
        spark.createDataFrame([(k, text, "en", "s", len(text))], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    files = stream.arriving_documents(spark, str(folder), SCHEMA, files_at_once=1)
    q = stream.search_stream(files, SearchSpec("license"), lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(out))
    assert sorted((r.file_name, r.line_number) for r in got.collect()) == [("0.txt", 1), ("2.txt", 1), ("2.txt", 2)]
    events = stream.progress(got).groupBy("event").count().collect()
    assert {r.event: r["count"] for r in events} == {"Match": 3, "FileScanned": 2}


def test_windowed_events(spark):
    df = stream.windowed_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    assert df.columns == ["window_start", "event_type", "n"]
    assert df.agg({"n": "sum"}).first()[0] == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_rows_are_handed_on(spark):
    """As many as a view takes at once, or what came in the time between; all of them in order."""
    rows, seen = spark.range(0, 10_000, 1, 7).select("id"), []
    assert stream.handed_on(rows, lambda held: seen.append([r.id for r in held]), clock=lambda: 0.0) == 10_000
    assert [len(s) for s in seen] == [4096, 4096, 1808] and sum(seen, []) == list(range(10_000))
    ticks, seen = iter(range(10**6)), []
    assert stream.handed_on(rows.limit(25), lambda held: seen.append(len(held)), every=10, clock=lambda: next(ticks)) == 25
    assert seen == [10, 10, 5]
    assert stream.handed_on(rows.limit(0), seen.append) == 0
