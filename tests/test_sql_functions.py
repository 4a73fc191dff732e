from siftline.functions import sql


def test_functions_in_sql(spark):
    assert sql.register(spark) == ["fold_text", "literal_spans", "regex_spans", "decode_bytes"]
    row = spark.sql(
        "SELECT fold_text('Crème') AS f, fold_text(null) AS n, literal_spans('İ a A', 'a') AS l, literal_spans('a', ' ') AS b, regex_spans('ab12', '[0-9]+') AS r,"
        " decode_bytes(unhex('EFBBBF41')) AS d, literal_spans(cast(null AS string), 'a') AS m"
    ).head()
    assert row.f == "creme" and row.n is None and row.m is None and row.b == []
    assert [tuple(s) for s in row.l] == [(2, 3), (4, 5)] and [tuple(s) for s in row.r] == [(2, 4)]
    assert tuple(row.d) == ("A", "UTF-8 BOM")


def test_table_functions(spark):
    sql.register(spark)
    assert sql.register_tables(spark) == ["ignore_eval", "extract_text", "pack"]
    df = spark.createDataFrame([("a.rtf", rb"{\rtf1 x\par y}"), ("b.txt", b"caf\xe9"), ("c.docx", b"broken"), ("d", None)], "path string, content binary")
    df.createOrReplaceTempView("raw_files")
    got = {r.path: (r.text, r.encoding, r.error is None) for r in spark.sql("SELECT path, e.* FROM raw_files, LATERAL extract_text(path, content) e").collect()}
    assert got == {"a.rtf": ("x\ny", "UTF-8", True), "b.txt": ("café", "windows-1252", True), "c.docx": (None, None, False), "d": (None, None, False)}
    taken = spark.sql("SELECT p.* FROM (SELECT from_json('[{\"path\":\"x\",\"text\":\"aaaa\"},{\"path\":\"x\",\"text\":\"bbbb\"},{\"path\":\"y\",\"text\":\"cc\"},{\"path\":\"z\"}]', 'array<struct<path:string,text:string>>') AS s) t, LATERAL pack(t.s, 7) p ORDER BY taken_at").collect()
    assert [(r.path, r.snippet, r.text) for r in taken] == [("x", 1, "aaaa"), ("y", 1, "cc"), ("z", 1, "")]
    row = spark.sql("SELECT ignore_eval('a/x.log', '*.log') AS a, ignore_eval('a/x.log', '!*.log') AS b, ignore_eval(NULL, 'x') AS c, size(literal_spans('The the', 'the')) AS d, size(literal_spans('The the', 'the', true)) AS e").first()
    assert tuple(row) == (True, False, None, 2, 1)
