import dataclasses
import json
import random

import pytest
from pyspark.sql import functions as F

from siftline.functions import folding
from siftline.operators import aggregate, context, evidence, records, replace, search, view
from siftline.operators import predicates as p
from siftline.sinks import rows as sinks
from siftline.sinks import saved
from siftline.sources import corpus, grep_output
from siftline.spec import SearchSpec

LINES = "a\r\nb\rc\n\nlast"


def files(spark, *rows):
    df = spark.createDataFrame([(f"d/{n}", t) for n, t in rows], "path string, text string")
    return corpus.as_files(df, F.col("path"), F.col("text"), root="/r")


def test_lines(spark):
    f = files(spark, ("x.txt", LINES), ("e.txt", ""), ("n.txt", None), ("t.txt", "one\n"))
    got = {(r.file_name, r.line_number): r.line for r in search.lines_of(f).collect()}
    assert got == {("x.txt", 1): "a", ("x.txt", 2): "b\rc", ("x.txt", 3): "", ("x.txt", 4): "last", ("t.txt", 1): "one"}


def test_engines_agree(spark):
    f = files(spark, ("x.txt", "The the Thé\n😀 the end\nbathe"), ("y.txt", None))
    for spec in (SearchSpec("the"), SearchSpec("the", case_sensitive=True), SearchSpec("t[h]e", regex=True)):
        assert search.plain(spec)
        a = search.matching_lines(f, spec).select("line_number", "match_count", "start").collect()
        from siftline.functions.folding import finder

        find = finder(spec)
        want = [(i + 1, len(find(x)), find(x)[0][0]) for i, x in enumerate("The the Thé\n😀 the end\nbathe".split("\n")) if find(x)]
        assert sorted(map(tuple, a)) == want


def test_places_after_letters_that_lower_case_lengthens(spark):
    f = files(spark, ("x.txt", "\u0130\u0130 LICENSE here\nx\u0130\nplain license"))
    got = search.content_rows(f, SearchSpec("license")).orderBy("line_number").collect()
    assert [(r.line_number, r.column_number, r.match_preview_before, r.match_preview_match) for r in got] == [(1, 4, "\u0130\u0130 ", "LICENSE"), (3, 7, "plain ", "license")]
    got = search.content_rows(f, SearchSpec("xi")).collect()
    assert [(r.line_number, r.column_number, r.match_preview_match) for r in got] == [(2, 1, "x\u0130")]


def test_blank_term_and_limits(spark):
    f = files(spark, ("a.txt", "x\nx\nx"), ("a-b.txt", "x"))
    assert search.content_rows(f, SearchSpec("  ")).count() == 0
    got = search.content_rows(f, SearchSpec("x", max_results=2)).collect()
    assert len(got) == 2


def test_path_order(spark):
    df = spark.createDataFrame([("a/x",), ("a-b",)], "full_path string")
    assert [r[0] for r in df.orderBy(search.path_order()).collect()] == ["a/x", "a-b"]


def test_previews(spark):
    line = "p" * 300 + "KEY" + "q" * 300
    r = search.content_rows(files(spark, ("x.txt", line)), SearchSpec("key")).first()
    assert (r.column_number, r.match_preview_before, r.match_preview_match, r.match_preview_after) == (301, "p" * 120, "KEY", "q" * 120)
    assert r.line_content == line[:400]


def test_file_rows_of_missing_files(spark):
    f = files(spark, ("x.txt", "x\nx x"))
    rows = search.content_rows(f, SearchSpec("x"))
    r = aggregate.file_rows(rows, f.where("false")).first()
    assert (r.match_count, r.size, r.encoding, r.date_modified_unix, len(r.preview_matches)) == (3, 0, "UTF-8", None, 2)


def test_size_tolerance(spark):
    df = spark.createDataFrame([(n * 1024,) for n in (0, 9, 10, 11, 30, 31)], "size long")
    fits = lambda **k: [r[0] // 1024 for r in df.where(p.size_fits(F.col("size"), SearchSpec("x", **k))).collect()]
    assert fits(size_limit=20, size_type="less") == [0, 9, 10, 11, 30]
    assert fits(size_limit=20, size_type="greater") == [10, 11, 30, 31]
    assert fits(size_limit=20, size_type="equal") == [10, 11, 30]
    assert len(fits(size_limit=5, size_type="greater")) == 6


def test_hidden_and_subfolders(spark):
    df = spark.createDataFrame([("a/b.txt",), (".h/c.txt",), ("top.txt",)], "relative_path string")
    names = lambda spec: sorted(r[0] for r in p.walkable(df, spec).collect())
    assert names(SearchSpec("x")) == ["a/b.txt", "top.txt"]
    assert names(SearchSpec("x", include_hidden=True, include_subfolders=False)) == ["top.txt"]


def test_within_with_bad_pattern(spark):
    rows = search.content_rows(files(spark, ("x.txt", "x")), SearchSpec("x"))
    assert view.within(rows, "(", regex=True).count() == 0
    assert view.within(rows, " ").count() == 1


def test_preview_windows(spark):
    f = files(spark, ("x.txt", "1\n2\n3\n4"))
    want = spark.createDataFrame([("/r/d/x.txt", 1), ("/r/d/x.txt", 3), ("/r/d/x.txt", 9), ("/r/d/x.txt", 0)], "full_path string, line_number long")
    got = {r.line_number: ([x.content for x in r.lines], r.match_line_index) for r in context.preview(f, want, 1, 1).collect()}
    assert got == {1: (["1", "2"], 0), 3: (["2", "3", "4"], 1), 9: ([], None)}
    assert context.clamped(0) == 1 and context.clamped(99) == 20


def test_packing():
    s = [("a", 1, "x" * 40), ("a", 2, "x" * 10), ("b", 1, "y" * 50), ("b", 2, "y" * 10)]
    assert [x[:2] for x in evidence.pack(s, 100)] == [("a", 1), ("b", 1), ("a", 2)]
    assert [x[:2] for x in evidence.pack(s, 60)] == [("a", 1), ("a", 2)]


def test_replace_paths(spark):
    f = files(spark, ("x.txt", "Straße strasse\nLic"), ("y.docx", "lic"), ("z.txt", "no"))
    spec = SearchSpec("lic", include_binary=True)
    got = {r.full_path: (r.status, r.new_text) for r in replace.replaced(f, spec, "$1\\").collect()}
    assert got["/r/d/x.txt"] == ("modified", "Straße strasse\n$1\\")
    assert got["/r/d/y.docx"][0] == "failed"
    assert "/r/d/z.txt" not in got
    whole = replace.replaced(f, SearchSpec("(s)tra", regex=True, whole_word=False, engine="extended"), "[$1]").collect()
    assert [r.new_text for r in whole] == ["[S]ße [s]sse\nLic"]


def test_replace_limits_files_only_if_asked(spark, monkeypatch):
    monkeypatch.setattr(replace, "MOST_FILES", 1, raising=False)  # was the limit of every operation
    f = files(spark, ("b.txt", "lic lic"), ("a.txt", "lic"))
    spec = SearchSpec("lic")
    assert replace.summary(replace.replaced(f, spec, "x")).collect() == [(2, 0, 0, 3)]
    assert [tuple(r) for r in replace.summary(replace.replaced(f, spec, "x", most_files=1)).collect()] == [(1, 0, 0, 1, True)]
    assert [tuple(r) for r in replace.summary(replace.replaced(f, spec, "x", most_files=2)).collect()] == [(2, 0, 0, 3, False)]


def test_csv_guard(spark):
    df = spark.createDataFrame([("=1",), ('a"b',), ("a,b",), ("plain",), ("-x,y",)], "v string")
    assert [r[0] for r in df.select(sinks.csv_field(F.col("v"))).collect()] == ["'=1", '"a""b"', '"a,b"', "plain", '"\'-x,y"']


def test_conditions(spark):
    df = spark.createDataFrame([(1, '{"k": 5, "s": "abc"}'), (2, '{"k": "x"}'), (3, None), (4, '{"k": 10}')], "id long, props string")
    ids = lambda *c: [r.id for r in records.filtered(df, list(c)).orderBy("id").collect()]
    assert ids(("k", "gt", "5")) == [4]
    assert ids(("k", "ne", "5")) == [4]
    assert ids(("k", "unknown", "5")) == [1]
    assert ids(("s", "contains", "b")) == [1]
    assert ids() == [1, 2, 3, 4]


def test_recent_and_history(spark):
    df = spark.createDataFrame([("a", "/p", 1), ("A", "/q", 3), ("a", "/p", 5)], "term string, path string, at long")
    got = records.recent(df, records.identity([F.col("term"), F.col("path")]), "at").collect()
    assert [(r.term, r["at"]) for r in got] == [("a", 5), ("A", 3)]
    assert records.history_matches(df, "/Q").count() == 1


def test_grep_output(spark):
    df = spark.createDataFrame([("/a:3:x the the",), ("/b\x007:no",), ("junk",), ("/a:z:x",)], "line string")
    got = sorted((r.container_path, r.line_number, r.column_number) for r in grep_output.occurrences(df, SearchSpec("the")).collect())
    assert got == [("/a", 3, 3), ("/a", 3, 7), ("/b", 7, 1)]


def test_summary_and_exit_code(spark):
    f = files(spark, ("x.txt", "x x"), ("y.png", "x"))
    r = aggregate.summary(f, SearchSpec("x")).first()
    assert (r.files_scanned, r.files_matched, r.matches, r.skipped_files, r.capped) == (1, 1, 2, 1, False)
    assert sinks.exit_code(search.content_rows(f, SearchSpec("x"))) == 0
    assert sinks.exit_code(search.content_rows(f, SearchSpec("zz"))) == 1


def test_line_limits_in_both_tiers(spark):
    """Whole lines count unless limits are asked; then both tiers cut alike."""
    long = "é" * (1 << 20) + " the"  # the term begins where 2 MiB end
    f = files(spark, ("x.txt", long + "\n" + "the " * 10_050))
    for spec in (SearchSpec("the", include_binary=True), SearchSpec("the", whole_word=True), SearchSpec("the", diacritic_sensitive=False)):
        got = lambda s: {r.line_number: r.match_count for r in search.matching_lines(f, s).select("line_number", "match_count").collect()}
        assert got(spec) == {1: 1, 2: 10_050}
        assert got(dataclasses.replace(spec, line_limits=True)) == {2: 10_000}
    rows = replace.replaced(f, SearchSpec("the", whole_word=True), "a").select("matches").collect()
    assert [r.matches for r in rows] == [10_051]


def test_places_beside_code_points_that_are_no_characters(spark):
    lines = ["﷐﷐ license here", "İ﷐İ license", "﷑ LICENSE ﷐", "ﷰ license"]
    table = spark.createDataFrame([(f"{k}.txt", t) for k, t in enumerate(lines)], "p string, t string")
    rows = search.content_rows(corpus.as_files(table, F.col("p"), F.col("t")), SearchSpec("license")).collect()
    assert {r.file_name: (r.column_number, r.match_preview_match) for r in rows} == {f"{k}.txt": (t.lower().replace("i̇", "i").index("license") + 1, t[t.lower().replace("i̇", "i").index("license") :][:7]) for k, t in enumerate(lines)}


@pytest.mark.parametrize("spec", [SearchSpec("b\nc"), SearchSpec("a[^x]b", regex=True), SearchSpec("b$", regex=True), SearchSpec("B", case_sensitive=True), SearchSpec("b"), SearchSpec("b", whole_word=True), SearchSpec(" ")])
def test_replacing_takes_files_whose_lines_match(spark, spec):
    """In one scan where Spark's expressions tell, and the same files as by lines."""
    texts = ["a\nb", "a b\r\nc", "B", "xb", None, "", "a-b", "c\nb\nc"]
    files = corpus.as_files(spark.createDataFrame([(f"{k}.txt", t) for k, t in enumerate(texts)], "p string, t string"), F.col("p"), F.col("t"))
    got = {r.full_path for r in replace.replaced(files, spec, "z").collect()}
    assert got == {r.full_path for r in search.content_rows(files, spec).select("full_path").distinct().collect()}
    assert {r.full_path for r in replace.replaced(files, spec, "z", most_files=2).collect()} == set(sorted(got)[:2])
    if search.file_test(spec) is not None:
        plan = replace.replaced(files, spec, "z")._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan


FOLDS = [SearchSpec(t, **o) for t in ("ete", "É", "straße", "ς", "i", "ﬁ", "가", "½", "ée") for o in ({"diacritic_sensitive": False}, {"normalization": "NFC"}, {"normalization": "NFKD"}, {"normalization": "NFKC", "diacritic_sensitive": False}, {"comparison": "current", "culture": "tr"}, {"comparison": "current", "culture": "lt-LT"}, {"diacritic_sensitive": False, "case_sensitive": True}, {"diacritic_sensitive": False, "whole_word": True}, {})]


def test_coarse_forms_keep_what_searches_fold():
    """For every code point, folding it by any search changes nothing of its coarse form; the forms are those of all planes."""
    specs = {dataclasses.replace(s, term="x") for s in FOLDS}
    one, none, more = folding._coarse_forms()
    known = {c: f for f, codes in one.items() for c in codes} | dict.fromkeys(none, "") | {c: f for f, c in more}
    for code in (*range(0xD800), *range(0xE000, 0x110000)):
        char = chr(code)
        form = folding.coarse(char)
        assert known.get(code, char) == form and folding.coarse(form) == form
        if form != char or char.lower() != char:
            assert all(folding.coarse(folding.folded(char, s)) == form for s in specs), hex(code)


def test_folded_searches_lose_nothing(spark):
    """Spark's test before Python's matching, against matching every line."""
    rng = random.Random(6)
    alphabet = ["e", "t", "E", "é", "É", "é", "ı", "I", "İ", "i̇", "ß", "ẞ", "s", "S", "Σ", "ς", "σ", "ﬁ", "f", "i", "가", "ᄀ", "ᅡ", "½", "1⁄2", " ", "ｅ", "𝐞", "̣", "ṭ", "straße", "STRASSE", "-", "été"]
    lines = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 9))) for _ in range(1500)]
    table = corpus.as_files(spark.createDataFrame([(f"{k}.txt", t) for k, t in enumerate(lines)], "p string, t string"), F.col("p"), F.col("t")).cache()
    for spec in (s for s in FOLDS if not search.plain(s)):
        got = {r.file_name: (r.match_count, r.start, r.length) for r in search.matching_lines(table, spec).collect()}
        spans = {f"{k}.txt": folding.finder(spec)(t) for k, t in enumerate(lines)}
        assert got == {n: (len(s), s[0][0], s[0][1] - s[0][0]) for n, s in spans.items() if s}, spec


@pytest.mark.parametrize("options", [{}, {"case_sensitive": True}])
def test_whole_words_in_spark(spark, options):
    rng = random.Random(2)
    alphabet = ["the", "The", "THE", " ", "_", "é", "İ", "i", "-", "3", "²", "﷐", "𝐞", "x", "́", "字"]
    lines = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 10))) for _ in range(1500)]
    table = corpus.as_files(spark.createDataFrame([(f"{k}.txt", t) for k, t in enumerate(lines)], "p string, t string"), F.col("p"), F.col("t"))
    spec = SearchSpec("the", whole_word=True, **options)
    assert search.plain(spec)
    got = {r.file_name: (r.match_count, r.start, r.length) for r in search.matching_lines(table, spec).collect()}
    spans = {f"{k}.txt": folding.finder(spec)(t) for k, t in enumerate(lines)}
    assert got == {n: (len(s), s[0][0], s[0][1] - s[0][0]) for n, s in spans.items() if s}
    assert {r.full_path for r in replace.replaced(table, spec, "z").collect()} == {f"/corpus/{n}" for n, s in spans.items() if s}


def test_rows_as_whole_outputs(spark):
    f = files(spark, ("b.txt", "x\nno\nx"), ("a/c.txt", "x"), ("a.txt", "x,"))
    rows = search.content_rows(f, SearchSpec("x"))
    got = json.loads("\n".join(r.line for r in sinks.json_array(rows).collect()))
    assert [(r["relative_path"], r["line_number"]) for r in got] == [("d/a/c.txt", 1), ("d/a.txt", 1), ("d/b.txt", 1), ("d/b.txt", 3)]
    assert [r.line for r in sinks.json_array(rows.limit(0)).collect()] == ["[]"]
    table = [r.row for r in sinks.csv_table(rows).collect()]
    assert table[0] == "File,Line,Column,Content,FullPath,MatchCount" and sorted(table[1:]) == sorted(r.row for r in sinks.csv_rows(rows).collect()) and '"x,"' in table[2]
    assert [r.full_path for r in aggregate.files_in_order(rows).collect()] == ["/r/d/a/c.txt", "/r/d/a.txt", "/r/d/b.txt"]
    assert sinks.exit_code_of(lambda: search.content_rows(f, SearchSpec("x").for_command())) == 0
    assert sinks.exit_code_of(lambda: search.content_rows(f, SearchSpec("zz").for_command())) == 1
    for bad in (lambda: search.content_rows(f, SearchSpec("").for_command()), lambda: search.content_rows(f, SearchSpec("(", regex=True)), lambda: spark.read.parquet("/none/there")):
        assert sinks.exit_code_of(bad) == 2
    with pytest.raises(ZeroDivisionError):
        sinks.exit_code_of(lambda: 1 // 0)


def test_saved_records(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(saved, "FOLDERS", 4)
    schema, path = "name string, n long", str(tmp_path / "saved")
    put = lambda *rows: saved.put(spark.createDataFrame(list(rows), schema), path, schema, "name", "n")
    all_ = lambda: sorted(tuple(r) for r in saved.saved(spark, path, schema, "name").collect())
    put(*[(f"name {k}", k) for k in range(20)], ("", 1), (None, 2), ("  ", 3), ("Ä", 4), ("ä", 5))
    assert all_() == sorted([*((f"name {k}", k) for k in range(20)), ("Ä", 4), ("ä", 5)])
    before = {p.name: {f.name for f in p.iterdir()} for p in (tmp_path / "saved").glob("folder=*")}
    put(("NAME 3", 30), ("Name 3", 31))
    after = {p.name: {f.name for f in p.iterdir()} for p in (tmp_path / "saved").glob("folder=*")}
    assert sum(before[f] != after[f] for f in before) == 1 and ("Name 3", 31) in all_() and len(all_()) == 22
    saved.remove(spark.createDataFrame([("nAME 4",), ("none",), (None,), ("",)], "name string"), path, schema, "name")
    assert len(all_()) == 21 and not any(n == "name 4" for n, _ in all_())
    for k in range(20):
        if k % 2:
            saved.remove(spark.createDataFrame([(f"name {k}",)], "name string"), path, schema, "name")
    assert {n.lower() for n, _ in all_()} == {"ä"} | {f"name {k}" for k in range(0, 20, 2) if k != 4}
    saved.clear(spark, path, schema, "name")
    assert all_() == []
    put(("again", 1))
    assert all_() == [("again", 1)]


@pytest.mark.parametrize(("culture", "text", "want"), [("lt", "\u00cc\u00cd\u0128", "i\u0307\u0300i\u0307\u0301i\u0307\u0303"), ("lt", "J\u0301", "j\u0307\u0301"), ("lt", "\u012e\u0323\u0300x", "\u012f\u0307\u0323\u0300x"), ("lt", "I J I\u0323", "i j i\u0323"), ("tr", "I\u0130", "\u0131i"), ("de", "I\u0301", "i\u0301")])
def test_lower_case_of_cultures(culture, text, want):
    assert folding.lower_of(text, SearchSpec("x", comparison="current", culture=culture)) == want
