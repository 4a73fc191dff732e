import time

import pytest
from pyspark.sql import functions as F

from siftline.operators import aggregate, catalog, evidence, records, replace
from siftline.sinks import journal
from siftline.spec import SearchSpec
from siftline.streaming import feed

NAMES = [("", False), (".x", False), ("a/b", False), ("a\\b", False), ("a b", True), ("a.b", True), ("a\n", True), (None, False)]


def test_safe_names(spark):
    df = spark.createDataFrame(NAMES, "name string, want boolean")
    assert [r for r in df.select("name", catalog.safe_name(F.col("name")).alias("got"), "want").collect() if r.got != r.want] == []


def test_front_matter_round_trip(spark):
    values = ["plain text", "true", "No", "5", "a: b", 'q"uo\\te', "it's", "two\nlines", "", "- x", "é", None, "/srv/a.b"]
    df = spark.createDataFrame([(v, k, k % 2 == 0) for k, v in enumerate(values)], "name string, n long, even boolean")
    text = F.concat(catalog.front_matter(df, "name", "n", "even"), F.lit("\n# body\nname: other\n"))
    got = df.select("name", "n", text.alias("text"), catalog.fields_of(text).alias("p")).select("*", *(F.get_json_object("p", f"$.{c}").alias(f"got_{c}") for c in ("name", "n", "even"))).orderBy("n").collect()
    assert [r.got_name for r in got] == values
    assert [r.got_n for r in got] == [str(k) for k in range(len(values))]
    assert got[0].text == "---\nname: plain text\nn: 0\neven: true\n---\n\n# body\nname: other\n"
    hand = spark.createDataFrame([("---\r\na: 'it''s'\r\na: last\r\nb: ~\r\n---\r\nx",), ("a: b",), (None,), ("---\n---\n",)], "t string")
    assert [r[0] for r in hand.select(catalog.fields_of(F.col("t"))).collect()] == ['{"a":"last"}', "{}", "{}", "{}"]


def write(root, path, text):
    (root / path).parent.mkdir(parents=True, exist_ok=True)
    (root / path).write_text(text)


def test_collections_views_and_stores(spark, tmp_path):
    for k in range(6):
        write(tmp_path, f"notes/a b+{k}.md", f"---\nkind: {'xy'[k % 2]}\nsize: {k}\n---\n")
    write(tmp_path, "notes/sub/deep.md", "no front matter")
    for path in ("notes/schema.md", "top.md", ".index/x.md", "views/v/x.md"):
        write(tmp_path, path, "---\nkind: z\n---\n")
    got = catalog.records_of(spark, str(tmp_path))
    assert {tuple(r) for r in catalog.collections(got).collect()} == {("notes", 7)}
    assert {r.record for r in got.collect()} == {f"a b+{k}.md" for k in range(6)} | {"sub/deep.md"}
    assert {r.record for r in records.filtered(got, [("size", "ge", "4")]).collect()} == {"a b+4.md", "a b+5.md"}
    assert [r.record for r in catalog.browsed(got, "record", 2).collect()] == ["a b+0.md", "a b+1.md"]
    view = catalog.materialized(got, str(tmp_path / "out"), "by kind", "kind")
    assert {(r.group_value, r.n) for r in view.groupBy("group_value").agg(F.count("*").alias("n")).collect()} == {("x", 3), ("y", 3), (None, 1)}
    assert catalog.materialized(got, str(tmp_path / "out"), "all").count() == 7
    assert {r.name for r in catalog.views(spark, str(tmp_path / "out")).collect()} <= {"by kind", "by%20kind", "all"} and catalog.views(spark, str(tmp_path / "out")).count() == 2
    with pytest.raises(ValueError):
        catalog.materialized(got, str(tmp_path), "../x")
    assert catalog.store(spark, str(tmp_path / "none.json"), "a long").count() == 0
    write(tmp_path, "blank.json", "  \n")
    assert catalog.store(spark, str(tmp_path / "blank.json"), "a long").where("a IS NOT NULL").count() == 0
    write(tmp_path, "two.json", '[{"a": 1},\n {"a": 2}]')
    assert sorted(r.a for r in catalog.store(spark, str(tmp_path / "two.json"), "a long").collect()) == [1, 2]
    write(tmp_path, "bad.json", '[{"a": 1')
    with pytest.raises(Exception):
        catalog.store(spark, str(tmp_path / "bad.json"), "a long").collect()


def test_schema_rules(spark):
    df = spark.createDataFrame([(1, 2.0, "x", True, [1])], "a long NOT NULL, b double, c string, d boolean, e array<int>")
    rules = catalog.schema_rules(df, {"b": (0, 1)})
    assert [(r["name"], r["type"], r["required"], r["range"]) for r in rules] == [("a", "integer", True, None), ("b", "number", False, [0, 1]), ("c", "string", False, None), ("d", "boolean", False, None), ("e", "array", False, None)]
    assert catalog.schema_json(rules[:2]) == '[{"name": "a", "type": "integer", "required": true, "range": null}, {"name": "b", "type": "number", "required": false, "range": [0, 1]}]'


def test_journal(spark, tmp_path, monkeypatch):
    for k in range(5):
        write(tmp_path, f"d/{k}.txt", f"lic {k}")
    root, folder = str(tmp_path / "d"), str(tmp_path / "journal")
    changed = spark.createDataFrame([(f"{root}/{k}.txt", f"LIC {k}", "UTF-8") for k in range(5)] + [("/etc/none", "x", "UTF-8")], "full_path string, new_text string, encoding string")
    assert journal.residual(spark, folder) is None
    real, calls = journal.write_back, []

    def cut_off(df, root):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return real(df, root)

    monkeypatch.setattr(journal, "write_back", cut_off)
    with pytest.raises(RuntimeError):
        journal.journaled(changed, root, folder, SearchSpec("lic"), "LIC", batches=4)
    left = journal.residual(spark, folder).collect()
    assert left and all(r.search_term == "lic" and r.batches == 4 for r in left)
    done = {r.full_path for r in left if r.status == "modified"}
    assert {f"{root}/{k}.txt" for k in range(5) if (tmp_path / f"d/{k}.txt").read_text().startswith("LIC")} == done
    got = journal.journaled(changed.limit(0), root, folder, SearchSpec("lic"), "LIC").collect()
    assert len(calls) == 5 and len(got) == 6 and [r.full_path for r in got if r.failure] == ["/etc/none"]
    assert [(tmp_path / f"d/{k}.txt").read_text() for k in range(5)] == [f"LIC {k}" for k in range(5)]
    assert journal.residual(spark, folder) is None


def test_replace_limits_matches_if_asked(spark):
    df = spark.createDataFrame([("/r/a.txt", "a.txt", "a.txt", "txt", 12, 0, "lic lic Lic", "UTF-8")], "full_path string, relative_path string, file_name string, extension string, size long, mtime long, text string, encoding string")
    for spec in (SearchSpec("lic"), SearchSpec("l(i)c", regex=True)):
        assert [(r.matches, r.new_text) for r in replace.replaced(df, spec, "x", most_matches=2).collect()] == [(2, "x x Lic")]
        assert [(r.matches, r.new_text) for r in replace.replaced(df, spec, "x").collect()] == [(3, "x x x")]


def test_feed_and_index(spark, tmp_path):
    root, index = tmp_path / "db", str(tmp_path / "index")
    write(root, "notes/a.md", "---\nk: 1\n---\n")
    write(root, "notes/schema.md", "x")

    def run():
        feed.followed(feed.changed_records(spark, str(root)), index, str(tmp_path / "cp")).awaitTermination(120)
        return {(r.collection, r.record, r.props) for r in feed.current(feed.entries(spark, index)).collect()}

    assert run() == {("notes", "a.md", '{"k":"1"}')}
    write(root, "notes/b.md", "---\nk: 2\n---\n")
    assert run() == {("notes", "a.md", '{"k":"1"}'), ("notes", "b.md", '{"k":"2"}')}


def test_counters():
    now, seen = [0.0], []
    c = feed.Counters(seen.append, 0.25, lambda: now[0])
    for at in (0.0, 0.1, 0.2, 0.3, 0.4):
        now[0] = at
        c.add(10)
    c.onQueryTerminated(None)
    assert [x["rows"] for x in seen] == [10, 40, 50]


def test_coverage_and_hints(spark):
    previews = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "full_path string, line_number long")
    total = lambda n: spark.createDataFrame([(n,)], "matches long")
    notice = lambda packs, n: evidence.coverage(packs, previews, total(n)).first().notice
    assert notice(previews, 3) == ""
    assert notice(previews.limit(1), 3) == "Only 1 of 3 matches, in 1 of 2 files, fit the budget."
    assert notice(previews.limit(1), 9) == "Only the first 3 of 9 matches were considered, and 1 of them fit the budget."
    assert evidence.hints(SearchSpec("x", respect_ignore=False)) == []
    assert evidence.hints(SearchSpec("x", exclude_dirs=" a "), "/mnt/x") == ["ignore files are respected", "folders left out: a", "a mounted share or removable medium: /mnt/x"]
    assert aggregate is not None


def test_groups_of_empty_and_missing_values(spark, tmp_path):
    rows = [("a", '{"k": ""}'), ("b", "{}"), ("c", '{"k": "x/y=z %"}'), ("d", '{"k": "__HIVE_DEFAULT_PARTITION__"}'), ("e", None), ("f", '{"k": ""}')]
    view = catalog.materialized(spark.createDataFrame(rows, "record string, props string"), str(tmp_path), "v", "k")
    got = {r.record: r.group_value for r in view.collect()}
    assert got == {"a": "", "b": None, "c": "x/y=z %", "d": "__HIVE_DEFAULT_PARTITION__", "e": None, "f": ""}
    many = spark.range(3000).select(F.col("id").cast("string").alias("record"), F.format_string('{"k": "%s"}', F.col("id")).alias("props"))
    view = catalog.materialized(many, str(tmp_path), "many", "k")
    assert view.select("group_value").distinct().count() == 3000 and len(list((tmp_path / "views/many").glob("group_folder=*"))) == catalog.FOLDERS


def test_feed_follows_edits_deletions_and_renames(spark, tmp_path):
    root, index = tmp_path / "db", str(tmp_path / "index")

    def run():
        feed.followed(feed.changed_records(spark, str(root)), index, str(tmp_path / "cp")).awaitTermination(120)
        return {(r.record, r.props) for r in feed.swept(spark, str(root), index).collect()}

    for k in range(4):
        write(root, f"notes/{k}.md", f"---\nk: {k}\n---\n")
    assert run() == {(f"{k}.md", f'{{"k":"{k}"}}') for k in range(4)}
    (root / "notes/0.md").unlink()
    assert run() == {(f"{k}.md", f'{{"k":"{k}"}}') for k in (1, 2, 3)}
    (root / "notes/1.md").rename(root / "notes/one.md")
    assert run() == {("one.md", '{"k":"1"}'), ("2.md", '{"k":"2"}'), ("3.md", '{"k":"3"}')}
    assert feed.merged(spark, index).count() == 3 and len(list((tmp_path / "index").iterdir())) == 1
    write(root, "notes/0.md", "---\nk: again\n---\n")
    (root / "notes/2.md").unlink()
    assert run() == {("0.md", '{"k":"again"}'), ("one.md", '{"k":"1"}'), ("3.md", '{"k":"3"}')}
    assert feed.merged(spark, index).count() == 3 == feed.merged(spark, index).count()
    (root / "notes/3.md").unlink()
    assert {r.record for r in feed.swept(spark, str(root), index).collect()} == {"0.md", "one.md"}
    assert {r.record for r in feed.merged(spark, index).collect()} == {"0.md", "one.md"}
    time.sleep(1.1)  # so that the time of change differs
    write(root, "notes/one.md", "---\nk: edited\n---\n")
    assert run() == {("0.md", '{"k":"again"}'), ("one.md", '{"k":"edited"}')}


def test_schema_files(spark, tmp_path):
    root = str(tmp_path)
    rules = [{"name": "k", "type": "integer", "required": True, "range": [0, 9]}, {"name": "t", "type": "array"}, {"name": "b", "type": "boolean"}, {"name": "a.b", "type": "string"}]
    catalog.write_schema(spark, root, "notes", rules, "What notes hold.")
    write(tmp_path, "broken/schema.md", "```json\n[{\n```")
    write(tmp_path, "plain/schema.md", "no rules")
    write(tmp_path, "views/schema.md", "```json\n[]\n```")
    write(tmp_path, "notes/deep/schema.md", "```json\n[]\n```")
    got = {r.collection: r.rules and [x.asDict() for x in r.rules] for r in catalog.schemas_of(spark, root).collect()}
    assert got == {"notes": [{"range": None, "required": False, "type": "string"} | r for r in rules], "broken": None, "plain": None}
    values = ['{"k": 5}', "{}", '{"k": "x", "t": "y", "b": "yes"}', '{"k": 10, "t": "[1]", "b": true, "a.b": "z"}', None, '{"k": null, "t": [2]}']
    records = spark.createDataFrame([("notes", str(i), v) for i, v in enumerate(values)] + [("plain", "p", "{}"), ("none", "n", "{}")], "collection string, record string, props string")
    said = {(r.record, r.severity, r.field, r.message) for r in catalog.validated(records, catalog.schemas_of(spark, root)).collect()}
    assert said == {("1", "error", "k", "missing"), ("2", "error", "k", "not a number"), ("2", "error", "t", "not an array"), ("2", "error", "b", "not a boolean"), ("3", "warning", "k", "out of range"), ("4", "error", "k", "missing"), ("5", "error", "k", "missing")}
    rows = {r.record: tuple(r)[2:] for r in catalog.typed(records.where("collection = 'notes'"), rules).collect()}
    assert rows["3"] == (10, ["1"], True, "z") and rows["2"] == (None, None, True, None) and rows["4"] == (None,) * 4
    with pytest.raises(ValueError):
        catalog.write_schema(spark, root, "../x", rules)
