"""Ignore rules by path and as a plan, and walks of trees."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftline.sources import files, ignore
from siftline.spec import SearchSpec

#: (rules, path of a file, whether it is hidden)
CASES = [
    ("*.log\n", "error.log", True), ("*.log\n", "error.txt", False), ("*.log\n", "nested/dir/error.log", True),
    (".env\n", ".env", True), (".env\n", ".env.docker", False), (".env\n", "nested/dir/.env", True),
    ("test*.txt\n", "test.txt", True), ("test*.txt\n", "test123.txt", True), ("test*.txt\n", "mytest.txt", False),
    ("test?.txt\n", "test1.txt", True), ("test?.txt\n", "test.txt", False), ("test?.txt\n", "test12.txt", False),
    ("build/\n", "build/output.txt", True), ("build/\n", "src/build.rs", False), ("build/\n", "nested/build/out.bin", True), ("build/\n", "build", False),
    ("node_modules/\n", "node_modules/pkg/index.js", True), ("node_modules/\n", "node_modules", False),
    ("/storage/app/\n", "storage/app/file.txt", True), ("/storage/app/\n", "app/file.txt", False), ("/storage/app/\n", "storage/app/subdir/file.txt", True),
    ("/storage/app\n", "app/Http/Middleware/Foo.php", False), ("/secrets.txt\n", "secrets.txt", True), ("/secrets.txt\n", "sub/secrets.txt", False),
    ("**/test.txt\n", "test.txt", True), ("**/test.txt\n", "subdir/test.txt", True), ("**/test.txt\n", "a/b/c/test.txt", True),
    ("logs/**\n", "logs/2026/05/server.log", True), ("a/**/b\n", "a/b", True), ("a/**/b\n", "a/x/y/b", True), ("a/**/b\n", "c/a/b", False),
    ("*.log\n!important.log\n", "app.log", True), ("*.log\n!important.log\n", "important.log", False),
    ("test*.txt\n!test_backup.txt\n*.tmp\n*.bak\n", "test.txt", True), ("test*.txt\n!test_backup.txt\n*.tmp\n*.bak\n", "test_backup.txt", False), ("test*.txt\n!test_backup.txt\n*.tmp\n*.bak\n", "cache.tmp", True),
    ("test[12].txt\n", "test1.txt", True), ("test[12].txt\n", "test2.txt", True), ("test[12].txt\n", "test3.txt", False), ("test[12].txt\n", "test.txt", False),
    ("[A-Z]*.cs\n", "Main.cs", True), ("[A-Z]*.cs\n", "main.cs", False), ("[!a-z]*.txt\n", "Readme.txt", True), ("[!a-z]*.txt\n", "notes.txt", False),
    ("# ignore logs\n*.log\n", "app.log", True), ("# ignore logs\n*.log\n\n", "app.log", True), ("# only comments\n", "anything.txt", False), ("", "anything.txt", False),
    ("\\#config", "#config", True), ("\\!literal", "!literal", True), ("\\[abc].txt", "[abc].txt", True),
    ("[unterminated\n*.txt\n!keep.txt\n", "app.txt", True), ("[unterminated\n*.txt\n!keep.txt\n", "keep.txt", False),
    ("*.LOG\n", "app.log", False), ("BUILD/\n", "build/x.txt", False),
    # Beyond that matrix: trailing blanks, classes with odd letters, names of dots, directories kept by a later line.
    ("a.txt   \n", "a.txt", True), ("b\\ \n", "b ", True), ("[]x]y\n", "]y", True), ("[!x]y\n", "/y/z", False), ("*.tar.gz\n", "a.tar.gz", True), ("*.gz\n", ".gz", True), ("*.gz\n", "agz", False),
    ("build\n!build\n", "build/a", False), ("x/*.c\n", "x/y/a.c", False), ("a+b(c)|d\n", "a+b(c)|d", True), ("é?\n", "éß", True), ("*\n!*/\n!*.md\n", "doc/a.md", False), ("*\n!*/\n!*.md\n", "doc/a.txt", True),
]
CASES = [(r, p.lstrip("/"), h) for r, p, h in CASES]


@pytest.mark.parametrize(("rules", "path", "hidden"), CASES)
def test_cases_by_path(rules, path, hidden):
    assert ignore.ignored_in([path], {"": rules})[path] is hidden


def test_cases_as_a_plan(spark):
    """All at once: each case is a directory with rules of its own."""
    rules = ignore.rules_table(ignore.files_of(spark, {f"case{k}": r for k, (r, _, _) in enumerate(CASES)}))
    paths = spark.createDataFrame([(f"case{k}/{p}", "x") for k, (_, p, _) in enumerate(CASES)] * 2, "relative_path string, at string")
    got = {r.relative_path: r.ignored for r in ignore.hidden(paths, rules).collect()}
    assert got == {f"case{k}/{p}": h for k, (_, p, h) in enumerate(CASES)}


NESTED = {"": "*.txt\n", "sub": "!sub.txt\n!keep/\n", "sub/keep": "*.md\n"}


def test_nested_files(spark):
    paths = ["sub/sub.txt", "sub/other.txt", "root.txt", "sub/keep/a.md", "sub/keep/sub.txt", "sub2/sub.txt", "b.md"]
    want = {"sub/sub.txt": False, "sub/other.txt": True, "root.txt": True, "sub/keep/a.md": True, "sub/keep/sub.txt": False, "sub2/sub.txt": True, "b.md": False}
    assert ignore.ignored_in(paths, NESTED) == want
    table = spark.createDataFrame([(p,) for p in [*paths, None]], "relative_path string")
    rules = ignore.rules_table(ignore.files_of(spark, NESTED))
    assert {r.relative_path: r.ignored for r in ignore.hidden(table, rules).collect()} == want
    assert ignore.hidden(table.limit(0), rules).count() == 0 and ignore.hidden(table, rules.limit(0)).where("ignored").count() == 0


def written(root, tree):
    for name, text in tree.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


TREE = {
    "outer/.gitignore": "*.out\n/top/skip.me\ntop/sub/*.x\n", "outer/.ignore": "*.gen\n",
    "outer/top/.git/info/exclude": "*.excluded\n*.both\n", "outer/top/.gitignore": "!a.both\n*.tmp\n", "outer/top/.ignore": "!kept.tmp\n",
    "outer/top/sub/.gitignore": "*.gone\n", "outer/top/vendor/.git/config": "", "outer/top/vendor/.gitignore": "*.v\n",
}
#: With a repository at the root, .gitignore files above it say nothing, but .ignore files do.
WANT = {
    "a.out": True, "a.gen": False, "a.excluded": False, "a.both": True, "b.both": False, "x.tmp": False, "kept.tmp": True, "skip.me": True, "user.bak": False, "sub/b.gone": False,
    "sub/b.x": True, "vendor/lib.tmp": True, "vendor/lib.v": False, "vendor/lib.excluded": True, "vendor/a.gen": False, "sub/keep.txt": True,
}


def test_excludes_parents_and_repositories(spark, tmp_path, monkeypatch):
    """Files of directories above the root, git's exclude file, the user's own, and repositories inside others: by a walk and
    as a plan."""
    written(tmp_path, TREE | {f"outer/top/{p}": "license" for p in WANT})
    written(tmp_path, {"home/.gitconfig": "[core]\n\texcludesfile = ~/mine\n", "home/mine": "*.bak\n"})
    monkeypatch.setenv("HOME", str(tmp_path / "home"))
    monkeypatch.delenv("XDG_CONFIG_HOME", raising=False)
    root = tmp_path / "outer/top"
    shown = {r.relative_path for r in files.listed(spark, str(root), SearchSpec("license")).collect()}
    assert shown == {p for p, kept in WANT.items() if kept}
    found = [*ignore.rules_above(str(root), ignore.global_file())]
    for directory, _, _ in os.walk(root):
        if ".git" not in directory.split("/"):
            found += ignore.rules_in(directory, os.path.relpath(directory, root).replace(".", "", 1) if directory == str(root) else os.path.relpath(directory, root))
    rows = []
    for r in found:
        place = os.path.join(root, *[".."] * r.above, r.scope, ignore.PLACES.get(r.kind, ""))
        text = (tmp_path / "home/mine").read_text() if r.kind == ignore.GLOBAL else "" if r.kind == ignore.REPOSITORY else open(place).read()
        rows.append((r.scope, r.kind, r.above, r.prefix, text))
    rules = ignore.rules_table(spark.createDataFrame(rows, ignore.FILES))
    table = spark.createDataFrame([(p,) for p in WANT], "relative_path string")
    assert {r.relative_path for r in ignore.hidden(table, rules).where("NOT ignored").collect()} == shown
    assert {r.relative_path for r in files.listed(spark, str(root), SearchSpec("license", respect_ignore=False)).collect()} == set(WANT)


def test_a_large_folder_is_spread(spark, tmp_path, monkeypatch):
    """One first-level folder with many files: its names come from a task as a stream, all else is done by all tasks."""
    folder = tmp_path / "only/deep"
    folder.mkdir(parents=True)
    for k in range(20_000):
        (folder / f"{k}.txt").touch()
    listed = files.listed(spark, str(tmp_path), SearchSpec("x"))
    per = [r["count"] for r in listed.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(per) == 20_000 and len(per) == 4 * spark.sparkContext.defaultParallelism and max(per) < 2 * min(per)


@pytest.mark.parametrize("at_once", [1, 7, 20_000])
def test_walks_in_rounds(spark, tmp_path, monkeypatch, at_once):
    monkeypatch.setattr(files, "AT_ONCE", at_once)
    names = {"/".join(["d"] * depth + [f"f{depth}-{k}.txt"]) for depth in range(9) for k in range(3)} | {f"w{k}/x/y.txt" for k in range(12)} | {"_u/a", ".hid/b"}
    written(tmp_path, dict.fromkeys(names, "x"))
    os.symlink(tmp_path / "w1", tmp_path / "link")
    os.symlink(tmp_path / "none", tmp_path / "broken")
    os.mkfifo(tmp_path / "pipe")
    got = Counter(r.relative_path for r in files.listed(spark, str(tmp_path), SearchSpec("x")).collect())
    assert got == Counter({n: 1 for n in names if not n.startswith(".")} | {"pipe": 1})
    every = files.listed(spark, str(tmp_path), SearchSpec("x", include_hidden=True, include_symlinks=True)).collect()
    errors = {r.relative_path: r.walk_error for r in every if r.walk_error}
    assert {r.relative_path for r in every} == names | {"link/x/y.txt", "broken", "pipe"} and set(errors) == {"broken", "pipe"}
    flat = files.listed(spark, str(tmp_path), SearchSpec("x", include_subfolders=False)).collect()
    assert {r.relative_path for r in flat} == {"f0-0.txt", "f0-1.txt", "f0-2.txt", "pipe"}


def test_depth_is_bounded(spark, tmp_path):
    deep = tmp_path.joinpath(*["d"] * 69)
    deep.mkdir(parents=True)
    (deep / "far.txt").write_text("x")
    (tmp_path / "near.txt").write_text("x")
    assert [r.relative_path for r in files.listed(spark, str(tmp_path), SearchSpec("x")).collect()] == ["near.txt"]
