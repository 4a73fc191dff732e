import re

import pytest
from pyspark.sql import functions as F

from siftline.functions import folding, patterns
from siftline.operators.replace import expanded
from siftline.spec import SearchSpec, SpecError


@pytest.mark.parametrize(
    "glob, name, want",
    [("*.txt", "a.txt", True), ("*.txt", "a.TXT", False), ("a?c", "abc", True), ("a?c", "a/c", False), ("[ab].md", "b.md", True), ("[!ab].md", "b.md", False), ("*.{rs,py}", "x.py", True), ("*.{rs,py}", "x.go", False), ("a+b", "a+b", True), (r"\*", "*", True)],
)
def test_globs(glob, name, want):
    assert bool(re.search(patterns.glob_regex(glob), name)) is want


@pytest.mark.parametrize("glob", ["[ab", "{a,b"])
def test_bad_globs(glob):
    with pytest.raises(SpecError):
        patterns.glob_regex(glob)


@pytest.mark.parametrize("pattern, want", [("a+b", False), ("(?=a)", True), (r"(a)\1", True), ("a++", True), (r"\(\?=", False), ("(?P<n>a)", False)])
def test_engines(pattern, want):
    assert patterns.is_extended(pattern) is want
    assert patterns.engine_of(SearchSpec(pattern, regex=True)) == ("extended" if want else "fast")


def test_engine_errors():
    with pytest.raises(SpecError):
        patterns.engine_of(SearchSpec("(?=a)", regex=True, engine="fast"))
    with pytest.raises(SpecError):
        patterns.engine_of(SearchSpec("(a", regex=True))


def spans(term, line, **more):
    return folding.finder(SearchSpec(term, **more))(line)


def test_spans():
    assert spans("aa", "aaaa", case_sensitive=True) == [(0, 2), (2, 4)]
    assert spans("THE", "The the") == [(0, 3), (4, 7)]
    assert spans("i", "İx") == [(0, 1)]
    assert spans("licence", "Licénce", diacritic_sensitive=False) == [(0, 7)]
    assert spans("licence", "Licénce", diacritic_sensitive=False) == [(0, 8)]
    assert spans("é", "é", normalization="NFC") == [(0, 2)]
    assert spans("the", "other the", whole_word=True) == [(6, 9)]
    assert spans("ı", "I", comparison="current", culture="tr") == [(0, 1)]
    assert spans("i", "I", comparison="current", culture="tr") == []
    assert spans("x*", "ab", regex=True) == [(0, 0), (1, 1), (2, 2)]
    assert spans("", "ab") == []


def test_templates():
    assert patterns.java_template("$2-$1", {}, 2) == "$2-$1"
    assert patterns.java_template("$9x", {}, 2) == ""
    assert patterns.java_template("${1}0", {}, 1) == "$1\\0"
    assert patterns.java_template("a\\b$$", {}, 0) == "a\\\\b\\$"
    m = re.match("(?P<n>a)(b)?", "a")
    assert expanded("[${n}$2$1b]", m) == "[a]"


def test_regex_report():
    assert folding.regex_report("a", "banana") == (3, [[1, 2], [3, 4], [5, 6]], "")
    assert folding.regex_report("", "x") == (0, [], "")
    assert folding.regex_report("(", "x")[2]


def test_spec_checks():
    with pytest.raises(SpecError):
        SearchSpec("é" * 3000).checked()
    with pytest.raises(SpecError):
        SearchSpec("a", engine="other").checked()


CLASSES = [r"\p{Greek}+", r"\p{Cyrillic}", r"\p{Latin}+", r"\p{Script=Han}", r"\p{sc=Hiragana}", r"\p{L}+", r"\pL", r"\p{Lu}", r"\p{Letter}", r"\p{Uppercase_Letter}", r"\p{gc=Nd}", r"\P{Greek}", r"\p{^Greek}", r"[\p{Greek}\d]+", r"[^\p{Latin}\s]+", r"\p{Alphabetic}+", r"\p{White_Space}", r"\\p", r"\PN", r"\p{Any}", r"\p{Currency_Symbol}"]


@pytest.mark.parametrize("pattern", CLASSES)
def test_unicode_classes_in_spark(spark, pattern):
    """Names of classes mean in Spark's engine what they mean in Python's."""
    import regex

    lines = ["Ωmega αβγ 12", "Привет мир", "漢字 ひらがな", "plain Text x", "€ 5 ٣", "", "\\p", "É É"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, line string")
    got = {r.i: r.n for r in df.select("i", F.regexp_count("line", F.lit(patterns.java_regex(pattern, True))).alias("n")).collect()}
    assert got == {i: len(regex.findall(pattern, t)) for i, t in enumerate(lines)}


def test_patterns_that_one_engine_refuses(spark):
    for pattern in (r"\p{Klingon}", r"[[:alpha:]&&", "(?<n>a)(?<n>b)"):
        with pytest.raises(SpecError):
            spec = SearchSpec(pattern, regex=True)
            patterns.engine_of(spec)
            patterns.java_regex(spec.term, True)
