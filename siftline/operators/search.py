"""Searches as plans: files to lines to matching lines.

Plain literals and patterns without back references or lookaround stay in Spark's expressions, and files that can't match
are left out before their lines are made.  Folding, back references and the like run in a pandas function over lines.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import folding, patterns
from siftline.operators.predicates import classified
from siftline.spec import MAX_LINE_BYTES, MAX_RESULTS, MAX_SPANS, PREVIEW_MATCH, PREVIEW_SIDE, SearchSpec

ROW = "file_name string, line_number long, column_number long, line_content string, match_preview_before string, match_preview_match string, match_preview_after string, full_path string, relative_path string, match_count long"
#: The letter whose lower case has two characters, two code points that are no characters,
#: and a letter beyond the first plane.
LENGTHENED, _MARK, _OTHER = "\u0130", "\ufdd0", "\ufdd1"
_FAR = "\U0001d400"
#: Columns of content rows, in order.
COLUMNS = [c.split()[0] for c in ROW.split(", ")]


def line_array(text: Column) -> Column:
    """Lines end with a line feed, a return before it included; nothing follows the last one."""
    lines = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n", -1)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def lines_of(files: DataFrame) -> DataFrame:
    """files with line_number and line instead of text."""
    out = files.select("*", F.posexplode(line_array(F.col("text"))).alias("__at", "line")).drop("text")
    return out.withColumn("line_number", F.col("__at").cast("long") + 1).drop("__at")


def plain(spec: SearchSpec) -> bool:
    """Whether Spark's own expressions give the exact spans."""
    if spec.regex:
        return patterns.engine_of(spec) == "fast" and not spec.whole_word and not re.search(r"[$^]|\\[bB]", spec.term)
    # A whole word of word characters can't overlap another occurrence, so Spark's engine finds the same.
    word = not spec.whole_word or re.fullmatch(r"\w+", spec.term, re.ASCII)
    return not spec.folded and bool(word) and (spec.case_sensitive or spec.term.isascii())


def prefilter(spec: SearchSpec) -> Column | None:
    """A test on whole texts that each matching file passes; null if none is implied."""
    if spec.regex:
        return None
    if spec.case_sensitive and not spec.folded:
        return F.contains("text", F.lit(spec.term))
    if spec.folded or not spec.case_sensitive and not spec.term.isascii():
        return _folded_test(F.col("text"), spec) if folding.folded(spec.term, spec) else None
    # Folding case alone may map other characters to ASCII ones, which lower() does as well.
    if not spec.folded and spec.term.isascii():
        return F.contains(F.lower("text"), F.lit(spec.term.lower()))
    return None


def _folded_test(text: Column, spec: SearchSpec) -> Column:
    """A test that each text passes in which a folding search finds its term, exact for texts within ASCII."""
    needle = folding.folded(spec.term, spec)
    same = F.contains(text if spec.case_sensitive else F.lower(text), F.lit(needle)) if needle.isascii() and spec.comparison != "current" else F.rlike(text, F.lit(folding.superset(needle)))
    return F.when(_within_ascii(text), same).otherwise(F.rlike(text, F.lit(folding.superset(needle))))


def _within_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def file_test(spec: SearchSpec) -> Column | None:
    """A test on whole texts that just the files with matching lines pass, without a row for each line; null where Spark's
    expressions can't tell."""
    if spec.blank or spec.line_limits or not plain(spec):
        return None
    if spec.regex:
        rx = patterns.java_regex(spec.term, spec.case_sensitive)
        return F.exists(line_array(F.col("text")), lambda line: F.rlike(line, F.lit(rx)))
    # Lines have no line ends, so a literal that has one is in none; any other is in a line if it is in the text.
    if spec.whole_word:
        return F.rlike(_compared(F.col("text"), spec), F.lit(_whole(spec)))
    return F.lit(False) if re.search(r"[\r\n]", spec.term) else prefilter(spec)


def _compared(text: Column, spec: SearchSpec) -> Column:
    """What a plain literal is looked for in.  The one letter whose lower case is longer brings a mark, which is taken off its
    place again; marks that are there go first."""
    if spec.case_sensitive:
        return text
    return F.lower(F.replace(F.replace(text, F.lit(_MARK), F.lit(_OTHER)), F.lit(LENGTHENED), F.lit(f"i{_MARK}")))


def _whole(spec: SearchSpec) -> str:
    """A plain literal between characters that are in no word.

    Without regard to case, marks behind a letter belong to it, and the mark of _compared() to the letter before.  A letter
    beyond the first plane is in the pattern itself, as only then the engine looks behind at whole code points.
    """
    if spec.case_sensitive:
        return rf"(?<![\p{{L}}\p{{N}}_{_FAR}]){spec.term}(?![\p{{L}}\p{{N}}_])"
    return rf"(?<![\p{{L}}\p{{N}}_{_MARK}{_FAR}]){spec.term.lower()}[\p{{Mn}}\p{{Mc}}]*+(?![\p{{L}}\p{{N}}_])"


def _places(spec: SearchSpec) -> tuple[Column, Column, Column]:
    """(count, start, length) of a line's matches and its first match, by Spark's expressions; start counts from 0."""
    line = F.col("line")
    if spec.regex:
        rx = patterns.java_regex(spec.term, spec.case_sensitive)
        head = F.regexp_extract(line, f"(?s){rx[: rx.index(')') + 1]}^(.*?)((?-s:{rx[rx.index(')') + 1 :]}))", 1)
        first = F.regexp_substr(line, F.lit(rx))
        return F.regexp_count(line, F.lit(rx)).cast("long"), F.length(head), F.length(first)
    text, term = _compared(line, spec), spec.term if spec.case_sensitive else spec.term.lower()
    if spec.whole_word:
        n = F.regexp_count(text, F.lit(_whole(spec))).cast("long")
        start = F.length(F.regexp_extract(text, f"(?s)^(.*?){_whole(spec)}", 1))
        length = F.length(F.regexp_substr(text, F.lit(_whole(spec))))
    else:
        n = ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("long")
        start, length = F.call_function("instr", text, F.lit(term)) - 1, F.lit(len(spec.term))
    if not spec.case_sensitive:
        before = F.substring(text, F.lit(1), start)
        start = F.length(F.replace(before, F.lit(_MARK), F.lit("")))
    return n, start, length


def matching_lines(files: DataFrame, spec: SearchSpec) -> DataFrame:
    """Matching lines of files with match_count, start and length of the first match; other columns stay."""
    spec = spec.checked()
    test = prefilter(spec)
    lines = lines_of(files if test is None else files.where(test))
    if spec.line_limits:
        head = F.substring(F.encode("line", "UTF-8"), 1, MAX_LINE_BYTES)
        lines = lines.withColumn("line", F.when(F.octet_length("line") > MAX_LINE_BYTES, F.regexp_replace(F.decode(head, "UTF-8"), "\uFFFD+$", "")).otherwise(F.col("line")))
    if plain(spec):
        count, start, length = _places(spec)
        if spec.regex:
            lines = lines.where(F.rlike("line", F.lit(patterns.java_regex(spec.term, spec.case_sensitive))))
        elif spec.whole_word:
            lines = lines.where(F.contains(_compared(F.col("line"), spec), F.lit(spec.term if spec.case_sensitive else spec.term.lower())))
        out = lines.withColumn("match_count", F.least(count, F.lit(MAX_SPANS).cast("long")) if spec.line_limits else count).where("match_count > 0")
        return out.withColumn("start", start).withColumn("length", length)
    if spec.regex and patterns.engine_of(spec) == "fast":
        # Spark's engine rules out most lines before any reach Python.
        lines = lines.where(F.rlike("line", F.lit(patterns.java_regex(spec.term, spec.case_sensitive))))
    elif test is not None:
        folds = spec.folded or not spec.case_sensitive and not spec.term.isascii()
        lines = lines.where(_folded_test(F.col("line"), spec) if folds else F.contains(F.lower("line"), F.lit(spec.term.lower())))
    out = lines.withColumn("__spans", folding.spans_column(F.col("line"), spec)).where(F.size("__spans") > 0)
    first = F.element_at("__spans", 1)
    return out.select("*", F.size("__spans").cast("long").alias("match_count"), first["start"].alias("start"), (first["end"] - first["start"]).alias("length")).drop("__spans")


def content_rows(files: DataFrame, spec: SearchSpec, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each matching line of the files that the search looks at; a blank term matches none."""
    if spec.blank:
        return files.sparkSession.createDataFrame([], ROW)
    found = matching_lines(classified(files, spec).where(F.col("skip_reason").isNull()).drop("skip_reason"), spec)
    line, start, length = F.col("line"), F.col("start"), F.col("length")
    columns = {
        "file_name": F.col("file_name"),
        "line_number": F.col("line_number"),
        "column_number": start.cast("long") + 1,
        "line_content": F.substring(line, 1, PREVIEW_MATCH),
        "match_preview_before": F.substring(line, F.lit(1), F.least(start, F.lit(PREVIEW_SIDE))),
        "match_preview_match": F.substring(line, start + 1, F.least(length, F.lit(PREVIEW_MATCH))),
        "match_preview_after": F.substring(line, start + length + 1, F.lit(PREVIEW_SIDE)),
        "full_path": F.col("full_path"),
        "relative_path": F.col("relative_path"),
        "match_count": F.col("match_count"),
    }
    return limited(found.select(*(v.alias(k) for k, v in columns.items()), *keep), spec)


def path_order(path: str = "full_path") -> Column:
    """Paths compare component by component."""
    return F.split(path, "/")


def limited(rows: DataFrame, spec: SearchSpec) -> DataFrame:
    """The first max_results rows by path and line; all rows without that limit."""
    if spec.max_results is None:
        return rows
    return rows.orderBy(path_order(), "line_number").limit(min(spec.max_results, MAX_RESULTS))
