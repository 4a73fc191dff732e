"""Replacing every match in the files that a search finds."""

from __future__ import annotations

import dataclasses

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import folding, patterns
from siftline.operators.predicates import SEARCHABLE_TYPES, classified
from siftline.operators.search import content_rows, file_test, path_order
from siftline.spec import SearchSpec


def _counted(text: Column, spec: SearchSpec, replacement: str, most: int | None = None) -> tuple[Column, Column]:
    """(new text, matches), in Spark's expressions if they are exact, over the whole text; only so many first matches if asked."""
    if most is None and spec.regex and patterns.engine_of(spec) == "fast" and not spec.whole_word:
        rx = F.lit(patterns.java_regex(spec.term, spec.case_sensitive))
        compiled = patterns.python_regex(spec)
        template = patterns.java_template(replacement, dict(compiled.groupindex), compiled.groups)
        return F.regexp_replace(text, rx, F.lit(template)), F.regexp_count(text, rx).cast("long")
    if most is None and not spec.regex and not spec.folded and not spec.whole_word:
        if spec.case_sensitive:
            n = (F.length(text) - F.length(F.replace(text, F.lit(spec.term), F.lit("")))) / len(spec.term)
            return F.replace(text, F.lit(spec.term), F.lit(replacement)), n.cast("long")
        rx = F.lit("(?iu)" + patterns.quoted(spec.term))
        safe = replacement.replace("\\", "\\\\").replace("$", "\\$")
        return F.regexp_replace(text, rx, F.lit(safe)), F.regexp_count(text, rx).cast("long")

    unbounded = dataclasses.replace(spec, line_limits=False)

    @F.pandas_udf("struct<text:string,n:long>")
    def spliced(texts: pd.Series) -> pd.DataFrame:
        find, compiled = folding.finder(unbounded), patterns.python_regex(spec) if spec.regex else None
        rows = []
        for t in texts:
            if t is None:
                rows.append((None, 0))
                continue
            out, at, spans = [], 0, find(t)[:most]
            for a, b in spans:
                m = compiled.match(t, a) if compiled else None
                out += [t[at:a], expanded(replacement, m) if compiled and m else t[a:b] if compiled else replacement]
                at = b
            rows.append(("".join(out) + t[at:], len(spans)))
        return pd.DataFrame(rows, columns=["text", "n"])

    both = spliced(text)
    return both["text"], both["n"]


def expanded(template: str, m) -> str:
    """A template's $1, $name and ${name} filled from a match; unknown and empty groups give nothing."""
    def group(ref) -> str:
        name = ref[1] if ref[1] is not None else ref[2]
        if ref[3]:
            return "$"
        try:
            return m[int(name) if name.isdigit() else name] or ""
        except (IndexError, KeyError):
            return ""

    return regex.sub(r"\$(?:\{([^}]*)\}|([A-Za-z0-9_]+)|(\$))", group, template)


def replaced(files: DataFrame, spec: SearchSpec, replacement: str, *, most_files: int | None = None, most_matches: int | None = None) -> DataFrame:
    """(full_path, matches, new_text, status) of the files that the search finds.

    A file is taken if one of its lines matches, and rewritten as a whole; status is modified, unchanged (no match in the whole
    text, or the same text), or failed for documents that can't be written back.  With most_files, only so many files are taken, first
    by path, and every row has capped, whether there were more.  With most_matches, only so many of a file's matches are replaced.
    """
    looked, test = classified(files, spec).where(F.col("skip_reason").isNull()), file_test(spec)
    if test is not None:  # one scan finds and rewrites
        looked = looked.where(test)
    found = (content_rows(files, spec) if test is None else looked).select("full_path").distinct()
    if most_files is not None:
        capped = found.limit(most_files + 1).agg((F.count(F.lit(1)) > most_files).alias("capped"))
        found = found.orderBy(path_order()).limit(most_files)
    if test is None or most_files is not None:
        looked = looked.join(found, "full_path", "left_semi")
    text, n = _counted(F.col("text"), spec, replacement, most_matches)
    out = looked.select("full_path", "text", F.col("extension").isin(*SEARCHABLE_TYPES).alias("document"), text.alias("new_text"), n.alias("matches"))
    status = F.when(F.coalesce("document", F.lit(False)), "failed").when((F.col("matches") == 0) | F.col("text").eqNullSafe(F.col("new_text")), "unchanged").otherwise("modified")
    out = out.select("full_path", "matches", "new_text", status.alias("status"))
    return out if most_files is None else out.crossJoin(F.broadcast(capped))


def dry_run(files: DataFrame, spec: SearchSpec) -> DataFrame:
    """The lines that a replacement would touch, as path:line:content."""
    rows = content_rows(files, spec)
    return rows.select(F.concat_ws(":", "full_path", F.col("line_number").cast("string"), "line_content").alias("row"))


def summary(outcome: DataFrame) -> DataFrame:
    """One row: files modified, unchanged and failed, and matches replaced; with a limit of files also capped."""
    of = lambda s: F.count_if(F.col("status") == s)
    capped = [F.coalesce(F.bool_or("capped"), F.lit(False)).alias("capped")] if "capped" in outcome.columns else []
    return outcome.agg(of("modified").alias("modified"), of("unchanged").alias("unchanged"), of("failed").alias("failures"), F.coalesce(F.sum(F.when(F.col("status") == "modified", F.col("matches"))), F.lit(0)).alias("matches"), *capped)
