"""Functions of this package under names that SQL can call."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siftline.functions.folding import SPANS, finder, folded
from siftline.operators.evidence import pack
from siftline.sources import extract
from siftline.sources.decode import decoded, decoded_all
from siftline.sources.ignore import ignored_in
from siftline.sources.shared import bounded_batches
from siftline.spec import SearchSpec

#: What fold_text asks for.
_FORM = SearchSpec("x", diacritic_sensitive=False)


@F.udtf(returnType="text string, encoding string, error string")
class ExtractText:
    """extract_text(path, content): a row with the text of a document or file, by the ending of its path, or what is wrong."""

    def eval(self, path: str, content: bytes):
        if content is None:
            yield None, None, "no content"
            return
        try:
            text = extract.extracted((path or "").rpartition(".")[2], content)
            yield (*((text, "UTF-8") if text is not None else decoded(content)), None)
        except extract.ExtractError as e:
            yield None, None, str(e)


@F.udtf(returnType="taken_at int, path string, snippet int, text string")
class Pack:
    """pack(snippets, budget): of an array of (path, text), those that fit a budget of bytes, in order of taking."""

    def eval(self, snippets: list, budget: int):
        number: dict[str, int] = {}
        rows = []
        for s in snippets or []:
            number[s["path"]] = number.get(s["path"], 0) + 1
            rows.append((s["path"], number[s["path"]], s["text"] or ""))
        for k, (path, n, text) in enumerate(pack(rows, budget or 0), 1):
            yield k, path, n, text


def register(spark: SparkSession) -> list[str]:
    """Registers fold_text(text), literal_spans(text, term), regex_spans(text, pattern) and decode_bytes(bytes); their names.

    A null argument gives null, a blank term no spans.  Terms and patterns are searched without regard to case, with a third
    argument, true, in exact case; spans count code points from 0, ends exclusive.
    """

    @F.pandas_udf("string")
    def fold_text(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: folded(t, _FORM) if t is not None else None)

    def spans(regex: bool):
        @F.pandas_udf(SPANS)
        def found(texts: pd.Series, terms: pd.Series, *exact: pd.Series) -> pd.Series:
            exact = exact[0] if exact else pd.Series(False, index=texts.index)
            asked = set(zip(terms, exact))
            find = {(t, c): finder(SearchSpec(t, regex=regex, case_sensitive=bool(c)).checked()) for t, c in asked if t is not None and t.strip()}
            none = lambda text: []
            each = (None if x is None or t is None or c is None else find.get((t, c), none)(x) for x, t, c in zip(texts, terms, exact))
            return pd.Series([None if s is None else [{"start": a, "end": b} for a, b in s] for s in each])

        return found

    @F.pandas_udf("struct<text:string,encoding:string>")
    def decode_bytes(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(decoded_all(content.tolist()), columns=["text", "encoding"])

    bounded_batches(spark)
    named = {"fold_text": fold_text, "literal_spans": spans(False), "regex_spans": spans(True), "decode_bytes": decode_bytes}
    for name, function in named.items():
        spark.udf.register(name, function)
    return list(named)


def register_tables(spark: SparkSession) -> list[str]:
    """Registers the table functions extract_text(path, content) and pack(snippets, budget) for lateral joins, and
    ignore_eval(path, rules), whether a directory's rules hide a path below it; their names.  A null argument gives null."""

    @F.pandas_udf("boolean")
    def ignore_eval(paths: pd.Series, rules: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or r is None else ignored_in([p], {"": r})[p] for p, r in zip(paths, rules)], dtype="object")

    bounded_batches(spark)
    tables = {"extract_text": ExtractText, "pack": Pack}
    for name, function in tables.items():
        spark.udtf.register(name, function)
    spark.udf.register("ignore_eval", ignore_eval)
    return ["ignore_eval", *tables]
