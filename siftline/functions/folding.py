"""Matching that Spark's functions don't have: folding of cases, marks and forms with places mapped back, and spans.

All functions work on code points.  They run in pandas functions over batches of lines, for searches that need them; plain
searches stay in Spark's own expressions.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions.patterns import engine_of, python_regex
from siftline.spec import EXTENDED_SECONDS, MAX_LINE_BYTES, MAX_SPANS, SearchSpec

SPANS = "array<struct<start:int,end:int>>"
#: Cultures whose lower case differs from the root's: dotted and dotless i, and a dot that stays below accents.
_TURKIC, _DOTTED = ("tr", "az"), "lt"
#: Letters with an accent that keep their dot in Lithuanian.
_ACCENTED = {"\u00cc": "i\u0307\u0300", "\u00cd": "i\u0307\u0301", "\u0128": "i\u0307\u0303"}
#: Folded segments that a worker remembers.
REMEMBERED = 1 << 16


def _dotted(m: regex.Match) -> str:
    """I, J or Į, and the marks behind: a dot comes first if one of them is above."""
    above = any(unicodedata.combining(c) == 230 for c in m[2])
    return m[1].lower() + ("\u0307" if above else "") + m[2]


def lower_of(text: str, spec: SearchSpec) -> str:
    culture = (spec.culture or "").lower().split("-")[0] if spec.comparison == "current" else ""
    if culture in _TURKIC:
        text = text.replace("I\u0307", "i").replace("I", "\u0131").replace("\u0130", "i")
    elif culture == _DOTTED:
        for letter, lower in _ACCENTED.items():
            text = text.replace(letter, lower)
        text = regex.sub(r"([IJ\u012e])(\p{Mn}+)", _dotted, text)
    return text.lower()


def folded(text: str, spec: SearchSpec) -> str:
    """Form, then marks, then case, as the search asks."""
    if spec.normalization:
        text = unicodedata.normalize(spec.normalization, text)
    if not spec.diacritic_sensitive and not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
    return text if spec.case_sensitive else lower_of(text, spec)


@lru_cache(maxsize=8)
def _segments(spec: SearchSpec) -> Callable[[str], str]:
    return lru_cache(maxsize=REMEMBERED)(lambda piece: folded(piece, spec))


def folded_with_places(text: str, spec: SearchSpec) -> tuple[str, Sequence[int], Sequence[int]]:
    """The folded text and, for each of its characters, where the segment it came from starts and ends.

    A segment is a character and the marks after it; folding one may change its length.
    """
    if text.isascii():
        return folded(text, spec), range(len(text)), range(1, len(text) + 1)
    fold, out, starts, ends, i = _segments(spec), [], [], [], 0
    while i < len(text):
        j = i + 1
        while j < len(text) and unicodedata.category(text[j]) in ("Mn", "Mc"):
            j += 1
        piece = fold(text[i:j])
        out.append(piece)
        starts.extend([i] * len(piece))
        ends.extend([j] * len(piece))
        i = j
    return "".join(out), starts, ends


def coarse(text: str) -> str:
    """Text without any difference that a search may fold away: what folded() gives, for whatever search, keeps its coarse form."""
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) != "Mn").lower()
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) != "Mn")
    return text.replace("\u03c2", "\u03c3").replace("\u0131", "i")


@lru_cache(maxsize=1)
def _coarse_forms() -> tuple[dict[str, list[int]], list[int], list[tuple[str, int]]]:
    """Code points by their coarse form of one character; those that have none; (form, code point) of longer forms.  Nothing
    beyond the third plane has a form other than itself."""
    one: dict[str, list[int]] = {}
    none, more = [], []
    for code in (*range(0xD800), *range(0xE000, 0x30000), *range(0xE0000, 0xE01F0)):
        form = coarse(chr(code))
        if len(form) == 1:
            if form != chr(code):
                one.setdefault(form, []).append(code)
        elif form:
            more.append((form, code))
        else:
            none.append(code)
    return one, none, more


def _ranges(codes: list[int]) -> str:
    """A character class for Java.  What is beyond Latin-1 is behind a single test, as it would be tried range by range."""
    near = [c for c in codes if c < 256]
    if len(near) < len(codes):
        return f"[{_parts(near)}[\\x{{100}}-\\x{{10FFFF}}&&[{_parts(codes[len(near) :])}]]]"
    return f"[{_parts(codes)}]"


def _parts(codes: list[int]) -> str:
    out, k = [], 0
    while k < len(codes):
        j = k
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        out.append(f"\\x{{{codes[k]:X}}}" + (f"-\\x{{{codes[j]:X}}}" if j > k else ""))
        k = j + 1
    return "".join(out)


def superset(needle: str) -> str:
    """A pattern for Spark that every text matches in which a search finds the folded needle, whatever it folds.

    Each character stands for all that have its coarse form, with marks between them; characters of longer forms that share
    a letter with the needle stand for a match.
    """
    one, none, more = _coarse_forms()
    form = coarse(needle)
    between = f"{_ranges(none)}*+"
    found = between.join(_ranges(sorted({ord(c), *one.get(c, [])})) for c in form)
    wide = sorted(code for some, code in more if set(some) & set(form))
    return f"(?s){found}" + (f"|{_ranges(wide)}" if wide else "")


def is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def whole(text: str, start: int, end: int) -> bool:
    return not (start > 0 and is_word(text[start - 1])) and not (end < len(text) and is_word(text[end]))


def _cut(text: str) -> str:
    """At most MAX_LINE_BYTES of a line are compared, whole characters."""
    if len(text) * 4 <= MAX_LINE_BYTES:
        return text
    return text.encode("utf-8")[:MAX_LINE_BYTES].decode("utf-8", "ignore")


def finder(spec: SearchSpec) -> Callable[[str], list[tuple[int, int]]]:
    """A function from a line to its spans: not overlapping, left to right, then whole words only.

    With the search's line_limits, lines are cut, spans are MAX_SPANS at most, and look-around patterns have EXTENDED_SECONDS.
    """
    most = MAX_SPANS if spec.line_limits else float("inf")
    if spec.regex:
        pattern = python_regex(spec)
        limit = EXTENDED_SECONDS if spec.line_limits and engine_of(spec) == "extended" else None

        def found(line: str) -> list[tuple[int, int]]:
            spans = []
            try:
                for m in pattern.finditer(line, timeout=limit):
                    spans.append(m.span())
                    if len(spans) >= most:
                        break
            except TimeoutError:
                pass  # what was found in time counts
            return spans

    else:
        needle = folded(spec.term, spec)

        def found(line: str) -> list[tuple[int, int]]:
            if spec.case_sensitive and not spec.folded:
                text, starts, ends = line, None, None
            else:
                text, starts, ends = folded_with_places(line, spec)
            spans, at = [], text.find(needle)
            while at >= 0 and len(spans) < most:
                stop = at + len(needle)
                spans.append((at, stop) if starts is None else (starts[at], ends[stop - 1]))
                at = text.find(needle, stop)
            return spans

    def spans(line: str) -> list[tuple[int, int]]:
        line = _cut(line) if spec.line_limits else line
        every = found(line) if spec.regex or needle else []
        return [s for s in every if whole(line, *s)] if spec.whole_word else every

    return spans


def spans_column(line: Column, spec: SearchSpec) -> Column:
    """Spans of every line, as a pandas function."""

    @F.pandas_udf(SPANS)
    def spans(lines: pd.Series) -> pd.Series:
        find = finder(spec)
        return lines.map(lambda x: [{"start": a, "end": b} for a, b in find(x)] if x is not None else None)

    return spans(line)


def fold_column(text: Column, spec: SearchSpec) -> Column:
    """The folded text, as a pandas function."""

    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: folded(x, spec) if x is not None else None)

    return fold(text)


def regex_report(pattern: str, sample: str) -> tuple[int, list[list[int]], str]:
    """Of a pattern tried on a sample: the number of matches, their first MAX_SPANS ranges, and what is wrong with it."""
    if not pattern:
        return 0, [], ""
    try:
        ranges = [list(m.span()) for m in regex.compile(pattern).finditer(sample)]
    except regex.error as e:
        return 0, [], str(e)
    return len(ranges), ranges[:MAX_SPANS], ""
