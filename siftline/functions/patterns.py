"""Patterns: globs and regular expressions translated for Spark's regular expressions, and engine choice."""

from __future__ import annotations

import re

import regex
from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException

from siftline.spec import SearchSpec, SpecError

_EXTENDED = re.compile(r"\(\?<?[=!]|\(\?>|\\[1-9]|\\k[<{']|[*+?}]\+|\(\?\(")
#: Named classes in brackets, and what the Java engine calls them.
_POSIX = {"alpha": r"\p{IsAlphabetic}", "digit": r"\p{IsDigit}", "alnum": r"\p{IsAlphabetic}\p{IsDigit}", "upper": r"\p{IsUppercase}", "lower": r"\p{IsLowercase}", "space": r"\s", "punct": r"\p{Punct}", "xdigit": r"\p{XDigit}", "word": r"\w"}


#: Unicode's general categories, by their long names.
CATEGORIES = {
    "letter": "L", "casedletter": "LC", "uppercaseletter": "Lu", "lowercaseletter": "Ll", "titlecaseletter": "Lt", "modifierletter": "Lm", "otherletter": "Lo",
    "mark": "M", "nonspacingmark": "Mn", "spacingmark": "Mc", "enclosingmark": "Me", "number": "N", "decimalnumber": "Nd", "letternumber": "Nl", "othernumber": "No",
    "punctuation": "P", "connectorpunctuation": "Pc", "dashpunctuation": "Pd", "openpunctuation": "Ps", "closepunctuation": "Pe", "initialpunctuation": "Pi", "finalpunctuation": "Pf", "otherpunctuation": "Po",
    "symbol": "S", "mathsymbol": "Sm", "currencysymbol": "Sc", "modifiersymbol": "Sk", "othersymbol": "So", "separator": "Z", "spaceseparator": "Zs", "lineseparator": "Zl", "paragraphseparator": "Zp",
    "other": "C", "control": "Cc", "format": "Cf", "surrogate": "Cs", "privateuse": "Co", "unassigned": "Cn",
}
#: Properties that are no categories and no scripts, and what the Java engine calls them.
PROPERTIES = {"alphabetic": r"\p{IsAlphabetic}", "uppercase": r"\p{IsUppercase}", "lowercase": r"\p{IsLowercase}", "whitespace": r"\p{IsWhite_Space}", "ideographic": r"\p{IsIdeographic}", "hexdigit": r"\p{IsHex_Digit}", "any": r"[\x{0}-\x{10FFFF}]", "ascii": r"\p{ASCII}", "assigned": r"\p{IsAssigned}"}
_SHORT = {v.lower(): v for v in CATEGORIES.values()}


def _class(m: re.Match) -> str:
    """A Unicode class as the Java engine names it: a category, a property or a script, in braces or a single letter."""
    if m[2] is None and m[3] is None:
        return m[0]  # another escape
    name = m[2] if m[2] is not None else m[3]
    negated = (m[1] == "P") != name.startswith("^")
    kind, _, value = name.removeprefix("^").replace(":", "=").rpartition("=")
    plain = re.sub(r"[\s_-]", "", value).lower()
    plain = plain.removeprefix("is") if not kind else plain
    kind = re.sub(r"[\s_-]", "", kind).lower()
    if kind in ("", "gc", "generalcategory") and (category := CATEGORIES.get(plain) or _SHORT.get(plain)):
        out = f"\\p{{{category}}}"
    elif not kind and plain in PROPERTIES:
        out = PROPERTIES[plain]
    elif kind in ("", "sc", "script", "scx", "scriptextensions"):
        out = f"\\p{{Is{re.sub(r'[ -]', '_', value.strip().removeprefix('Is'))}}}"
    else:
        raise SpecError(f"unknown class {m[0]}")
    return out if not negated else f"[^{out[1:]}" if out.startswith("[") else out.replace(r"\p", r"\P", 1)


def glob_regex(glob: str) -> str:
    """An anchored regular expression for a file-name glob: * ? [..] [!..] {a,b} and backslash escapes."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out.append("[^/]*")
            while i < len(glob) and glob[i] == "*":
                i += 1
                out[-1] = ".*"
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            end = glob.find("]", i + (glob[i : i + 1] in ("!", "^")) + 1)
            if end < 0:
                raise SpecError(f"unclosed class in glob {glob!r}")
            body = glob[i:end]
            negated = body[:1] in ("!", "^")
            body = body[negated:].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&").replace("^", "\\^")
            out.append(f"[{'^' if negated else ''}{body}]")
            i = end + 1
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i < len(glob):
            out.append(quoted(glob[i]))
            i += 1
        else:
            out.append(quoted(c))
    if depth:
        raise SpecError(f"unclosed brace in glob {glob!r}")
    return "(?s)^" + "".join(out) + "$"


def quoted(text: str) -> str:
    """Text as a pattern that matches just itself, in Java and in Python."""
    return re.sub(r"([\\.^$|?*+()\[\]{}#&~\-\s])", r"\\\1", text)


def java_regex(pattern: str, case_sensitive: bool) -> str:
    """The pattern as Spark's engine reads it, with Unicode classes and line feeds as the only line ends."""
    out = re.sub(r"\(\?P<", "(?<", pattern)
    out = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", out)
    out = re.sub(r"\[:(\w+):\]", lambda m: _POSIX.get(m[1], m[0]), out)
    out = re.sub(r"\\(?:([pP])(?:\{([^}]*)\}|([A-Za-z]))|.)", _class, out)
    return tried(("(?dU)" if case_sensitive else "(?idU)") + out)


def tried(pattern: str) -> str:
    """The pattern, once Spark's engine has taken it; where no session is at hand it is taken as it is."""
    context = SparkContext._active_spark_context
    if context is not None and context._jvm is not None:
        try:
            context._jvm.java.util.regex.Pattern.compile(pattern)
        except (IllegalArgumentException, Py4JJavaError) as e:
            raise SpecError(f"invalid pattern: {e}") from e
    return pattern


def is_extended(pattern: str) -> bool:
    """Lookaround, back references, possessive or atomic groups: what a linear-time engine refuses."""
    return bool(_EXTENDED.search(re.sub(r"\\[^1-9k]", "", pattern)))


def engine_of(spec: SearchSpec) -> str:
    """fast or extended; raises if a pinned engine can't take the pattern or no engine can."""
    extended = is_extended(spec.term)
    if spec.engine == "fast" and extended:
        raise SpecError("the fast engine has no lookaround, back references or atomic groups")
    try:
        regex.compile(spec.term)
    except regex.error as e:
        raise SpecError(f"invalid pattern: {e}") from e
    return "extended" if extended or spec.engine == "extended" else "fast"


def python_regex(spec: SearchSpec) -> regex.Pattern:
    return regex.compile(spec.term, 0 if spec.case_sensitive else regex.IGNORECASE)


def java_template(template: str, groups: dict[str, int], count: int) -> str:
    """A replacement template with $1, $name and ${name}, for Java: unknown groups are empty, names are the longest."""
    out, i = [], 0
    while i < len(template):
        m = re.compile(r"\$(?:\{([^}]*)\}|([A-Za-z0-9_]+)|(\$))").match(template, i)
        if m is None:
            out.append("\\" + template[i] if template[i] in "\\$" else template[i])
            i += 1
            continue
        name = m[1] if m[1] is not None else m[2]
        if m[3]:
            out.append("\\$")
        elif name.isdigit() and int(name) <= count:
            # A digit that follows is not part of the group's number.
            out.append("$" + name + ("\\" if template[m.end() : m.end() + 1].isdigit() else ""))
        elif name in groups:
            out.append("${" + name + "}")
        i = m.end()
    return "".join(out)
