"""Ignore files: rules of lines, whether a path is ignored by the rules at hand, and the same as a plan over tables.

For a path, rules of the innermost directory that match it decide, the last line first; a kind of file that says anything
rules out the kinds below it: .ignore, .gitignore, git's exclude file, the user's own excludes.  The last three go no
further up than the innermost repository.  What is below an ignored directory is ignored.
"""

from __future__ import annotations

import configparser
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.patterns import quoted
from siftline.spec import SpecError

#: Kinds of ignore files by rank, and where those of a directory are.
GLOBAL, EXCLUDE, GITIGNORE, IGNORE = range(4)
PLACES = {IGNORE: ".ignore", GITIGNORE: ".gitignore", EXCLUDE: ".git/info/exclude"}
#: A row of rules that marks a repository's root.
REPOSITORY = -1
RULES = "scope string, kind int, depth int, line int, key string, pattern string, prefix string, negated boolean, only_dirs boolean"
FILES = "scope string, kind int, above int, prefix string, text string"


@dataclass(frozen=True)
class Rule:
    """A line: a pattern for whole paths below its directory, in Java and in Python, and a key that spares most of them:
    n: a name, e: what follows a name's last dot, p: a path; g: only the pattern tells."""

    key: str
    pattern: str
    negated: bool
    only_dirs: bool


@dataclass(frozen=True)
class Rules:
    """The rules of one file: what it is, its directory relative to the root, and for directories above the root how far up
    and how the root is called from there."""

    kind: int
    scope: str
    rules: tuple[Rule, ...]
    above: int = 0
    prefix: str = ""


def _translated(pattern: str) -> str | None:
    """The pattern as a regular expression; null if a class has no end."""
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
        elif pattern[i:] == "**" and (i == 0 or pattern[i - 1] == "/"):
            out.append(".*")
            i += 2
        elif pattern[i] == "*":
            out.append("[^/]*")
            i += 1
            while pattern[i : i + 1] == "*":
                i += 1
        elif pattern[i] == "?":
            out.append("[^/]")
            i += 1
        elif pattern[i] == "[":
            negated = pattern[i + 1 : i + 2] in ("!", "^")
            end = pattern.find("]", i + 2 + negated)
            if end < 0:
                return None
            body = re.sub(r"([\\\[\]^&~|])", r"\\\1", pattern[i + 1 + negated : end])
            out.append(f"(?!/)[{'^' if negated else ''}{body}]")
            i = end + 1
        elif pattern[i] == "\\" and i + 1 < len(pattern):
            out.append(quoted(pattern[i + 1]))
            i += 2
        else:
            out.append(quoted(pattern[i]))
            i += 1
    return "".join(out)


def _key(line: str, anchored: bool) -> str:
    if not re.search(r"[*?\[\\]", line):
        return f"p:{line}" if anchored else f"n:{line}"
    if not anchored and re.fullmatch(r"\*\.[^*?\[\\.]+", line):
        return f"e:{line[2:]}"
    return "g"


def rules_of(text: str) -> list[tuple[int, Rule]]:
    """(number of the line, its rule); lines that can't be read are left out."""
    rules = []
    for number, line in enumerate(text.removeprefix("﻿").splitlines()):
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[negated:]
        only_dirs = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        line = line.lstrip("/")
        pattern = _translated(line) if line else None
        if pattern is None:
            continue
        pattern = ("" if anchored else "(?:.*/)?") + pattern
        try:
            re.compile(pattern)
        except re.error:
            continue
        rules.append((number, Rule(_key(line, anchored), pattern, negated, only_dirs)))
    return rules


@lru_cache(maxsize=1 << 12)
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.S)


def _text(path: str) -> str | None:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return f.read()
    except OSError:
        return None


def rules_in(directory: str, scope: str = "", above: int = 0, prefix: str = "") -> list[Rules]:
    """What the ignore files of a directory say; a repository's root is told by a Rules without rules."""
    found = [Rules(REPOSITORY, scope, (), above, prefix)] if os.path.exists(os.path.join(directory, ".git")) else []
    for kind, place in PLACES.items():
        text = _text(os.path.join(directory, place))
        if text is not None:
            found.append(Rules(kind, scope, tuple(r for _, r in rules_of(text)), above, prefix))
    return found


def global_file() -> str | None:
    """The user's own excludes: what git's settings name, or else git's default place."""
    home = os.path.expanduser("~")
    config = os.environ.get("XDG_CONFIG_HOME") or os.path.join(home, ".config")
    for path in (os.path.join(home, ".gitconfig"), os.path.join(config, "git", "config")):
        settings = configparser.ConfigParser(strict=False, interpolation=None, allow_no_value=True)
        try:
            settings.read_string("\n".join(line.strip() for line in (_text(path) or "").splitlines()))
        except configparser.Error:
            continue
        if settings.has_option("core", "excludesfile") and (named := settings.get("core", "excludesfile")):
            return os.path.expanduser(named.strip('"'))
    return os.path.join(config, "git", "ignore")


def rules_above(root: str, excludes: str | None = None) -> list[Rules]:
    """What directories above a tree's root say about it, nearest first, and the user's own excludes."""
    found, at, names = [], os.path.realpath(root), []
    while (parent := os.path.dirname(at)) != at:
        names.insert(0, os.path.basename(at))
        at = parent
        found += rules_in(at, "", len(names), "/".join(names) + "/")
    text = _text(excludes) if excludes else None
    return found + ([Rules(GLOBAL, "", tuple(r for _, r in rules_of(text)))] if text else [])


def ignored(relative_path: str, is_dir: bool, stack: list[Rules]) -> bool:
    """Whether the rules of directories above a path ignore it; innermost directories stand last in the stack."""
    verdict: dict[int, bool] = {}
    inside = True  # of the innermost repository
    order = sorted(range(len(stack)), key=lambda k: (stack[k].kind == GLOBAL, -len(stack[k].scope), stack[k].above, k))
    for place in dict.fromkeys((stack[k].scope, stack[k].above) for k in order):
        mine = [s for s in stack if (s.scope, s.above) == place]
        for s in mine:
            if s.kind == REPOSITORY or s.kind in verdict or not (inside or s.kind in (IGNORE, GLOBAL)):
                continue
            below = s.prefix + (relative_path[len(s.scope) + 1 :] if s.scope else relative_path)
            for rule in reversed(s.rules):
                if (is_dir or not rule.only_dirs) and _compiled(rule.pattern).fullmatch(below):
                    verdict[s.kind] = not rule.negated
                    break
        inside = inside and not any(s.kind == REPOSITORY for s in mine)
    return verdict[max(verdict)] if verdict else False


# As a plan


def rules_table(files: DataFrame) -> DataFrame:
    """Rows of RULES from ignore files: (scope, kind, above, prefix, text), rows of kind REPOSITORY marking roots.

    depth is that of the directory, below 0 above the root.  Patterns of directories above the root, and the user's own, come
    with the prefix that paths have from there.
    """

    @F.pandas_udf("array<struct<line:int,key:string,pattern:string,negated:boolean,only_dirs:boolean>>")
    def parsed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"line": n, "key": r.key, "pattern": r.pattern, "negated": r.negated, "only_dirs": r.only_dirs} for n, r in rules_of(t or "")])

    depth = F.when(F.col("scope") == "", -F.col("above")).otherwise(F.size(F.split("scope", "/")))
    rules = files.where(F.col("kind") != REPOSITORY).select("scope", "kind", depth.alias("depth"), "prefix", F.inline(parsed("text")))
    roots = files.where(F.col("kind") == REPOSITORY).select("scope", "kind", depth.alias("depth"), "prefix", F.lit(0).alias("line"), F.lit("r").alias("key"), F.lit("").alias("pattern"), F.lit(False).alias("negated"), F.lit(False).alias("only_dirs"))
    every = rules.unionByName(roots)
    # From above the root, a path begins with the root's name, so its own path is no key.
    key = F.when((F.col("prefix") != "") & F.startswith("key", F.lit("p:")), "g").otherwise(F.col("key"))
    return every.withColumn("key", key).select("scope", "kind", "depth", "line", "key", "pattern", "prefix", "negated", "only_dirs")


def files_of(spark: SparkSession, by_directory: dict[str, str], kind: int = GITIGNORE) -> DataFrame:
    """Ignore files that are at hand, as rules_table() takes them: texts by directory."""
    return spark.createDataFrame([(d, kind, 0, "", t) for d, t in by_directory.items()], FILES)


def _ancestors(path: Column) -> Column:
    """Of a/b/c: a, a/b and a/b/c."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def hidden(paths: DataFrame, rules: DataFrame, path: str = "relative_path") -> DataFrame:
    """(path, ignored) of every distinct path, a file's, by a table of rules.

    Each directory is looked at once, however many files it has.  A path meets only rules that name it, its ending or
    itself, and those that need their pattern tried; matches of a path are as many as its rules at most.
    """
    files = paths.select(F.col(path).alias("path")).where(F.col("path").isNotNull()).distinct()
    chains = files.select("path", F.explode(_ancestors(F.col("path"))).alias("at"))
    at = chains.select("at", (F.col("at") != F.col("path")).alias("is_dir")).groupBy("at").agg(F.max("is_dir").alias("is_dir"))
    parent = F.slice(F.split("at", "/"), 1, F.size(F.split("at", "/")) - 1)
    scopes = F.concat(F.array(F.lit("")), F.when(F.size(parent) > 0, _ancestors(F.array_join(parent, "/"))).otherwise(F.array().cast("array<string>")))
    looked = at.select("at", "is_dir", F.explode(scopes).alias("scope"))
    below = F.when(F.col("scope") == "", F.col("at")).otherwise(F.substring(F.col("at"), F.length("scope") + 2, F.length("at")))
    name = F.element_at(F.split("at", "/"), -1)
    keys = F.array(F.lit("g"), F.lit("r"), F.concat(F.lit("n:"), name), F.concat(F.lit("p:"), F.col("below")), F.when(F.contains(name, F.lit(".")), F.concat(F.lit("e:"), F.element_at(F.split(name, r"\."), -1))))
    looked = looked.withColumn("below", below).withColumn("key", F.explode(keys)).where(F.col("key").isNotNull())
    met = looked.join(rules, ["scope", "key"]).where(F.col("is_dir") | ~F.col("only_dirs"))
    fits = F.when(F.col("key") == "g", F.rlike(F.concat("prefix", "below"), F.concat(F.lit("(?s)^(?:"), "pattern", F.lit(")\\z")))).otherwise(True)
    matched = met.where(fits).groupBy("at").agg(F.collect_list(F.struct("kind", "depth", "line", "negated")).alias("m"))
    # Rules of git end at the innermost repository's root.
    edge = F.coalesce(F.array_max(F.transform(F.filter("m", lambda r: r["kind"] == REPOSITORY), lambda r: r["depth"])), F.lit(-(1 << 30)))
    inside = matched.withColumn("edge", edge)
    counts = F.filter("m", lambda r: (r["kind"] != REPOSITORY) & (r["kind"].isin(IGNORE, GLOBAL) | (r["depth"] >= F.col("edge"))))
    gone = inside.where(~F.array_max(counts)["negated"]).select("at")
    lost = chains.join(gone, "at", "left_semi").select("path").distinct().withColumn("ignored", F.lit(True))
    return files.join(lost, "path", "left").select(F.col("path").alias(path), F.coalesce("ignored", F.lit(False)).alias("ignored"))


def ignored_in(paths: list[str], files: dict[str, str]) -> dict[str, bool]:
    """For each file path, whether the ignore files (by directory) hide it or a directory above it."""
    stack = [Rules(GITIGNORE, d, tuple(r for _, r in rules_of(t))) for d, t in files.items()]
    out = {}
    for path in paths:
        if path.startswith("/"):
            raise SpecError("paths are relative to the root")
        parts = path.split("/")
        heads = ["/".join(parts[:k]) for k in range(1, len(parts) + 1)]
        above = lambda at: [s for s in stack if not s.scope or at.startswith(s.scope + "/")]
        out[path] = any(ignored(at, at != path, above(at)) for at in heads)
    return out


def stack_of(root: str, top: str, above: list[Rules]) -> Iterator[Rules]:
    """The rules that hold in a directory of a tree, given relative to its root: those above, and of all down to it."""
    yield from above
    yield from rules_in(root)
    parts = top.split("/") if top else []
    for k in range(1, len(parts) + 1):
        yield from rules_in(os.path.join(root, *parts[:k]), "/".join(parts[:k]))
