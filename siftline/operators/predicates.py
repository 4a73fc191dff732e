"""Which files a search looks at: one expression names the first reason to skip a file, or is null."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.patterns import glob_regex
from siftline.spec import MAX_FILE_BYTES, SIZE_TOLERANCE_KB, UNIT_KB, SearchSpec, SpecError

#: Directories of systems and tools, file types that are not text, and those of them that can be searched.
SYSTEM_NAMES = ("bin", "dev", ".git", "node_modules", "obj", "proc", "sys", "vendor")
BINARY_TYPES = (
    "7z", "avi", "bin", "bmp", "cache", "dll", "doc", "docx", "exe", "flac", "gif", "gz", "ico", "idx", "jpeg", "jpg", "lock", "mkv", "mp3", "mp4",
    "obj", "ogg", "pack", "pdb", "pdf", "png", "ppt", "pptx", "rar", "rtf", "svg", "tar", "wav", "webp", "xls", "xlsx", "zip",
)
SEARCHABLE_TYPES = ("docx", "odp", "ods", "odt", "pdf", "pptx", "rtf", "xlsx", "zip")


def components(relative_path: Column) -> Column:
    return F.split(relative_path, "/")


def is_hidden(relative_path: Column) -> Column:
    return F.exists(components(relative_path), lambda c: c.startswith("."))


def is_system(relative_path: Column) -> Column:
    return F.arrays_overlap(components(relative_path), F.array(*map(F.lit, SYSTEM_NAMES))) | F.rlike(relative_path, F.lit("(^|/)storage/framework(/|$)"))


def name_matches(file_name: Column, globs: str) -> Column:
    """Globs divided by | or ;, those that begin with - exclude; without any to include all names are included."""
    parts = [p.strip() for p in re.split(r"[|;]", globs) if p.strip()]
    excluded = [p[1:].strip() for p in parts if p.startswith("-") and p[1:].strip()]
    included = [p for p in parts if not p.startswith("-")]
    any_of = lambda ps: F.rlike(file_name, F.lit("|".join(f"(?:{glob_regex(p)})" for p in ps)))
    keep = any_of(included) if included else F.lit(True)
    return keep & ~any_of(excluded) if excluded else keep


def in_excluded_dir(relative_path: Column, rule: str) -> Column:
    """Names divided by , or ; compared without regard to ASCII case, or a regular expression tried on each component."""
    rule = rule.strip()
    if not rule:
        return F.lit(False)
    if re.search(r"[\^$|]", rule) and not re.search(r"[,;]", rule):
        try:
            re.compile(rule)
        except re.error as e:
            raise SpecError(f"invalid directory pattern: {e}") from e
        return F.exists(components(relative_path), lambda c: F.rlike(c, F.lit(rule)))
    names = [n.strip().lower() for n in re.split(r"[,;]", rule) if n.strip()]
    return F.arrays_overlap(F.split(F.lower(relative_path), "/"), F.array(*map(F.lit, names))) if names else F.lit(False)


def size_fits(size: Column, spec: SearchSpec) -> Column:
    """In whole KB, rounded up, with the unit's tolerance."""
    if spec.size_limit is None:
        return F.lit(True)
    kb, limit, slack = F.ceil(size / 1024), spec.size_limit * UNIT_KB[spec.size_unit], SIZE_TOLERANCE_KB[spec.size_unit]
    if spec.size_type == "less":
        return kb <= limit + slack
    if spec.size_type == "greater":
        return kb >= max(0, limit - slack)
    return kb.between(max(0, limit - slack), limit + slack)


def is_binary(extension: Column, include_binary: bool) -> Column:
    """Null extensions are text.  Searchable types count as text if binary files are included."""
    known = F.coalesce(extension.isin(*BINARY_TYPES), F.lit(False))
    return known & ~F.coalesce(extension.isin(*SEARCHABLE_TYPES), F.lit(False)) if include_binary else known


def skip_reason(spec: SearchSpec) -> Column:
    """Null for files to search; else the first reason in a fixed order."""
    path, name, size = F.col("relative_path"), F.col("file_name"), F.col("size")
    out = F.when(F.lit(not spec.include_system) & is_system(path), "SystemPath")
    out = out.when(in_excluded_dir(path, spec.exclude_dirs), "ExcludedDir")
    out = out.when(~name_matches(name, spec.match_file_names), "FileName")
    out = out.when(size.isNull(), "IoError")
    out = out.when((size > MAX_FILE_BYTES) | ~size_fits(size, spec), "Size")
    return out.when(is_binary(F.col("extension"), spec.include_binary), "Binary")


def walkable(files: DataFrame, spec: SearchSpec) -> DataFrame:
    """Files that the walk shows at all: hidden ones, and those below the root's own folder, may be left out uncounted."""
    out = files if spec.include_hidden else files.where(~is_hidden(F.col("relative_path")))
    return out if spec.include_subfolders else out.where(~F.col("relative_path").contains("/"))


def classified(files: DataFrame, spec: SearchSpec) -> DataFrame:
    return walkable(files, spec).withColumn("skip_reason", skip_reason(spec))


def skip_counts(files: DataFrame, spec: SearchSpec) -> DataFrame:
    """(skip_reason, n) over skipped files."""
    return classified(files, spec).where(F.col("skip_reason").isNotNull()).groupBy("skip_reason").agg(F.count("*").alias("n"))
