"""Evidence: snippets around the first rows of a view, packed into a budget breadth first."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.spec import SearchSpec

#: Rows of a view that become evidence, and the budgets allowed, in bytes.
MOST_ROWS = 400
LEAST_BUDGET, MOST_BUDGET = 2_000, 40_000


def rendered(path: str, lines: list[dict]) -> str:
    """A snippet as text: its path, then its lines, matches marked."""
    return f"{path}:\n" + "".join(f"{'> ' if x['is_match'] else '  '}{x['line_number']}: {x['content'].rstrip()}\n" for x in lines)


def pack(snippets: list[tuple[str, int, str]], budget: int) -> list[tuple[str, int, str]]:
    """(path, number, text) of those taken, in order of taking.

    Each pass takes at most the next snippet of each path; one that doesn't fit is tried again in the next pass.  Passes
    end when one takes nothing.
    """
    waiting: dict[str, list[tuple[str, int, str]]] = {}
    for s in snippets:
        waiting.setdefault(s[0], []).append(s)
    taken, used, grew = [], 0, True
    while grew:
        grew = False
        for queue in waiting.values():
            if queue and used + len(queue[0][2].encode()) <= budget:
                taken.append(queue.pop(0))
                used += len(taken[-1][2].encode())
                grew = True
    return taken


def packed(previews: DataFrame, budget: int = 8_000) -> DataFrame:
    """(full_path, snippet, taken_at, text) of the snippets that fit, from the first MOST_ROWS previews by path and line.

    The choice is one decision over at most MOST_ROWS small rows.
    """
    budget = min(max(budget, LEAST_BUDGET), MOST_BUDGET)
    rows = previews.orderBy(F.split("full_path", "/"), "line_number").limit(MOST_ROWS).withColumn("one", F.lit(1))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(parts=pdf.full_path.str.split("/").map(tuple)).sort_values(["parts", "line_number"], kind="stable")
        snippets, number = [], {}
        for path, lines in zip(pdf.full_path, pdf.lines):
            number[path] = number.get(path, 0) + 1
            snippets.append((path, number[path], rendered(path, lines)))
        out = pack(snippets, budget)
        return pd.DataFrame({"full_path": [x[0] for x in out], "snippet": [x[1] for x in out], "taken_at": range(1, len(out) + 1), "text": [x[2] for x in out]})

    return rows.groupBy("one").applyInPandas(choose, "full_path string, snippet long, taken_at long, text string")


def pack_statistics(packs: DataFrame, previews: DataFrame) -> DataFrame:
    """(files_included, snippets_included, truncated)"""
    there = previews.agg(F.count("*").alias("all"))
    got = packs.agg(F.countDistinct("full_path").alias("files_included"), F.count("*").alias("snippets_included"))
    return got.join(there, F.lit(True)).select("files_included", "snippets_included", (F.col("snippets_included") < F.col("all")).alias("truncated"))


def coverage(packs: DataFrame, previews: DataFrame, total: DataFrame) -> DataFrame:
    """One row: evidence and covered files and matches, all matches, and a notice where rows or budget left some out, else "".

    total is one row with matches, as aggregate.total gives it.
    """
    there = previews.agg(F.countDistinct("full_path").alias("evidence_files"), F.count("*").alias("evidence_matches"))
    got = packs.agg(F.countDistinct("full_path").alias("covered_files"), F.count("*").alias("covered_matches"))
    rows = there.join(got, F.lit(True)).join(total.select(F.col("matches").alias("total_matches")), F.lit(True))
    capped = F.format_string("Only the first %d of %d matches were considered, and %d of them fit the budget.", "evidence_matches", "total_matches", "covered_matches")
    short = F.format_string("Only %d of %d matches, in %d of %d files, fit the budget.", "covered_matches", "evidence_matches", "covered_files", "evidence_files")
    notice = F.when(F.col("total_matches") > F.col("evidence_matches"), capped).when(F.col("covered_matches") < F.col("evidence_matches"), short).otherwise("")
    return rows.withColumn("notice", notice)


def hints(spec: SearchSpec, path: str = "") -> list[str]:
    """What a search's options ask for, in words; last, a note on paths that are mounted or not on a disk."""
    asked = (
        (spec.respect_ignore, "ignore files are respected"), (spec.case_sensitive, "cases are apart"), (not spec.include_subfolders, "only the folder itself"),
        (spec.include_hidden, "hidden files and folders too"), (spec.include_binary, "binary files and documents too"), (spec.include_symlinks, "links are followed"),
        (spec.include_system, "system and dependency folders too"),
        (spec.match_file_names.strip(), f"file names: {spec.match_file_names.strip()}"), (spec.exclude_dirs.strip(), f"folders left out: {spec.exclude_dirs.strip()}"),
    )
    low = path.lower()
    if path == "/":
        place = "the whole file system, without its pseudo file systems"
    elif low.startswith(("/dev", "/proc", "/run", "/sys")):
        place = f"a pseudo file system: {path}"
    elif low.startswith(("/media/", "/mnt/")) or "/gvfs/" in low or "/kio-fuse/" in low:
        place = f"a mounted share or removable medium: {path}"
    else:
        place = ""
    return [words for on, words in asked if on] + ([place] if place else [])
