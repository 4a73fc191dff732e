"""Registered queries that SQL can't express, recomputed from the table in plain Python, with nothing of the library."""

import unicodedata

import pytest

from siftline.plans import queries as plans

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def lines(spark):
    """(path, its lines) of every document, by the components of paths."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").where("text IS NOT NULL").collect()
    out = {}
    for r in rows:
        parts = r.text.replace("\r\n", "\n").split("\n")
        out[f"/corpus/{r.lang}/{r.source}/{r.doc_id}.txt"] = parts[:-1] if parts[-1] == "" else parts
    return dict(sorted(out.items(), key=lambda x: x[0].split("/")))


def test_nfkd_fold(spark, lines):
    want = set()
    for path, each in lines.items():
        for number, line in enumerate(each, 1):
            n = unicodedata.normalize("NFKD", line).lower().count("license")
            if n:
                want.add((path.removeprefix("/corpus/"), number, n))
    got = {(r.relative_path, r.line_number, r.match_count) for r in plans.nfkd_fold(spark, SF).collect()}
    assert want and got == want


def packed(lines, budget=8_000, most=400, around=2):
    """Snippets of the first matching lines, taken a path at a time until no more fit: (path, number, place, text)."""
    found = [(path, n) for path, each in lines.items() for n, line in enumerate(each, 1) if "license" in line.lower()][:most]
    waiting, number = {}, {}
    for path, n in found:
        each = lines[path]
        rows = [(k, each[k - 1].replace("\0", "�")) for k in range(max(1, n - around), min(len(each), n + around) + 1)]
        text = f"{path}:\n" + "".join(f"{'> ' if k == n else '  '}{k}: {content.rstrip()}\n" for k, content in rows)
        number[path] = number.get(path, 0) + 1
        waiting.setdefault(path, []).append((number[path], text))
    taken, left = [], budget
    while True:
        before = len(taken)
        for path, queue in waiting.items():
            if queue and len(queue[0][1].encode()) <= left:
                n, text = queue.pop(0)
                left -= len(text.encode())
                taken.append((path, n, len(taken) + 1, text))
        if len(taken) == before:
            return taken, len(found)


def test_evidence(spark, lines):
    want, found = packed(lines)
    got = {tuple(r) for r in plans.evidence_pack(spark, SF).select("full_path", "snippet", "taken_at", "text").collect()}
    assert want and got == set(want)
    row = plans.evidence_statistics(spark, SF).first()
    assert (row.files_included, row.snippets_included, row.truncated) == (len({w[0] for w in want}), len(want), len(want) < found)
