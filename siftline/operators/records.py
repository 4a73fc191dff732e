"""Records: typed filters over fields in JSON, grouping, validation, upserts, and histories of searches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a browser shows, and searches that a history keeps.
BROWSE, RECENT = 500, 20
_NUMBER = r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"


def _typed(value: str) -> int | float | str:
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            pass
    return value


def condition(json: Column, field: str, op: str, value: str) -> Column:
    """field op value on a JSON column; numbers compare as numbers, missing fields and unlike types match nothing.

    op is eq, ne, lt, le, gt, ge or contains; any other is eq.
    """
    got, want = F.get_json_object(json, f"$.{field}"), _typed(value)
    if op == "contains":
        return F.coalesce(F.contains(got, F.lit(value)), F.lit(False))
    if isinstance(want, str):
        left, right = F.when(~F.rlike(got, F.lit(_NUMBER)), got), F.lit(want)
    else:
        left, right = F.when(F.rlike(got, F.lit(_NUMBER)), got.cast("double")), F.lit(float(want))
    tests = {"ne": left != right, "lt": left < right, "le": left <= right, "gt": left > right, "ge": left >= right}
    return F.coalesce(tests.get(op, left == right), F.lit(False))


def filtered(records: DataFrame, conditions: list[tuple[str, str, str]], json: str = "props") -> DataFrame:
    """Records that pass all conditions."""
    return records.where(reduce(lambda a, b: a & b, (condition(F.col(json), *c) for c in conditions), F.lit(True)))


def grouped(records: DataFrame, field: str, json: str = "props") -> DataFrame:
    """(field_value, n) over records; missing fields are a group."""
    return records.groupBy(F.get_json_object(json, f"$.{field}").alias("field_value")).agg(F.count("*").alias("n"))


def _error(severity: str, field: str, message: str) -> Column:
    return F.struct(F.lit(severity).alias("severity"), F.lit(field).alias("field"), F.lit(message).alias("message"))


def validation_errors(records: DataFrame, schema: list[dict], path: str, json: str = "props") -> DataFrame:
    """(record_path, severity, field, message) for each rule that a record breaks; rules are name, type, required, range."""
    checks = []
    for rule in schema:
        got, name = F.get_json_object(json, f"$.{rule['name']}"), rule["name"]
        found = F.when(F.lit(bool(rule.get("required"))) & got.isNull(), _error("error", name, "missing"))
        if rule.get("type") in ("integer", "number"):
            found = found.when(got.isNotNull() & ~F.rlike(got, F.lit(_NUMBER)), _error("error", name, "not a number"))
        if rule.get("range"):
            low, high = rule["range"]
            found = found.when(~got.cast("double").between(low, high), _error("warning", name, "out of range"))
        checks.append(found)
    out = records.select(F.col(path).alias("record_path"), F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("e"))
    return out.select("record_path", "e.*")


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old without the keys of new, cases apart, and new."""
    keys = new.select(F.lower(key).alias("__key")).distinct()
    return old.join(keys, F.lower(old[key]) == F.col("__key"), "left_anti").unionByName(new)


def identity(fields: list[Column]) -> Column:
    """A search's key: its fields joined by |, booleans as True and False."""
    return F.concat_ws("|", *(F.coalesce(f, F.lit("")) for f in fields))


def recent(entries: DataFrame, key: Column, at: str, most: int = RECENT) -> DataFrame:
    """The latest entry of each key, newest first, so many at most."""
    last = entries.withColumn("__key", key).groupBy("__key").agg(F.max_by(F.struct(*entries.columns), at).alias("row"))
    return last.select("row.*").orderBy(F.desc(at)).limit(most)


def history_matches(entries: DataFrame, text: str, term: str = "term", path: str = "path") -> DataFrame:
    """Entries whose term or path holds the text, cases apart; blank keeps all."""
    if not text.strip():
        return entries
    has = lambda c: F.contains(F.lower(c), F.lit(text.strip().lower()))
    return entries.where(has(term) | has(path))


def candidates(files: DataFrame, index: DataFrame, on: str) -> DataFrame:
    """Files that an index proposes; they are searched like any others."""
    return files.join(index.select(on).distinct(), on, "left_semi")


def ranked(entries: DataFrame, key: str, at: str) -> DataFrame:
    return entries.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at))))
