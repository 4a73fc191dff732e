"""Collections of records below a root: names, schemas, front matter, browsing, and views written as partitioned tables.

A record is a Markdown file with front matter, <root>/<collection>/<record>; a collection's schema.md describes it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from siftline.operators.records import BROWSE

#: The folder of views, the file of a schema, and names that YAML reads as something else than text.
VIEWS, SCHEMA = "views", "schema.md"
#: Folders of a grouped view, besides that of missing values.
FOLDERS = 256
NOT_TEXT = "false|n|no|null|off|on|true|y|yes"
_SAFE = r"\A[^./\\][^/\\]*\z"
_MATTER = r"(?s)\A---\r?\n(.*?\n|)---(?:\r?\n|\z)"


def safe_name(name: Column) -> Column:
    """Whether a name is one entry below views: not empty, no leading dot, no separators; null is not."""
    return F.coalesce(F.rlike(name, F.lit(_SAFE)), F.lit(False))


def located(path: Column, root: str) -> tuple[Column, Column]:
    """(collection, record) of a record's path; nulls for hidden folders, views, schema files and paths elsewhere."""
    clean = root.rstrip("/") + "/"
    rest = F.when(F.startswith(path, F.lit(clean)), F.substring(path, F.lit(len(clean) + 1), F.length(path)))
    name, record = F.regexp_extract(rest, r"(?s)\A([^/]*)/(.+)\z", 1), F.regexp_extract(rest, r"(?s)\A([^/]*)/(.+)\z", 2)
    there = (name != "") & ~F.startswith(name, F.lit(".")) & (name != VIEWS) & (record != SCHEMA)
    return F.when(there, name), F.when(there, record)


def _scalar(value: Column, kind: T.DataType) -> Column:
    """A value as YAML: text in double quotes where its plain form would be read as another type or as syntax."""
    text = value.cast("string")
    if isinstance(kind, T.StringType):
        plain = F.rlike(text, F.lit(r"\A[A-Za-z_/][A-Za-z0-9_./-]*(?: [A-Za-z0-9_./-]+)*\z")) & ~F.rlike(text, F.lit(rf"(?i)\A(?:{NOT_TEXT})\z"))
        quoted = F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)\A\{"v":(.*)\}\z', 1)
        text = F.when(plain, text).otherwise(quoted)
    return F.when(value.isNull(), "null").otherwise(text)


def front_matter(records: DataFrame, *names: str) -> Column:
    """The named columns as a block of front matter, one a line."""
    lines = [F.concat(F.lit(f"{n}: "), _scalar(F.col(n), records.schema[n].dataType), F.lit("\n")) for n in names]
    return F.concat(F.lit("---\n"), *lines, F.lit("---\n"))


def fields_of(text: Column) -> Column:
    """Front matter's lines `name: value` as JSON, values as strings, null and ~ left out; {} without front matter.

    The last of repeated names counts; nested values are not read.
    """
    lines = F.filter(F.split(F.regexp_extract(text, _MATTER, 1), "\r?\n"), lambda x: F.rlike(x, F.lit(r"\A[A-Za-z_][A-Za-z0-9_-]*:(?: |\z)")))

    def pair(line: Column) -> Column:
        raw = F.trim(F.regexp_replace(line, F.lit(r"\A[^:]*:"), F.lit("")))
        single = F.replace(F.substring(raw, F.lit(2), F.length(raw) - 2), F.lit("''"), F.lit("'"))
        value = F.when(F.startswith(raw, F.lit('"')), F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v"))
        value = value.when(F.rlike(raw, F.lit(r"\A'.*'\z")), single).when(raw.isin("", "~", "null"), F.lit(None)).otherwise(raw)
        return F.struct(F.substring_index(line, ":", 1).alias("key"), value.alias("value"))

    pairs = F.transform(lines, pair)
    last = F.filter(pairs, lambda x, i: x["value"].isNotNull() & ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["key"] == x["key"]))
    return F.coalesce(F.to_json(F.map_from_entries(last)), F.lit("{}"))


def records_of(spark: SparkSession, root: str, collection: str | None = None) -> DataFrame:
    """(collection, record, props, text) of all Markdown records below a root, or of one collection."""
    raw = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).text(root, wholetext=True)
    path = F.url_decode(F.replace(F.regexp_replace(F.col("_metadata.file_path"), F.lit("^file:/*"), F.lit("/")), F.lit("+"), F.lit("%2B")))
    name, record = located(path, root)
    out = raw.select(name.alias("collection"), record.alias("record"), fields_of(F.col("value")).alias("props"), F.col("value").alias("text")).where("collection IS NOT NULL")
    return out if collection is None else out.where(F.col("collection") == collection)


def collections(records: DataFrame) -> DataFrame:
    """(collection, n) of all that have records."""
    return records.groupBy("collection").agg(F.count(F.lit(1)).alias("n"))


def _kind(kind: T.DataType) -> str:
    if isinstance(kind, T.IntegralType):
        return "integer"
    if isinstance(kind, T.FractionalType):
        return "number"
    return "boolean" if isinstance(kind, T.BooleanType) else "array" if isinstance(kind, T.ArrayType) else "string"


def schema_rules(records: DataFrame, ranges: dict[str, tuple[float, float]] | None = None) -> list[dict]:
    """A rule for each column, as records.validation_errors takes them: name, type, required, range."""
    return [{"name": f.name, "type": _kind(f.dataType), "required": not f.nullable, "range": list(ranges[f.name]) if f.name in (ranges or {}) else None} for f in records.schema]


def schema_json(rules: list[dict]) -> str:
    """The rules as a JSON array of {name, type, required, range}; range is null where there is none."""
    return json.dumps([{"name": r["name"], "type": r.get("type", "string"), "required": bool(r.get("required")), "range": r.get("range")} for r in rules], ensure_ascii=False)


RULES = "array<struct<name:string,type:string,required:boolean,range:array<double>>>"
_BLOCK = r"(?s)```json\r?\n(.*?)```"
#: What the values of each type look like, and what is said of others.
TYPES = {"integer": (r"\A-?\d+\z", "not a number"), "number": (r"\A-?\d+(\.\d+)?([eE][+-]?\d+)?\z", "not a number"), "boolean": (r"\A(true|false)\z", "not a boolean"), "array": (r"(?s)\A\[.*\]\z", "not an array")}


def write_schema(spark: SparkSession, root: str, collection: str, rules: list[dict], about: str = "") -> str:
    """Writes a collection's schema.md, its rules as a block of JSON, by way of Spark's file systems; its path."""
    if not spark.range(1).select(safe_name(F.lit(collection))).first()[0]:
        raise ValueError(f"{collection!r} is no name of a collection")
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{collection}/{SCHEMA}")
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(f"# {collection}\n\n{about}\n\n```json\n{schema_json(rules)}\n```\n".encode())
    finally:
        out.close()
    return where.toString()


def schemas_of(spark: SparkSession, root: str) -> DataFrame:
    """(collection, rules) of the schema files below a root; rules are null where a file has no block that can be read."""
    raw = spark.read.option("pathGlobFilter", SCHEMA).option("recursiveFileLookup", True).text(root, wholetext=True)
    path = F.url_decode(F.replace(F.regexp_replace(F.col("_metadata.file_path"), F.lit("^file:/*"), F.lit("/")), F.lit("+"), F.lit("%2B")))
    clean = root.rstrip("/") + "/"
    rest = F.when(F.startswith(path, F.lit(clean)), F.substring(path, F.lit(len(clean) + 1), F.length(path)))
    name = F.regexp_extract(rest, rf"\A([^/]+)/{SCHEMA}\z", 1)
    out = raw.select(name.alias("collection"), F.from_json(F.regexp_extract("value", _BLOCK, 1), RULES).alias("rules"))
    return out.where((F.col("collection") != "") & ~F.startswith("collection", F.lit(".")) & (F.col("collection") != VIEWS))


def _fields(props: Column) -> Column:
    return F.from_json(props, "map<string,string>")


def validated(records: DataFrame, schemas: DataFrame) -> DataFrame:
    """(collection, record, severity, field, message) of each rule of its own collection's schema that a record breaks.

    records has collection, record and props.  Collections without a schema, or with one that can't be read, break none.  A
    value out of range is a warning, all else is an error; one rule says one thing of a record.
    """
    rules = schemas.select("collection", F.explode("rules").alias("rule"))
    each = records.select("collection", "record", _fields(F.col("props")).alias("fields")).join(rules, "collection")
    value, rule = F.try_element_at("fields", F.col("rule.name")), F.col("rule")
    said = F.when(value.isNull(), F.when(F.coalesce(rule["required"], F.lit(False)), F.struct(F.lit("error").alias("severity"), F.lit("missing").alias("message"))))
    for kind, (looks, message) in TYPES.items():
        said = said.when((rule["type"] == kind) & ~F.rlike(value, F.lit(looks)), F.struct(F.lit("error").alias("severity"), F.lit(message).alias("message")))
    number = value.try_cast("double")
    outside = number.isNotNull() & (F.size(rule["range"]) == 2) & ~number.between(F.get(rule["range"], 0), F.get(rule["range"], 1))
    said = said.when(outside, F.struct(F.lit("warning").alias("severity"), F.lit("out of range").alias("message")))
    return each.select("collection", "record", rule["name"].alias("field"), said.alias("said")).where("said IS NOT NULL").select("collection", "record", "said.severity", "field", "said.message")


def typed(records: DataFrame, rules: list[dict]) -> DataFrame:
    """collection, record and a column for each rule, of its type; null where a value is none of that type."""
    kinds = {"integer": "long", "number": "double", "boolean": "boolean"}
    fields = records.select("collection", "record", _fields(F.col("props")).alias("__fields"))
    value = lambda r: F.try_element_at("__fields", F.lit(r["name"]))
    column = lambda r: F.from_json(value(r), "array<string>") if r.get("type") == "array" else value(r).try_cast(kinds.get(r.get("type"), "string"))
    return fields.select("collection", "record", *(column(r).alias(r["name"]) for r in rules))


def browsed(records: DataFrame, by: str, most: int = BROWSE) -> DataFrame:
    """The first records in order of their paths, as many as a browser shows."""
    return records.orderBy(by).limit(most)


def store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON store; a missing or blank one is empty, a corrupt one is an error once it is read."""
    try:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def materialized(records: DataFrame, root: str, name: str, group: str | None = None, json: str = "props") -> DataFrame:
    """Writes records as the view <root>/views/<name>, in folders by a field of the JSON column if asked, and reads it.

    A written view of that name is replaced.  The read view has the field as group_value; records without it are a group of
    their own, apart from those where it is empty.  Folders are named by a hash of the value, so that there are FOLDERS and one
    for missing values at most, whatever values hold; within a folder rows are sorted by value.  Spark splits large groups over
    tasks and gathers small ones.
    """
    if not records.sparkSession.range(1).select(safe_name(F.lit(name))).first()[0]:
        raise ValueError(f"{name!r} is no name of a view")
    path, out = f"{root.rstrip('/')}/{VIEWS}/{name}", records
    if group is None:
        out.write.mode("overwrite").parquet(path)
        return records.sparkSession.read.schema(out.schema).parquet(path)
    value = F.get_json_object(json, f"$.{group}")
    out = records.withColumn("group_value", value).withColumn("group_folder", F.when(F.col("group_value").isNull(), "none").otherwise(F.lower(F.hex(F.pmod(F.xxhash64("group_value"), F.lit(FOLDERS))))))
    out.hint("rebalance", "group_folder").sortWithinPartitions("group_folder", "group_value").write.mode("overwrite").partitionBy("group_folder").parquet(path)
    return records.sparkSession.read.schema(out.schema).parquet(path).drop("group_folder")


def views(spark: SparkSession, root: str) -> DataFrame:
    """(name) of the views below a root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{root.rstrip('/')}/{VIEWS}")
    return files.select(F.regexp_extract("path", rf"/{VIEWS}/([^/]+)/", 1).alias("name")).distinct()
