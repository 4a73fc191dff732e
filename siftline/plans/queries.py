"""Registered queries over the test tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import folding, sql
from siftline.operators import aggregate, catalog, context, evidence, records, replace, search, view
from siftline.operators import predicates as p
from siftline.sinks import rows as sinks
from siftline.sinks import saved
from siftline.sources import corpus, decode, extract, grep_output, ignore, trigram_index
from siftline.sources.shared import bounded_batches, shared_folder
from siftline.spec import SearchSpec
from siftline.streaming import search as stream

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Lines of documents, as every search sees them.
LINES = r"""
f AS (SELECT '/corpus/' || concat_ws('/', lang, source, doc_id || '.txt') AS full_path, concat_ws('/', lang, source, doc_id || '.txt') AS relative_path, doc_id || '.txt' AS file_name, text FROM documents),
s AS (SELECT *, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM f WHERE text IS NOT NULL),
t AS (SELECT full_path, relative_path, file_name, CASE WHEN ls[-1] = '' THEN ls[1:-2] ELSE ls END AS ls FROM s),
l AS (SELECT full_path, relative_path, file_name, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_number FROM t)"""
#: Content rows of a search for license, cases not apart.
ROWS = (
    LINES
    + r""",
r AS (SELECT file_name, line_number, strpos(lower(line), 'license')::BIGINT AS column_number, substr(line, 1, 400) AS line_content,
  substr(line, 1, least(strpos(lower(line), 'license') - 1, 120)) AS match_preview_before, substr(line, strpos(lower(line), 'license'), 7) AS match_preview_match,
  substr(line, strpos(lower(line), 'license') + 7, 120) AS match_preview_after, full_path, relative_path,
  ((length(lower(line)) - length(replace(lower(line), 'license', ''))) / 7)::BIGINT AS match_count
  FROM l WHERE contains(lower(line), 'license'))"""
)
LICENSE = SearchSpec("license")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, for Python functions over whole texts."""
    return bounded_batches(spark).read.parquet(f"{sf_dir}/documents.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.varied_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def hits(spark: SparkSession, sf_dir: str, spec: SearchSpec = LICENSE) -> DataFrame:
    return search.content_rows(docs(spark, sf_dir), spec)


def counted(files: DataFrame, spec: SearchSpec) -> DataFrame:
    return search.matching_lines(files, spec).select("relative_path", "line_number", "match_count")


@query(f"WITH {LINES} SELECT relative_path, line_number, length(line)::INT AS n_chars FROM l")
def line_scan(spark, sf_dir):
    return search.lines_of(docs(spark, sf_dir)).select("relative_path", "line_number", F.length("line").alias("n_chars"))


@query(f"WITH {LINES} SELECT relative_path, line_number, ((length(line) - length(replace(line, 'The', ''))) / 3)::BIGINT AS match_count, strpos(line, 'The')::BIGINT AS column_number FROM l WHERE contains(line, 'The')")
def literal_cs(spark, sf_dir):
    rows = search.matching_lines(docs(spark, sf_dir), SearchSpec("The", case_sensitive=True))
    return rows.select("relative_path", "line_number", "match_count", (F.col("start") + 1).cast("long").alias("column_number"))


@query(f"WITH {LINES} SELECT relative_path, line_number, ((length(lower(line)) - length(replace(lower(line), 'license', ''))) / 7)::BIGINT AS match_count FROM l WHERE contains(lower(line), 'license')")
def literal_ci(spark, sf_dir):
    return counted(docs(spark, sf_dir), LICENSE)


@query(
    "WITH "
    + LINES.replace("FROM documents)", "FROM (SELECT * REPLACE ('\u0130\ufdd0\u0130 ' || replace(text, chr(10), chr(10) || '\u0130\ufdd0\u0130 ') AS text) FROM documents))")
    + """ SELECT relative_path, line_number, strpos(lower(replace(line, '\u0130', 'x')), 'license')::BIGINT AS column_number,
  substr(line, strpos(lower(replace(line, '\u0130', 'x')), 'license'), 7) AS match_preview_match FROM l WHERE contains(lower(replace(line, '\u0130', 'x')), 'license')"""
)
def literal_ci_places(spark, sf_dir):
    """Places in lines that begin with letters whose lower case is longer than they are, and a code point that is no character."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.concat(F.lit("\u0130\ufdd0\u0130 "), F.replace("text", F.lit("\n"), F.lit("\n\u0130\ufdd0\u0130 ")))
    return search.content_rows(corpus.documents(table.withColumn("text", text)), LICENSE).select("relative_path", "line_number", "column_number", "match_preview_match")


@query(rf"WITH {LINES} SELECT relative_path, line_number, len(regexp_extract_all(line, '(?i)li[a-z]+se'))::BIGINT AS match_count, length(regexp_extract(line, '(?is)^(.*?)li[a-z]+se', 1))::BIGINT + 1 AS column_number FROM l WHERE regexp_matches(line, '(?i)li[a-z]+se')")
def regex_fast(spark, sf_dir):
    rows = search.matching_lines(docs(spark, sf_dir), SearchSpec("li[a-z]+se", regex=True))
    return rows.select("relative_path", "line_number", "match_count", (F.col("start") + 1).cast("long").alias("column_number"))


WORDS_THE = "len(list_filter(regexp_split_to_array(lower(line), '[^\\p{L}\\p{N}_]+'), lambda x: x = 'the'))::BIGINT"


@query(f"WITH {LINES}, w AS (SELECT relative_path, line_number, {WORDS_THE} AS match_count FROM l) SELECT * FROM w WHERE match_count > 0")
def whole_word(spark, sf_dir):
    return counted(docs(spark, sf_dir), SearchSpec("the", whole_word=True))


@query(rf"WITH {LINES}, w AS (SELECT relative_path, line_number, len(list_filter(regexp_split_to_array(lower(line), '[^\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, 'th[a-z]n')))::BIGINT AS match_count FROM l) SELECT * FROM w WHERE match_count > 0")
def regex_whole_word(spark, sf_dir):
    return counted(docs(spark, sf_dir), SearchSpec("th[a-z]n", regex=True, whole_word=True))


@query(rf"WITH {LINES}, w AS (SELECT relative_path, line_number, len(regexp_extract_all(lower(line), 'license, '))::BIGINT AS match_count FROM l) SELECT * FROM w WHERE match_count > 0")
def regex_extended(spark, sf_dir):
    return counted(docs(spark, sf_dir), SearchSpec("license(?=, )", regex=True))


@query(f"WITH {LINES} SELECT relative_path, line_number, ((length(lower(strip_accents(line))) - length(replace(lower(strip_accents(line)), 'ete', ''))) / 3)::BIGINT AS match_count FROM l WHERE contains(lower(strip_accents(line)), 'ete')")
def diacritic_fold(spark, sf_dir):
    return counted(docs(spark, sf_dir), SearchSpec("ete", diacritic_sensitive=False))


@query(f"WITH {LINES} SELECT relative_path, line_number, ((length(lower(nfc_normalize(line))) - length(replace(lower(nfc_normalize(line)), 'ée', ''))) / 2)::BIGINT AS match_count FROM l WHERE contains(lower(nfc_normalize(line)), 'ée')")
def nfc_fold(spark, sf_dir):
    return counted(docs(spark, sf_dir), SearchSpec("ée", normalization="NFC"))


@query()
def nfkd_fold(spark, sf_dir):
    return counted(docs(spark, sf_dir), SearchSpec("license", normalization="NFKD"))


LOWER_TR = "lower(replace(replace(replace(line, 'İ', 'i'), 'I', 'ı'), 'İ', 'i'))"


@query(f"WITH {LINES}, w AS (SELECT relative_path, line_number, ((length({LOWER_TR}) - length(replace({LOWER_TR}, 'ıs', ''))) / 2)::BIGINT AS match_count FROM l) SELECT * FROM w WHERE match_count > 0")
def culture_lower_tr(spark, sf_dir):
    return counted(docs(spark, sf_dir), SearchSpec("ıs", comparison="current", culture="tr-TR"))


@query(f"WITH {ROWS} SELECT * FROM r")
def content_rows(spark, sf_dir):
    return hits(spark, sf_dir)


@query(
    f"""WITH {ROWS} SELECT full_path, any_value(relative_path) AS relative_path, any_value(file_name) AS file_name, any_value(d.size) AS size, sum(match_count)::BIGINT AS match_count, min(line_number) AS first_match_line_number,
  arg_min(match_preview_before, line_number) AS match_preview_before, arg_min(match_preview_match, line_number) AS match_preview_match, arg_min(match_preview_after, line_number) AS match_preview_after, 'txt' AS extension, 'UTF-8' AS encoding
  FROM r JOIN (SELECT '/corpus/' || concat_ws('/', lang, source, doc_id || '.txt') AS full_path, strlen(text)::BIGINT AS size FROM documents) d USING (full_path) GROUP BY full_path"""
)
def file_aggregate(spark, sf_dir):
    files = docs(spark, sf_dir)
    return aggregate.file_rows(search.content_rows(files, LICENSE), files, nested=False).drop("date_modified_unix")


@query(f"WITH {ROWS} SELECT full_path, string_agg(line_number || ':' || match_preview_match, ',' ORDER BY line_number) AS matches FROM r GROUP BY full_path")
def file_nested(spark, sf_dir):
    files = docs(spark, sf_dir)
    rows = aggregate.file_rows(search.content_rows(files, LICENSE), files)
    return rows.select("full_path", F.array_join(F.transform("preview_matches", lambda m: F.concat_ws(":", m["line_number"].cast("string"), m["match_preview_match"])), ",").alias("matches"))


SKIPS = r"""
v AS (SELECT doc_id, lang, CASE doc_id % 8 WHEN 0 THEN '.cache' WHEN 1 THEN 'vendor' WHEN 2 THEN 'storage/framework' ELSE source END AS folder,
  doc_id || CASE doc_id % 8 WHEN 3 THEN '.PNG' WHEN 4 THEN '.docx' WHEN 5 THEN '.md' ELSE '.txt' END AS file_name, strlen(text)::BIGINT AS size, text FROM documents),
w AS (SELECT *, concat_ws('/', lang, folder, file_name) AS relative_path, CASE WHEN folder IN ('vendor', 'storage/framework') THEN 'SystemPath'
  WHEN list_contains(string_split(lower(concat_ws('/', lang, folder, file_name)), '/'), 'src3') THEN 'ExcludedDir'
  WHEN NOT (file_name LIKE '%.txt' OR file_name LIKE '%.PNG' OR file_name LIKE '%.docx') OR file_name LIKE '1%' THEN 'FileName'
  WHEN size IS NULL THEN 'IoError' WHEN ceil(size / 1024.0) > 12 THEN 'Size'
  WHEN file_name LIKE '%.PNG' OR file_name LIKE '%.docx' THEN 'Binary' END AS skip_reason FROM v WHERE folder <> '.cache')"""
PICKY = SearchSpec("license", match_file_names="*.txt; *.{PNG,docx} | -1*", exclude_dirs="SRC3, nowhere", size_limit=2, size_unit="KB")


@query(f"WITH {SKIPS} SELECT skip_reason, count(*) AS n FROM w WHERE skip_reason IS NOT NULL GROUP BY ALL")
def classify_skip_reasons(spark, sf_dir):
    return p.skip_counts(varied(spark, sf_dir), PICKY)


@query(f"WITH {SKIPS}, g AS (SELECT relative_path, skip_reason FROM w) SELECT * FROM g")
def classified_files(spark, sf_dir):
    return p.classified(varied(spark, sf_dir), PICKY).select("relative_path", "skip_reason")


@query(rf"WITH {LINES} SELECT relative_path FROM f WHERE regexp_matches(file_name, '^1[0-9]*\.txt$') AND NOT regexp_matches(file_name, '^.*[02468]\.txt$')")
def name_globs(spark, sf_dir):
    return docs(spark, sf_dir).where(p.name_matches(F.col("file_name"), "1*.txt|-*[02468].txt")).select("relative_path")


@query("SELECT concat_ws('/', lang, source, doc_id || '.txt') AS relative_path FROM documents WHERE regexp_matches(source, '^src1') OR regexp_matches(lang, '^src1')")
def exclude_dirs(spark, sf_dir):
    return docs(spark, sf_dir).where(p.in_excluded_dir(F.col("relative_path"), "^src1")).select("relative_path")


@query("SELECT concat_ws('/', lang, source, doc_id || '.txt') AS relative_path, strlen(text)::BIGINT AS size FROM documents WHERE ceil(strlen(text) / 1024.0) BETWEEN 10 AND 30")
def size_filter(spark, sf_dir):
    spec = SearchSpec("x", size_limit=20, size_unit="KB", size_type="equal")
    return docs(spark, sf_dir).where(p.size_fits(F.col("size"), spec)).select("relative_path", "size")


@query("SELECT concat_ws('/', lang, CASE doc_id % 8 WHEN 1 THEN 'vendor' ELSE 'storage/framework' END, doc_id || '.txt') AS relative_path FROM documents WHERE doc_id % 8 IN (1, 2)")
def system_paths(spark, sf_dir):
    return varied(spark, sf_dir).where(p.is_system(F.col("relative_path"))).select("relative_path")


@query(
    f"""WITH {ROWS} SELECT (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS files_scanned, count(DISTINCT full_path) AS files_matched, coalesce(sum(match_count), 0)::BIGINT AS matches,
  (SELECT count(*) FROM documents WHERE text IS NULL) AS skipped_files, false AS cancelled, false AS capped FROM r"""
)
def search_summary(spark, sf_dir):
    return aggregate.summary(docs(spark, sf_dir), LICENSE)


@query(f"WITH {ROWS} SELECT full_path, line_number FROM r ORDER BY string_split(full_path, '/'), line_number LIMIT 25")
def max_results_topn(spark, sf_dir):
    return hits(spark, sf_dir, SearchSpec("license", max_results=25)).select("full_path", "line_number")


@query(f"WITH {ROWS} SELECT full_path, line_number FROM r WHERE contains(lower(match_preview_before || match_preview_match || match_preview_after), 'apache')")
def view_within_literal(spark, sf_dir):
    return view.within(hits(spark, sf_dir), " Apache ").select("full_path", "line_number")


@query(f"WITH {ROWS} SELECT full_path, line_number FROM r WHERE regexp_matches(match_preview_before || match_preview_match || match_preview_after, 'Version [0-9]')")
def view_within_regex(spark, sf_dir):
    return view.within(hits(spark, sf_dir), "Version [0-9]", regex=True).select("full_path", "line_number")


@query(f"WITH {ROWS} SELECT full_path, min(line_number) AS line_number, arg_min(match_preview_match, line_number) AS match_preview_match FROM r GROUP BY full_path")
def view_files_mode(spark, sf_dir):
    return view.files_mode(hits(spark, sf_dir)).select("full_path", "line_number", "match_preview_match")


@query(f"WITH {ROWS} SELECT full_path, line_number, row_number() OVER (PARTITION BY full_path ORDER BY line_number DESC)::INT AS rank FROM r")
def view_sorted(spark, sf_dir):
    return view.ranked_by_file(hits(spark, sf_dir), "line", False).select("full_path", "line_number", "rank")


@query(f"WITH {ROWS} SELECT full_path, line_number, match_preview_match FROM r ORDER BY match_preview_match DESC, string_split(full_path, '/'), line_number LIMIT 20")
def view_sorted_top(spark, sf_dir):
    return view.sorted_view(hits(spark, sf_dir), "match", False, top=20).select("full_path", "line_number", "match_preview_match")


@query(f"WITH {ROWS} SELECT DISTINCT full_path FROM r")
def files_only(spark, sf_dir):
    return aggregate.distinct_files(hits(spark, sf_dir))


@query(f"WITH {ROWS} SELECT coalesce(sum(match_count), 0)::BIGINT AS matches FROM r")
def count_total(spark, sf_dir):
    return aggregate.total(hits(spark, sf_dir))


@query(
    f"WITH {LINES}, n AS (SELECT full_path, line_number, contains(lower(line), 'license') AS is_match, bool_or(contains(lower(line), 'license')) OVER (PARTITION BY full_path ORDER BY line_number ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM l) SELECT full_path, line_number, is_match FROM n WHERE near"
)
def context_preview(spark, sf_dir):
    lines = search.lines_of(docs(spark, sf_dir).where(search.prefilter(LICENSE))).select("full_path", "line_number", F.contains(F.lower("line"), F.lit("license")).alias("hit"))
    return context.context_lines(lines, "hit", 1, 1)


@query(
    "WITH l AS (SELECT '/conversations/' || conv_id || '.log' AS full_path, turn::BIGINT AS line_number, contains(lower(text), 'the ') AS hit FROM conversations), n AS (SELECT *, bool_or(hit) OVER (PARTITION BY full_path ORDER BY line_number ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM l) SELECT full_path, line_number, hit AS is_match FROM n WHERE near"
)
def conversation_context(spark, sf_dir):
    lines = corpus.conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    # The role before the text doesn't hold the term.
    lines = lines.select("full_path", "line_number", F.coalesce(F.contains(F.lower("line"), F.lit("the ")), F.lit(False)).alias("hit"))
    return context.context_lines(lines, "hit", 2, 2)


def previews(spark, sf_dir):
    files = docs(spark, sf_dir)
    rows = search.content_rows(files, LICENSE)
    first = rows.orderBy(search.path_order(), "line_number").limit(evidence.MOST_ROWS)
    return context.preview(files, first.select("full_path", "line_number"), 2, 2)


@query()
def evidence_pack(spark, sf_dir):
    return evidence.packed(previews(spark, sf_dir), 8_000)


@query(f"WITH {ROWS} SELECT full_path || ':' || line_number || ':' || column_number || ':' || line_content AS row FROM r")
def text_rows(spark, sf_dir):
    return sinks.text_rows(hits(spark, sf_dir))


CELL = lambda c: f"CASE WHEN regexp_matches({c}, '[\",\\r\\n]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE {c} END"
GUARD = "CASE WHEN regexp_matches(line_content, '\\A[=+\\-@\\t\\r\\n]') THEN '''' || line_content ELSE line_content END"


@query(f"WITH {ROWS}, g AS (SELECT *, {GUARD} AS c FROM r) SELECT concat_ws(',', file_name, line_number::VARCHAR, column_number::VARCHAR, {CELL('c')}, full_path, match_count::VARCHAR) AS row FROM g")
def csv_rows(spark, sf_dir):
    return sinks.csv_rows(hits(spark, sf_dir))


@query(
    f"WITH {ROWS} SELECT '| ' || full_path || ' | ' || line_number || ' | ' || column_number || ' | ' || replace(replace(match_preview_before || match_preview_match || match_preview_after, '|', chr(92) || '|'), chr(10), ' ') || ' |' AS row FROM r"
)
def markdown_rows(spark, sf_dir):
    return sinks.markdown_rows(hits(spark, sf_dir))


FILES = "f AS (SELECT '/corpus/' || concat_ws('/', lang, source, doc_id || '.txt') AS full_path, text FROM documents WHERE contains(lower(text), 'license'))"


@query(f"WITH {FILES} SELECT full_path, len(regexp_extract_all(text, '(?i)license'))::BIGINT AS matches, md5(regexp_replace(text, 'license', 'permit', 'gi')) AS new_md5, 'modified' AS status FROM f")
def replace_literal(spark, sf_dir):
    return replace.replaced(docs(spark, sf_dir), LICENSE, "permit").select("full_path", "matches", F.md5("new_text").alias("new_md5"), "status")


@query(rf"WITH {FILES} SELECT full_path, len(regexp_extract_all(text, '(?i)(lic)(ense)'))::BIGINT AS matches, md5(regexp_replace(text, '(lic)(ense)', '\2-\1', 'gi')) AS new_md5, 'modified' AS status FROM f")
def replace_regex(spark, sf_dir):
    spec = SearchSpec("(?P<a>lic)(ense)", regex=True)
    return replace.replaced(docs(spark, sf_dir), spec, "$2-${a}").select("full_path", "matches", F.md5("new_text").alias("new_md5"), "status")


@query(f"WITH {ROWS} SELECT full_path || ':' || line_number || ':' || line_content AS row FROM r")
def replace_dry_run(spark, sf_dir):
    return replace.dry_run(docs(spark, sf_dir), LICENSE)


@query(f"WITH {FILES} SELECT count(*) AS modified, 0::BIGINT AS unchanged, 0::BIGINT AS failures, coalesce(sum(len(regexp_extract_all(text, '(?i)license'))), 0)::BIGINT AS matches FROM f")
def replace_summary(spark, sf_dir):
    return replace.summary(replace.replaced(docs(spark, sf_dir), LICENSE, "permit"))


def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


@query("SELECT event_id, event_type FROM events WHERE json_extract(props, '$.k')::DOUBLE >= 50 AND json_extract(props, '$.k')::DOUBLE <> 77")
def record_filter(spark, sf_dir):
    return records.filtered(events(spark, sf_dir), [("k", "ge", "50"), ("k", "ne", "77")]).select("event_id", "event_type")


@query("SELECT json_extract_string(props, '$.k') AS field_value, count(*) AS n FROM events GROUP BY ALL")
def record_view_group(spark, sf_dir):
    return records.grouped(events(spark, sf_dir), "k")


@query("SELECT event_id AS record_path, 'warning' AS severity, 'k' AS field, 'out of range' AS message FROM events WHERE json_extract(props, '$.k')::DOUBLE NOT BETWEEN 10 AND 90")
def record_validation(spark, sf_dir):
    return records.validation_errors(events(spark, sf_dir), [{"name": "k", "type": "integer", "required": True, "range": [10, 90]}], "event_id")


@query("SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id ORDER BY max(ts) DESC LIMIT 20")
def history_recent(spark, sf_dir):
    return records.recent(events(spark, sf_dir).select("user_id", "ts"), records.identity([F.col("user_id").cast("string")]), "ts")


@query("SELECT c_custkey AS id, lower(c_name) AS name, 'new' AS origin FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, c_name, 'old' FROM customer WHERE c_custkey % 3 <> 0")
def profile_upsert(spark, sf_dir):
    old = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("old").alias("origin"))
    new = old.where("id % 3 = 0").select("id", F.lower("name").alias("name"), F.lit("new").alias("origin"))
    return records.upserted(old, new, "name")


@query(f"WITH {ROWS} SELECT full_path, line_number FROM r WHERE EXISTS (SELECT 1 FROM labels WHERE labels.quality = 1 AND r.file_name = labels.doc_id || '.txt')")
def candidate_semi_join(spark, sf_dir):
    index = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"))
    return search.content_rows(records.candidates(docs(spark, sf_dir), index, "file_name"), LICENSE).select("full_path", "line_number")


@query(f"WITH {ROWS} SELECT '/srv/' || relative_path AS container_path, line_number, line_content AS content FROM r WHERE NOT contains(full_path, ':')")
def grep_output_parse(spark, sf_dir):
    rows = hits(spark, sf_dir)
    path = grep_output.moved(F.col("full_path"), "/corpus", "/srv/")
    end = F.when(F.col("line_number") % 2 == 0, F.lit("\0")).otherwise(F.lit(":"))
    return grep_output.parsed(rows.select(F.concat(path, end, F.col("line_number").cast("string"), F.lit(":"), "line_content").alias("line")))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS text FROM pages")
def markup_text(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    bare = F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), "[ \\t\\r\\n]+", " ")
    return pages.select("page_id", F.trim(bare).alias("text"))


BOMS = ("EFBBBF", "FFFE", "FEFF", "FFFE0000", "0000FEFF", "")


@query(
    "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'UTF-8 BOM' WHEN 1 THEN 'UTF-16 LE' WHEN 2 THEN 'UTF-16 BE' WHEN 3 THEN 'UTF-32 LE' WHEN 4 THEN 'UTF-32 BE' ELSE 'UTF-8' END AS encoding FROM documents"
)
def bom_detect(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = F.element_at(F.array(*(F.unhex(F.lit(b)) for b in BOMS)), (F.col("doc_id") % 6 + 1).cast("int"))
    return d.select("doc_id", decode.mark_label(F.concat(mark, F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("encoding"))


@query(f"WITH {LINES} SELECT relative_path, line_number, lower(strip_accents(line)) AS folded FROM l")
def folded_text(spark, sf_dir):
    lines = search.lines_of(docs(spark, sf_dir))
    return lines.select("relative_path", "line_number", folding.fold_column(F.col("line"), SearchSpec("x", diacritic_sensitive=False)).alias("folded"))


RULES = {"": "*.PNG\nvendor/\n/en/src3\n", "en": "!1*.PNG\n"}


@query(
    f"""WITH {SKIPS} SELECT concat_ws('/', lang, folder, file_name) AS relative_path, folder = 'vendor' OR (lang = 'en' AND folder = 'src3') OR (file_name LIKE '%.PNG' AND NOT (lang = 'en' AND file_name LIKE '1%')) AS ignored FROM v"""
)
def ignore_rules(spark, sf_dir):
    """Rules as a table, joined with the paths."""
    rules = ignore.rules_table(ignore.files_of(spark, RULES))
    return ignore.hidden(varied(spark, sf_dir), rules)


@query("SELECT doc_id, md5(text) AS text_md5, CASE doc_id % 3 WHEN 0 THEN 'UTF-16 LE' WHEN 1 THEN 'UTF-16 BE' ELSE 'UTF-8' END AS encoding FROM documents WHERE text IS NOT NULL")
def decode_text(spark, sf_dir):
    @F.pandas_udf("struct<text:string,encoding:string>")
    def decoded(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode.decoded(c) for c in content], columns=["text", "encoding"])

    d = texts(spark, sf_dir).where("text IS NOT NULL")
    k, text = F.col("doc_id") % 3, F.col("text")
    little = F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE"))
    big = F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE"))
    out = d.select("doc_id", decoded(F.when(k == 0, little).when(k == 1, big).otherwise(F.encode(text, "UTF-8"))).alias("t"))
    return out.select("doc_id", F.md5("t.text").alias("text_md5"), "t.encoding")


EXTRACTED = "SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL"


@query(EXTRACTED)
def docs_extract(spark, sf_dir):
    """Texts of the whole table, written as RTF and read again."""

    @F.pandas_udf("string")
    def plain(content: pd.Series) -> pd.Series:
        return content.map(lambda c: extract.extracted("rtf", extract.rich_text_of(c).encode("ascii")))

    d = texts(spark, sf_dir).where("text IS NOT NULL")
    return d.select("doc_id", F.md5(plain("text")).alias("text_md5"))


@query("SELECT lang, count(*) AS n, true AS good FROM documents WHERE regexp_matches(text, '[^\\x00-\\x7F]') GROUP BY lang")
def charset_guess(spark, sf_dir):
    """Whether 0.95 of the documents of each language are read right from bytes that don't say how they are written."""

    @F.pandas_udf("boolean")
    def right(some: pd.Series) -> pd.Series:
        data = [decode.encoded(t, "windows-1252") for t in some]
        return pd.Series([text.encode("utf-8") == d.decode("windows-1252").encode("utf-8") for (text, _), d in zip(decode.decoded_all(data), data)])

    d = texts(spark, sf_dir).where(F.rlike("text", F.lit("[^\\x00-\\x7F]")))
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), (F.avg(right("text").cast("int")) >= 0.95).alias("good"))


@query(f"WITH {ROWS} SELECT to_json({{'path': full_path, 'line': line_number, 'column': column_number, 'match': match_preview_before || match_preview_match || match_preview_after}})::VARCHAR AS row FROM r")
def view_json(spark, sf_dir):
    return sinks.view_json(hits(spark, sf_dir))


@query(f"WITH {LINES} SELECT relative_path, line_number, lower(strip_accents(line)) AS folded, ((length(lower(line)) - length(replace(lower(line), 'license', ''))) / 7)::INT AS n FROM l WHERE contains(lower(line), 'license')")
def sql_functions(spark, sf_dir):
    sql.register(spark)
    lines = search.lines_of(docs(spark, sf_dir)).where(F.contains(F.lower("line"), F.lit("license")))
    return lines.selectExpr("relative_path", "line_number", "fold_text(line) AS folded", "size(literal_spans(line, 'license')) AS n")


@query(f"WITH {ROWS} SELECT to_json(r)::VARCHAR AS row FROM r")
def json_rows(spark, sf_dir):
    return sinks.json_rows(hits(spark, sf_dir))


MATCH = "match_preview_before || match_preview_match || match_preview_after"


@query(f"WITH {ROWS}, g AS (SELECT *, {MATCH} AS line_content_, {GUARD.replace('line_content', '(' + MATCH + ')')} AS c FROM r) SELECT concat_ws(',', full_path, line_number::VARCHAR, column_number::VARCHAR, {CELL('c')}) AS row FROM g")
def view_csv(spark, sf_dir):
    return sinks.view_csv(hits(spark, sf_dir))


@query("SELECT doc_id, md5(regexp_replace(chr(27) || text, '[\\x00-\\x08\\x0A-\\x1F\\x7F-\\x{9F}]', '�', 'g')) AS text_md5 FROM documents WHERE text IS NOT NULL")
def printable(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL")
    return d.select("doc_id", F.md5(sinks.printable(F.concat(F.lit("\x1b"), "text"))).alias("text_md5"))


@query(f"WITH {ROWS}, n AS (SELECT least(count(*), 400) AS evidence_matches, count(*) AS all_rows, sum(match_count)::BIGINT AS total_matches FROM r) SELECT evidence_matches, total_matches, total_matches > evidence_matches AS capped FROM n")
def evidence_coverage(spark, sf_dir):
    before = previews(spark, sf_dir)
    out = evidence.coverage(evidence.packed(before, 8_000), before, aggregate.total(hits(spark, sf_dir)))
    return out.select("evidence_matches", "total_matches", F.startswith("notice", F.lit("Only the first")).alias("capped"))


INDEXED = ("license", "the", "sch", "Üb")


def new_index(spark: SparkSession, sf_dir: str) -> str:
    """A trigram index of all documents in the shared folder."""
    index = f"{shared_folder(spark)}/trigrams-{uuid.uuid4().hex}"
    trigram_index.build(docs(spark, sf_dir), index)
    return index


@query("WITH " + LINES + " SELECT literal, full_path FROM (VALUES " + ", ".join(f"('{x}')" for x in INDEXED) + ") t(literal), f WHERE contains(lower(text), lower(literal))")
def index_candidates(spark, sf_dir):
    """Of some literals, the files that an index proposes and that hold it."""
    index, files = new_index(spark, sf_dir), docs(spark, sf_dir)
    found = None
    for literal in INDEXED:
        some = trigram_index.candidates(spark, index, literal).select(F.lit(literal).alias("literal"), "full_path")
        found = some if found is None else found.unionByName(some)
    return found.join(files.select("full_path", "text"), "full_path").where(F.contains(F.lower("text"), F.lower("literal"))).select("literal", "full_path")


@query(f"WITH {ROWS} SELECT * FROM r")
def index_search(spark, sf_dir):
    """Content rows by way of an index: only its candidates are searched."""
    return search.content_rows(trigram_index.searched(docs(spark, sf_dir), new_index(spark, sf_dir), LICENSE), LICENSE)


@query()
def evidence_statistics(spark, sf_dir):
    before = previews(spark, sf_dir)
    return evidence.pack_statistics(evidence.packed(before, 8_000), before)


@query("SELECT c_custkey AS id, c_name AS term FROM customer WHERE contains(lower(c_name), '7') OR contains(lower(c_mktsegment), '7')")
def history_matches(spark, sf_dir):
    entries = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("term"), F.col("c_mktsegment").alias("path"))
    return records.history_matches(entries, " 7 ").select("id", "term")


@query(f"WITH {ROWS} SELECT full_path AS container_path, line_number, sum(match_count)::BIGINT AS n FROM r GROUP BY ALL")
def grep_output_occurrences(spark, sf_dir):
    rows = search.matching_lines(docs(spark, sf_dir), LICENSE)
    out = grep_output.occurrences(rows.select(F.concat("full_path", F.lit("\0"), F.col("line_number").cast("string"), F.lit(":"), "line").alias("line")), LICENSE)
    return out.groupBy("container_path", "line_number").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ROWS} SELECT 'Match' AS event, full_path, line_number FROM r UNION ALL SELECT DISTINCT 'FileScanned', full_path, NULL FROM r")
def progress_events(spark, sf_dir):
    return stream.progress(hits(spark, sf_dir))


@query("SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_events(spark, sf_dir):
    return stream.windowed_events(events(spark, sf_dir))


@query("SELECT event_id, event_type FROM events WHERE json_extract(props, '$.k')::DOUBLE > 50 ORDER BY event_id LIMIT 500")
def record_browse(spark, sf_dir):
    return catalog.browsed(records.filtered(events(spark, sf_dir), [("k", "gt", "50")]), "event_id").select("event_id", "event_type")


@query("SELECT CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN '' ELSE json_extract_string(props, '$.k') END AS group_value, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY ALL")
def record_materialized_view(spark, sf_dir):
    """A view in folders by a field, written to the shared folder and read from there; the field is missing or empty in some."""
    k = F.col("event_id") % 7
    rows = events(spark, sf_dir).withColumn("props", F.when(k == 0, F.lit("{}")).when(k == 1, F.lit('{"k": ""}')).otherwise(F.col("props")))
    written = catalog.materialized(rows, shared_folder(spark), f"by_k-{uuid.uuid4().hex}", "k")
    return written.groupBy("group_value").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query(
    "SELECT c_custkey AS id, json_object('name', c_name, 'segment', c_mktsegment, 'key', c_custkey::VARCHAR)::VARCHAR AS props, coalesce(nullif(lower(c_mktsegment), '') NOT LIKE '.%' AND NOT contains(c_mktsegment, '/') AND NOT contains(c_mktsegment, chr(92)), false) AS safe FROM customer"
)
def record_front_matter(spark, sf_dir):
    """Records written as front matter and read again."""
    d = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("key"))
    text = F.concat(catalog.front_matter(d, "name", "segment", "key"), F.lit("text\n"))
    return d.select(F.col("key").alias("id"), catalog.fields_of(text).alias("props"), catalog.safe_name(F.col("segment")).alias("safe"))


@query(
    "SELECT column_name AS name, CASE WHEN regexp_matches(column_type, '^(BIG|SMALL|TINY)?INT') THEN 'integer' WHEN regexp_matches(column_type, '^(DOUBLE|FLOAT|DECIMAL)') THEN 'number' WHEN column_type = 'BOOLEAN' THEN 'boolean' ELSE 'string' END AS type FROM (DESCRIBE customer)"
)
def collection_schema(spark, sf_dir):
    rules = catalog.schema_json(catalog.schema_rules(spark.read.parquet(f"{sf_dir}/customer.parquet")))
    return spark.sql("SELECT inline(from_json(:rules, 'array<struct<name:string,type:string>>'))", args={"rules": rules})


@query(
    """WITH c AS (SELECT *, CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS collection FROM customer)
SELECT collection, c_custkey::VARCHAR AS record, 'warning' AS severity, 'balance' AS field, 'out of range' AS message FROM c WHERE collection = 'even' AND NOT c_acctbal BETWEEN 0 AND 5000
UNION ALL SELECT collection, c_custkey::VARCHAR, 'error', 'segment', 'missing' FROM c WHERE collection = 'even' AND c_custkey % 5 = 0
UNION ALL SELECT collection, c_custkey::VARCHAR, 'error', 'name', 'not a number' FROM c WHERE collection = 'odd'
UNION ALL SELECT collection, c_custkey::VARCHAR, 'warning', 'key', 'out of range' FROM c WHERE collection = 'odd' AND c_custkey > 100"""
)
def record_schemas(spark, sf_dir):
    """Records of two collections by the rules of their own schema files."""
    root = f"{shared_folder(spark)}/collections-{uuid.uuid4().hex}"
    catalog.write_schema(spark, root, "even", [{"name": "segment", "required": True}, {"name": "balance", "type": "number", "range": [0, 5000]}])
    catalog.write_schema(spark, root, "odd", [{"name": "name", "type": "integer"}, {"name": "key", "type": "integer", "range": [0, 100]}])
    d = spark.read.parquet(f"{sf_dir}/customer.parquet")
    segment = F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment"))
    props = F.to_json(F.struct(F.col("c_name").alias("name"), segment.alias("segment"), F.col("c_acctbal").cast("string").alias("balance"), F.col("c_custkey").cast("string").alias("key")))
    rows = d.select(F.when(F.col("c_custkey") % 2 == 0, "even").otherwise("odd").alias("collection"), F.col("c_custkey").cast("string").alias("record"), props.alias("props"))
    return catalog.validated(rows, catalog.schemas_of(spark, root))


@query("SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g') || ' ' || chr(10) WHEN doc_id % 3 = 1 THEN '# Entries' || chr(10) || 'a.txt' || chr(10) || '# Contents' || chr(10) || '--- a.txt ---' || chr(10) || text || chr(10) ELSE text END) AS text_md5 FROM documents WHERE text IS NOT NULL")
def docs_extract_all(spark, sf_dir):
    """Texts of the whole table as office files, archives and rich text, read again by the table function of SQL."""

    @F.pandas_udf("binary")
    def as_file(ids: pd.Series, some: pd.Series) -> pd.Series:
        return pd.Series([extract.office_file(t) if i % 3 == 0 else extract.archive({"a.txt": t}) if i % 3 == 1 else extract.rich_text_of(t).encode("ascii") for i, t in zip(ids, some)])

    sql.register_tables(spark)
    d = texts(spark, sf_dir).where("text IS NOT NULL")
    path = F.concat(F.lit("a."), F.element_at(F.array(*map(F.lit, ("docx", "zip", "rtf"))), (F.col("doc_id") % 3 + 1).cast("int")))
    d.select("doc_id", path.alias("path"), as_file("doc_id", "text").alias("content")).createOrReplaceTempView("files_to_extract")
    return spark.sql("SELECT doc_id, md5(e.text) AS text_md5 FROM files_to_extract, LATERAL extract_text(path, content) e")


@query(
    """WITH c AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer)
SELECT id, name, segment FROM c WHERE id % 3 = 1 UNION ALL SELECT id + 1000000, upper(name), 'new' FROM c WHERE id % 3 = 0"""
)
def saved_records(spark, sf_dir):
    """Rows saved by name, a third of them put again under a name of other case, a third removed."""
    schema, path = "id long, name string, segment string", f"{shared_folder(spark)}/saved-{uuid.uuid4().hex}"
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    saved.put(rows, path, schema, "name")
    saved.put(rows.where("id % 3 = 0").select((F.col("id") + 1_000_000).alias("id"), F.upper("name").alias("name"), F.lit("new").alias("segment")), path, schema, "name")
    saved.remove(rows.where("id % 3 = 2").select(F.lower("name").alias("name")), path, schema, "name")
    return saved.saved(spark, path, schema, "name")


@query(f"WITH {ROWS}, j AS (SELECT full_path, line_number, to_json(r)::VARCHAR AS row, row_number() OVER (ORDER BY string_split(full_path, '/'), line_number) AS k FROM r) SELECT CASE WHEN k = 1 THEN '[' ELSE ',' END || row AS line FROM j UNION ALL SELECT CASE WHEN count(*) = 0 THEN '[]' ELSE ']' END FROM j")
def json_array(spark, sf_dir):
    return sinks.json_array(hits(spark, sf_dir))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: files that hold a term, with their counts and first matches."""
    return file_aggregate(spark, sf_dir)
