"""The numbered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import bpe_count, cgk_leaks, html_text, jaccard_join, knn_quality, lm_score, mih_topk, rlbwt_dedup, scaled_sketch, secret_tests, source_mix, spelling, whitening
from siftline.llm.support import table

TOKEN_LIMIT = 512
#: Words of the longest n-gram.
LM_ORDER = 3


def remainder(identifier: str, of: int) -> Column:
    """crc32 of an identifier as text, modulo a number; null has none."""
    return F.crc32(F.col(identifier).cast("string")) % of


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = remainder("doc_id", 5)
    group = F.when(rest == 1, lm_score.HELD_OUT).when(rest == 0, lm_score.DELETED).otherwise(lm_score.COUNTED)
    scored = lm_score.score(table(spark, sf_dir, "documents"), group, order=LM_ORDER)
    return scored.select("doc_id", (F.col("grp") == lm_score.HELD_OUT).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    model = knn_quality.train(docs, table(spark, sf_dir, "labels"), learn=~held_out)
    return knn_quality.score(docs, model).withColumn("held_out", held_out)


def op3_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlbwt_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cgk_leaks.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", mih_topk.sign_code(F.col("embedding")).alias("code"))
    return mih_topk.nearest(rows, rows.where(F.col("vec_id") % 100 == 0), k=10)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(table(spark, sf_dir, "documents"), jaccard_join.Rule(words=3, num=90, den=100))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_tests.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    every = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", *(of(k[0]) for k in secret_tests.KINDS), F.sha2(secret_tests.joined_spans(F.col("base")), 256).alias("base_sha256"), secret_tests.joined_spans(every).alias("spans"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = bpe_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    text = F.col("text")
    mixed = source_mix.mix(docs, identifier=F.col("doc_id"), source=F.col("source"), size=source_mix.word_count(text), weight=source_mix.quality_weight(text))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_whitened_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_scaled_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled_sketch.compared(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH c AS (
  SELECT DISTINCT vec_id, list_sum(list_transform(embedding[1:64], lambda x, i: CASE WHEN x > 0 THEN 1::HUGEINT << (i - 1)::INT ELSE 0::HUGEINT END))::HUGEINT AS code
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
r AS (
  SELECT q.vec_id AS query_id, c.vec_id, bit_count(xor(q.code, c.code))::INT AS distance,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY bit_count(xor(q.code, c.code)), c.vec_id) AS rank
  FROM c q JOIN c ON q.vec_id % 100 = 0)
SELECT query_id, rank::INT AS rank, vec_id, distance FROM r WHERE rank <= 10
"""

OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    CASE WHEN coalesce(length(text), 0) = 0 THEN 1.0 ELSE greatest(0.05::DOUBLE, 1 - least(1.0::DOUBLE, 4.0::DOUBLE * len(regexp_extract_all(text, '[#$%&*|!<>{}]')) / length(text))) END::DOUBLE AS w,
    (('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::UBIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS wt, 3.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, sum(source_size) OVER () AS budget,
        coalesce(sum(cap) OVER (ORDER BY cap / wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
        sum(wt) OVER (ORDER BY cap / wt, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM n),
l AS (SELECT arg_min(level, ratio) AS level FROM (SELECT (budget - capped)::DOUBLE / rest AS level, cap / wt AS ratio, cap, wt FROM o) WHERE cap > level * wt),
t AS (SELECT source, source_size, round(coalesce(least(cap, level * wt), cap), 6) AS target FROM o LEFT JOIN l ON true),
k AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs, -ln(u) / w AS key
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id::VARCHAR, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size / 2.0 AS upto FROM k)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN target - epochs * source_size > 0 AND upto <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""


#: crc32 is a fold over bytes, and words are near if they share a string of one letter less, or one is that string.  The
#: letters beyond ASCII become single bytes, as DuckDB's levenshtein() counts bytes.
OP11_SQL = r"""
WITH RECURSIVE t AS MATERIALIZED (
  SELECT list(list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS crc FROM range(256) r(b)),
r AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
h AS (
  SELECT run, times, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda c, x: xor(c >> 8, t.crc[(xor(c, x) & 255) + 1]))) AS h
  FROM r, t),
v AS (
  SELECT word, sum(times)::BIGINT AS n FROM (
    SELECT times, CASE WHEN h % 31 = 0 THEN run[1:(h % length(run))] || run[(h % length(run)) + 2:] ELSE run END AS word FROM h) WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
e AS (SELECT *, translate(word, (SELECT string_agg(chr((192 + i)::INT), '' ORDER BY i) FROM range(64) x(i)), (SELECT string_agg(chr((33 + i)::INT), '' ORDER BY i) FROM range(64) x(i))) AS bytes FROM v),
less AS (SELECT DISTINCT word, n, bytes, key FROM (SELECT word, n, bytes, bytes AS key FROM e UNION ALL SELECT word, n, bytes, bytes[1:i] || bytes[i + 2:] FROM e, range(length(bytes)) x(i))),
p AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM less a JOIN less b USING (key) WHERE a.word <> b.word AND levenshtein(a.bytes, b.bytes) = 1),
f AS (
  SELECT v.word, v.n, count(other) AS n_near, arg_min(other, (-other_n, other)) FILTER (WHERE other IS NOT NULL) AS best, max(other_n) AS best_n
  FROM v LEFT JOIN p ON p.word = v.word GROUP BY v.word, v.n),
g AS (SELECT word, n, n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n FROM f),
s AS (SELECT word, coalesce(form, word) AS here, 0 AS step FROM g UNION ALL SELECT s.word, g.form, step + 1 FROM s JOIN g ON g.word = s.here WHERE g.form IS NOT NULL)
SELECT g.word, n, n_near, form, form_n, root FROM g JOIN (SELECT word, arg_max(here, step) AS root FROM s GROUP BY word) USING (word)
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_lm_score, op2_quality_votes, op3_repeat_removal, op4_html_text, op5_benchmark_leaks, op6_hamming_topk, op7_jaccard_join, op8_secret_scans, op9_token_counts, op10_source_mix, op11_spelling_variants, op12_whitened_vectors, op13_scaled_sketches)}


def oracle_sql() -> dict[str, str]:
    return {"op6_hamming_topk": OP6_SQL, "op10_source_mix": OP10_SQL, "op11_spelling_variants": OP11_SQL}
