"""Queries opN_<name> over the driver's tables, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, language, line_dedup, lm_scoring, mixing, near_dedup, quality, token_counts, token_output


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_shared_lines(_read(spark, sf_dir, "documents"))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_files(_read(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_read(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).drop("source")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(_read(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(chat.format_conversations(turns))


QUERIES = {
    f.__name__: f
    for f in (op1_minhash_near_dedup, op2_line_dedup, op3_token_output, op4_language_id, op5_token_counts, op6_mixing, op7_decontamination, op8_quality_rules, op9_lm_scoring, op10_chat_format)
}

_SPACE = r"[^\x20\x09-\x0D]"

OP1_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM shingles p JOIN shingles q ON p.s = q.s AND p.doc_id <> q.doc_id GROUP BY 1, 2) x
  JOIN sizes m ON m.doc_id = x.a JOIN sizes n ON n.doc_id = x.b WHERE 100 * x.c >= 75 * (m.n + n.n - x.c)
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), low AS (
  SELECT a, min(b) AS b FROM reach GROUP BY a
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(low.b, d.doc_id)) AS component_id, d.doc_id <= coalesce(low.b, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN low ON low.a = d.doc_id
"""

OP2_SQL = rf"""
WITH lines AS (
  SELECT doc_id, coalesce('=' || source, 'null') AS site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL
), bad AS (
  SELECT line FROM lines WHERE regexp_matches(line, '{_SPACE}') GROUP BY line HAVING count(DISTINCT site) >= 5
), marked AS (
  SELECT l.*, regexp_matches(l.line, '{_SPACE}') AS filled, b.line IS NOT NULL AS gone FROM lines l LEFT JOIN bad b ON l.line = b.line
), cleaned AS (
  SELECT doc_id, count(*) FILTER (filled) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_removed, 0) AS n_removed, c.text FROM documents d LEFT JOIN cleaned c USING (doc_id)
"""

OP6_SQL = rf"""
WITH sizes AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '{_SPACE}+')) END AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key
  FROM documents
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM sizes GROUP BY source
), weighted AS (
  SELECT *, CAST([3, 1, 2][CAST((r - 1) % 3 + 1 AS INT)] AS DOUBLE) AS w, 2.0::DOUBLE * source_size AS cap FROM src
), levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
    row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS k FROM weighted
), goal AS (
  SELECT source, source_size, CASE WHEN level * w >= cap THEN cap ELSE arg_min(level, k) FILTER (NOT level * w >= cap) OVER () * w END AS target FROM levels
), budget AS (
  SELECT *, CAST(floor(target) AS BIGINT) AS budget, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM goal
), runs AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, b.epochs, b.budget - b.epochs * b.source_size AS rest,
    coalesce(CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id NULLS FIRST, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before
  FROM sizes s JOIN budget b ON s.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM runs
"""

OP10_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, len(regexp_extract_all(text, '{_SPACE}+')) + 4 AS tokens,
    length('<|turn|><|text|><|end|>') + length(replace(replace(role, '&', '&amp;'), '<|', '&lt;|')) + length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|')) AS chars
  FROM turns
), placed AS (
  SELECT *, row_number() OVER w AS idx, sum(tokens) OVER w - tokens AS before FROM sized WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
), led AS (
  SELECT *, CASE WHEN first(role) OVER w = 'system' AND first(tokens) OVER w <= 192 THEN first(tokens) OVER w ELSE 0 END AS system_tokens, first(chars) OVER w AS first_chars
  FROM placed WINDOW w AS (PARTITION BY conv_id ORDER BY idx ROWS UNBOUNDED PRECEDING)
), spans AS (
  SELECT *, 384 - system_tokens AS room, tokens > 384 - system_tokens AS alone,
    2 * (before // (384 - system_tokens)) + CASE WHEN before // (384 - system_tokens) <> (before + tokens - 1) // (384 - system_tokens) THEN 1 ELSE 0 END AS span FROM led
), starts AS (
  SELECT *, coalesce(lag(span) OVER w <> span, true) AS start,
    before - lag(before, 1) OVER w <= 128 AS near1, before - lag(before, 2) OVER w <= 128 AS near2, lag(chars, 1) OVER w AS chars1, lag(chars, 2) OVER w AS chars2
  FROM spans WINDOW w AS (PARTITION BY conv_id ORDER BY idx ROWS UNBOUNDED PRECEDING)
), counted AS (
  SELECT *, chars + CASE WHEN NOT start OR alone THEN 0 ELSE CASE WHEN near1 THEN chars1 ELSE 0 END + CASE WHEN near2 THEN chars2 ELSE 0 END
    + CASE WHEN idx > 1 AND system_tokens > 0 AND NOT (idx = 2 AND coalesce(near1, false)) AND NOT (idx = 3 AND coalesce(near2, false)) THEN first_chars ELSE 0 END END AS written
  FROM starts
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY idx)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY idx) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(written) AS BIGINT) AS formatted_chars
FROM counted GROUP BY conv_id
"""

ORACLE = {"op1_minhash_near_dedup": OP1_SQL, "op2_line_dedup": OP2_SQL, "op6_mixing": OP6_SQL, "op10_chat_format": OP10_SQL}
