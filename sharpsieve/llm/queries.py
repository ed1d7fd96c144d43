"""The queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sharpsieve.llm import ann, chat_format, decontam, langid, licenses, line_dedup, maxent, mixing, quality, simhash
from sharpsieve.llm.common import fold, table

TEXT_OF_CHECK = "\\### Assistant: </turn> ok"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


OP1_SQL = r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, x, unnest(range(1, len(x) - 1)) AS i FROM l WHERE len(x) >= 3),
w AS (SELECT doc_id, i, x[i] || chr(10) || x[i + 1] || chr(10) || x[i + 2] AS k FROM p WHERE NOT regexp_full_match(x[i] || x[i + 1] || x[i + 2], '[\s\v]*')),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM w),
c AS (SELECT DISTINCT doc_id, i + j AS i FROM r, (SELECT unnest([0, 1, 2]) AS j) WHERE n > 1),
a AS (SELECT doc_id, len(x) AS n_lines, unnest(x) AS line, unnest(range(1, len(x) + 1)) AS i FROM l),
k AS (SELECT a.doc_id, string_agg(line, chr(10) ORDER BY a.i) FILTER (WHERE c.i IS NULL) AS text, count(c.i) AS n_removed, any_value(n_lines) AS n_lines
      FROM a LEFT JOIN c ON c.doc_id = a.doc_id AND c.i = a.i GROUP BY a.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id
"""


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), learn=fold(F.col("doc_id"), 5) != 0)
    scored = quality.score(docs, model)
    return scored.select(F.col("id").alias("doc_id"), (fold(F.col("id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = maxent.score(table(spark, sf_dir, "documents"), learn=fold(F.col("doc_id"), 5) != 1)
    return found.select(F.col("id").alias("doc_id"), (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, learn=fold(F.col("doc_id"), 4) != 2)
    found = langid.predict(docs, model)
    return found.select(F.col("id").alias("doc_id"), (fold(F.col("id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", TEXT_OF_CHECK), (-7, 1, "assistant", TEXT_OF_CHECK)], "conv_id long, turn long, role string, text string")
    return chat_format.digest(chat_format.format_windows(talks.unionByName(more)))


OP9_SQL = r"""
WITH RECURSIVE s AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
  length(replace(replace(replace(replace(replace(role, '%', '%25'), ':', '%3A'), '<', '%3C'), '#', '%23'), chr(10), '%0A')) + 6 + length(text) + 9
  + (length(text) - length(replace(text, '\', '')))
  + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0)
  + (length(text) - length(replace(text, '</turn>', ''))) // 7 AS chars FROM s),
t AS (SELECT *, ceil(chars / 4)::BIGINT AS tokens FROM c),
p AS (SELECT conv_id, n, role, text, chars::BIGINT AS chars, tokens,
  lag(tokens, 1) OVER w AS b1, lag(tokens, 2) OVER w AS b2, lag(chars, 1) OVER w AS c1, lag(chars, 2) OVER w AS c2,
  first_value(CASE WHEN role = 'system' THEN tokens ELSE 0 END) OVER w AS sys, first_value(CASE WHEN role = 'system' THEN chars ELSE 0 END) OVER w AS sys_chars,
  first_value(CASE WHEN role = 'system' THEN 1 ELSE 0 END) OVER w AS has_sys FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY n)),
h AS (SELECT *, CASE WHEN n - 3 >= has_sys AND b1 + b2 + tokens <= 512 - sys THEN 2 WHEN n - 2 >= has_sys AND b1 + tokens <= 512 - sys THEN 1 ELSE 0 END AS k FROM p),
r AS (
  SELECT conv_id, n, tokens::BIGINT AS used, 512::BIGINT AS room, chars::BIGINT AS total FROM h WHERE n = 1
  UNION ALL
  SELECT h.conv_id, h.n,
    (CASE WHEN r.used + h.tokens <= r.room THEN r.used ELSE CASE h.k WHEN 2 THEN b1 + b2 WHEN 1 THEN b1 ELSE 0 END END + h.tokens)::BIGINT,
    (CASE WHEN r.used + h.tokens <= r.room THEN r.room ELSE 512 - sys END)::BIGINT,
    (r.total + h.chars + CASE WHEN r.used + h.tokens <= r.room THEN 0 ELSE sys_chars + CASE h.k WHEN 2 THEN c1 + c2 WHEN 1 THEN c1 ELSE 0 END END)::BIGINT
  FROM r JOIN h ON h.conv_id = r.conv_id AND h.n = r.n + 1),
f AS (SELECT conv_id, max(total) AS formatted_chars FROM r GROUP BY conv_id)
SELECT t.conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, any_value(f.formatted_chars)::BIGINT AS formatted_chars
FROM t JOIN f ON f.conv_id = t.conv_id GROUP BY t.conv_id
"""


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "mix_source", "mix_lang", "mix_topic", "n_tokens", F.round("weight", 9).alias("weight"), F.round("prob", 9).alias("prob"), "selected")


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_quality, op3_lm_score, op4_license, op5_nearest, op6_decontamination, op7_simhash, op8_language, op9_chat_format, op10_mixing)}
SQL = {"op1_line_dedup": OP1_SQL, "op9_chat_format": OP9_SQL, "op10_mixing": mixing.oracle()}
