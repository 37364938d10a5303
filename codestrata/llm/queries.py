"""The registered queries of this subpackage, with the same result in SQL where SQL can say it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from codestrata.llm.binary_tokens import binary_tokens
from codestrata.llm.decontaminate import find_leaks
from codestrata.llm.conversations import damaged, repair_conversations
from codestrata.llm.exact_dedup import exact_dedup
from codestrata.llm.html_extract import extract_pages
from codestrata.llm.line_dedup import line_dedup
from codestrata.llm.lm_score import lm_score
from codestrata.llm.mixing import mix_plan
from codestrata.llm.ngram_join import ngram_join
from codestrata.llm.quality import ACCEPT, held_out, learn, score
from codestrata.llm.spelling import spelling_variants
from codestrata.llm.substring_dedup import repeated_spans
from codestrata.llm.token_counts import token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
END_ID = 2


def vocabulary(name: str) -> str:
    """A public tokenizer's file: in the folder TOKENIZER_DIR names, else where its package keeps it."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query()
def op1_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


@query()
def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"))


@query(
    """WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
       g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
       SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)"""
)
def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(table(spark, folder, "documents"))


@query()
def op6_token_binary(spark: SparkSession, folder: str) -> DataFrame:
    return binary_tokens(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"), END_ID)


@query(
    """WITH RECURSIVE d AS (
         SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
                md5('mix-1 ' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS place
         FROM documents),
       s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
       w AS (SELECT source, source_size, 3 * source_size AS cap,
                    CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight FROM s),
       r AS (SELECT *, row_number() OVER t AS rank,
                    (sum(source_size) OVER () - coalesce(sum(cap) OVER (t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                      / (sum(weight) OVER () - coalesce(sum(weight) OVER (t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS fair
             FROM w WINDOW t AS (ORDER BY cap / weight, source IS NULL, source)),
       l AS (SELECT arg_min(fair, rank) AS level FROM r WHERE fair * weight <= cap),
       a AS (SELECT source, source_size, CASE WHEN fair * weight > cap THEN CAST(cap AS DOUBLE) ELSE level * weight END AS target FROM r LEFT JOIN l ON true),
       t AS (SELECT doc_id, place, d.source, size, source_size, target,
                    CAST(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS done
             FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source),
       c AS (SELECT t.*, (done + e * source_size) / target AS finish FROM t, (VALUES (0), (1), (2)) AS v(e) WHERE size > 0 AND target > 0),
       q AS (SELECT finish, sum(size) OVER (ORDER BY finish, source IS NULL, source, place, doc_id, size ROWS UNBOUNDED PRECEDING) AS total FROM c),
       x AS (SELECT coalesce(min(finish), CAST('inf' AS DOUBLE)) AS cut FROM q WHERE total > (SELECT sum(size) FROM d))
       SELECT doc_id, size, source_size, target,
              CASE WHEN size > 0 AND target > 0 THEN size * (CAST(done / target < cut AS BIGINT) + CAST((done + source_size) / target < cut AS BIGINT)
                   + CAST((done + 2 * source_size) / target < cut AS BIGINT)) ELSE 0 END AS taken
       FROM t, x"""
)
def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix_plan(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
       k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
       g AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
       d AS (SELECT k.*, first_doc IS NOT NULL AND first_doc <> doc_id AS dropped FROM k LEFT JOIN g USING (key))
       SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(dropped AS INT)) AS BIGINT) AS n_dropped,
              sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT dropped), '')) AS kept_sha256
       FROM d GROUP BY doc_id"""
)
def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = line_dedup(table(spark, folder, "documents").select("doc_id", "text"))
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return cleaned.select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


@query()
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query()
def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, folder, "labels"))
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= ACCEPT, 1).otherwise(0).alias("predicted")
    )


@query()
def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_spans(table(spark, folder, "documents"))


@query()
def op9_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = extract_pages(table(spark, folder, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query()
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(table(spark, folder, "documents"))


@query()
def op12_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm_score(table(spark, folder, "documents"))


@query()
def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair_conversations(damaged(table(spark, folder, "conversations")))
