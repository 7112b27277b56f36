"""The queries opN_<name> over the whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, minhash, mixing, oracles, preference, quality_rules, secret_scan, sentencepiece_viterbi, sharding, token_counts, url_filter
from .common import table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", "score")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_viterbi.encode_documents(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), limit=4096)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_documents(table(spark, sf_dir, "documents"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup_documents(table(spark, sf_dir, "documents"), width=3, percent=85)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8)


def op8_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.format_pairs(preference.replaced_replies(table(spark, sf_dir, "conversations")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"), classes=False)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_secret_scan": op3_secret_scan,
    "op4_token_counts": op4_token_counts,
    "op5_quality_rules": op5_quality_rules,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_sharding": op7_sharding,
    "op8_preference": op8_preference,
    "op9_mixing": op9_mixing,
    "op10_exact_dedup": op10_exact_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op5_quality_rules": oracles.OP5,
    "op6_minhash_near_dedup": oracles.OP6,
    "op7_sharding": oracles.OP7,
    "op8_preference": """
        WITH t AS (
            SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
        ), last AS (
            SELECT conv_id, turn, coalesce(text, '') AS reply FROM t WHERE role = 'assistant'
            QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, coalesce(text, '') DESC) = 1
        ), swaps AS (
            SELECT own.conv_id, own.turn, other.reply FROM last own JOIN last other ON other.conv_id = xor(own.conv_id, 1)
        ), sides AS (
            SELECT conv_id AS pair_id, true AS is_chosen, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM t
            UNION ALL
            SELECT conv_id, false, t.turn, coalesce(role, 'unknown'),
                   CASE WHEN role = 'assistant' AND t.turn IS NOT DISTINCT FROM s.turn THEN reply ELSE coalesce(text, '') END
            FROM t JOIN swaps s USING (conv_id)
        ), compared AS (
            SELECT pair_id, coalesce(turn, -1) AS place,
                   list(role || chr(1) || text ORDER BY role, text) FILTER (WHERE is_chosen) AS c,
                   list(role || chr(1) || text ORDER BY role, text) FILTER (WHERE NOT is_chosen) AS r
            FROM sides GROUP BY ALL
        ), cut AS (
            SELECT pair_id, min(place) FILTER (WHERE c IS DISTINCT FROM r) AS cut FROM compared GROUP BY pair_id
        ), placed AS (
            SELECT s.pair_id, turn, role, greatest(coalesce(turn, 0) // 1024, 0) AS part,
                   CASE WHEN cut IS NULL OR coalesce(turn, -1) < cut THEN 'prompt' WHEN is_chosen THEN 'chosen' ELSE 'rejected' END AS segment,
                   '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS rendered, is_chosen
            FROM sides s JOIN cut USING (pair_id)
        ), spans AS (
            SELECT *, sum(length(rendered)) OVER w - length(rendered) AS begins
            FROM placed WHERE segment <> 'prompt' OR is_chosen
            WINDOW w AS (PARTITION BY pair_id, part, segment ORDER BY turn NULLS FIRST, role, rendered ROWS UNBOUNDED PRECEDING)
        ), named AS (
            SELECT *, CAST(begins + length(role) + 13 AS VARCHAR) || ':' || CAST(begins + length(rendered) - 1 AS VARCHAR) AS span FROM spans
        )
        SELECT pair_id, CAST(part AS BIGINT) AS part,
               coalesce(string_agg(rendered, '' ORDER BY turn NULLS FIRST, role, rendered) FILTER (WHERE segment = 'prompt'), '') AS prompt,
               coalesce(string_agg(rendered, '' ORDER BY turn NULLS FIRST, role, rendered) FILTER (WHERE segment = 'chosen'), '') AS chosen,
               coalesce(string_agg(rendered, '' ORDER BY turn NULLS FIRST, role, rendered) FILTER (WHERE segment = 'rejected'), '') AS rejected,
               coalesce(string_agg(span, ',' ORDER BY begins) FILTER (WHERE segment = 'chosen' AND role = 'assistant'), '') AS chosen_mask,
               coalesce(string_agg(span, ',' ORDER BY begins) FILTER (WHERE segment = 'rejected' AND role = 'assistant'), '') AS rejected_mask
        FROM named GROUP BY pair_id, part
    """,
    "op10_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER w AS keep_id,
               count(*) OVER w AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
}
