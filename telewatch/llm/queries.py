"""One query per operator, over its whole table and with production parameters; and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telewatch.llm import bpe, conversations, decontaminate, html, lm, neardup, negatives, pii, quality, records, rules, suffixes, warc
from telewatch.llm.common import fold_of, load, prepare

BYTE_BPE, MULTI_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            prepare(spark)
            return fn(spark, folder)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn

    return keep


@register("op1_token_records")
def op1(spark, folder):
    return records.token_records(spark, load(spark, folder, "documents"), BYTE_BPE)


@register("op2_quality_classifier")
def op2(spark, folder):
    docs = load(spark, folder, "documents")
    return quality.score(docs, quality.fit(docs, load(spark, folder, "labels"), quality.in_fold()))


@register("op3_near_duplicates")
def op3(spark, folder):
    return neardup.near_duplicates(load(spark, folder, "documents"), size=3, percent=85)


@register("op4_quality_rules", rules.sql("v2"))
def op4(spark, folder):
    return rules.verdicts(load(spark, folder, "documents"), "v2")


@register("op5_personal_data")
def op5(spark, folder):
    return pii.report(load(spark, folder, "documents"))


@register("op6_repeated_strings")
def op6(spark, folder):
    return suffixes.removal(load(spark, folder, "documents"))


@register("op7_decontamination", decontaminate.SQL)
def op7(spark, folder):
    return decontaminate.report(load(spark, folder, "documents"), load(spark, folder, "benchmark"))


@register("op8_language_model")
def op8(spark, folder):
    model, stored = lm.train(load(spark, folder, "documents"), fold_of("doc_id", 5) == 1, order=3)
    return lm.score(stored, model)


@register("op9_web_archives", """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
    d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS f FROM d)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND f <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND f <> page_id THEN f END AS refers_to, CAST(1 AS BIGINT) AS n_request, CAST(1 AS BIGINT) AS n_metadata FROM f""")
def op9(spark, folder):
    return warc.captures(load(spark, folder, "pages"))


@register("op10_byte_bpe")
def op10(spark, folder):
    return bpe.digests(load(spark, folder, "documents"), MULTI_BPE, public_tokenizers.PATTERN)


@register("op11_conversation_repair")
def op11(spark, folder):
    return conversations.repair(conversations.damage(load(spark, folder, "conversations")))


@register("op12_html_text", html.SQL)
def op12(spark, folder):
    return html.extract(load(spark, folder, "pages"))


@register("op13_hard_negatives", negatives.SQL)
def op13(spark, folder):
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(load(spark, folder, "embeddings").withColumn("label", shifted))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
