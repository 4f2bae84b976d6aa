"""The queries of this folder's operators, each over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontamination, divergence, fingerprints, langid, near_dedup, packing, pii, repair, substring_dedup, suffix_dedup, toxicity, warc
from .shared import documents

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path(), 4096)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(documents(spark, sf_dir), 20).drop("kept_text")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal(documents(spark, sf_dir))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(documents(spark, sf_dir))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_bytes(documents(spark, sf_dir), 200).drop("kept")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), 85)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1,
    "op2_substring_dedup": op2,
    "op3_personal_data": op3,
    "op4_fingerprints": op4,
    "op5_language_id": op5,
    "op6_decontamination": op6,
    "op7_warc": op7,
    "op8_chat_format": op8,
    "op9_suffix_dedup": op9,
    "op10_near_dedup": op10,
    "op11_source_divergence": op11,
    "op12_toxicity": op12,
    "op13_conversation_repair": op13,
}

ORACLE_SQL: dict[str, str] = {
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
r AS (SELECT h, max(page_id) AS last FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT page_id, strlen(p.h) AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last <> page_id THEN last END AS refers_to
FROM p LEFT JOIN r ON p.h = r.h
""",
    "op8_chat_format": chat.SQL,
    "op11_source_divergence": divergence.SQL,
    "op13_conversation_repair": repair.SQL,
}
