"""A corpus pipeline of five stages; each works on what the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from phraseforge.llm import decontamination, langid, near_dedup, packing, pii
from phraseforge.llm.queries import tokenizer_path
from phraseforge.llm.shared import documents, materialise


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without text or letters go."""
    model = langid.train(docs.where(~langid.held_out()))
    return langid.predict(docs, model).where(f"lang_pred <> '{langid.UNKNOWN}'").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, 80)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask_personal(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path(), 4096)


STAGES = [
    ("language", known_language),
    ("near", one_of_each),
    ("benchmark", no_benchmark),
    ("personal", no_personal_data),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what each keeps is written before the next reads it."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
