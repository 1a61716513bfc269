"""The corpus pipeline: documents in, packed training windows out, one Parquet hand-over between stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from civilake.llm import exact_dedup, langid, mixing, packing, queries, simhash
from civilake.llm.staging import fresh_path, remove, scratch, staged

#: A worker's cache of encoded chunks in the last stage: small, since the workers of all stages share an executor's memory.
CACHE_BYTES = 16 << 20


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents whose language cannot be told (null or letterless text) go. Repeated rows and all columns stay; an empty table stays empty."""
    return langid.accepted(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of equal texts, the document with the largest doc_id stays; of rows repeated with that id, one. Null and empty texts are equal."""
    return exact_dedup.without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of each near-duplicate group, the document with the smallest doc_id stays; rows with a null id stay, and repeated rows of the id that stays."""
    return simhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents at the rates that bring the languages' tokens to their target weights, none repeated. Without a labelled row all stay."""
    return mixing.mixed(docs, docs.where("lang IS NOT NULL"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: every kept document, whatever its id or text, in windows of 2048 ids; a null or empty text is its end id alone."""
    return packing.op6(docs, queries.tokenizer_path(), CACHE_BYTES)


STAGES = [("language_id", language), ("exact_dedup", exact), ("simhash", near), ("mixing", mix), ("packing", packed)]

#: SQL has no classifier, tokenizer or SimHash, so the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again as the next stage's input.

    What a stage staged on its way, and the input it has done with, are removed
    once its result is written. Columns beyond those of ``documents`` pass through
    all stages but the last, whatever their names.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        with scratch(spark):
            docs = staged(stage(spark, docs, sf_dir), name, path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
