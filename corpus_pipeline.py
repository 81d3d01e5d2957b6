"""The corpus pipeline: STAGES in order, each over all that its predecessor kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, and further columns
go through. Rows may repeat, be null in any column or be absent, and texts may have any length: a null or empty text scores like an empty
one, is its own group, is never contaminated and is mixed with size 0; rows without an id all pass the near-duplicates, rows that share
one leave a single row; ties go to the smallest id; an empty table passes every stage and is written as no shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackloom.llm import decontamination, jaccard_join, mixing, quality, token_tables
from trackloom.llm._common import materialize, table

#: Word caches of a worker that tokenizes. The stages before have let the executors grow, so less is left than in a job that only tokenizes.
CACHE_BYTES = 48 << 20


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking scores under its cut go; it learns from the labels of the documents it is given."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id."""
    return jaccard_join.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more are benchmark passages go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mix of sources reads it: up to three times, or not at all."""
    return mixing.apply_mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token ids in sorted tables, and for each its place, length and checksum read back from them."""
    return token_tables.written(docs, cache_bytes=CACHE_BYTES)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mix", source_mix),
    ("token_output", token_output),
]

#: SQL can express neither the classifier nor the tokenizer; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared folder before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else materialize(docs, name), sf_dir)
    return docs
