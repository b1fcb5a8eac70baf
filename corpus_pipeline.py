"""A training-data pipeline over the ``documents`` table.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes it as Parquet in the shared checkpoint folder and reads it again as the
next stage's ``docs``.  All stages but the last return the columns of
``documents``.

1. ``language_id``: documents without letters go, and long ones whose predicted
   language scores too low; without labels all documents with letters stay;
2. ``line_dedup``: a repeated line stays in its first document only;
3. ``near_duplicates``: of each group linked by 5-word shingles with a
   similarity of 0.8 or more, the smallest doc_id stays;
4. ``decontamination``: documents that hold a benchmark item go;
5. ``bpe``: ids of each text, with digests of ids and decoded bytes.

Null columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from connrisk.llm import bpe, decontaminate, language_id, line_dedup, ngram_join
from connrisk.llm.common import start, table
from connrisk.session import checkpoint_dir


def stage_language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs, language_id.train(docs))


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, k=5, percent=80)


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", stage_language_id),
    ("line_dedup", stage_line_dedup),
    ("near_duplicates", stage_near_duplicates),
    ("decontamination", stage_decontamination),
    ("bpe", stage_bpe),
]

#: Language identification and tokenization aren't SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    start(spark)
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/corpus-pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(start(spark), docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
