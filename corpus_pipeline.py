"""From raw documents to a token table: five stages, each one operator on all that the stage before kept.

quality     documents that the quality classifier rejects go
near_dup    one document of each group of near-duplicates stays (five words, similarity 0.8)
decontaminate   documents with a benchmark passage go
mix         sources are drawn at temperature weights, as copies within their budget
tokens      the token table is written, read back and digested
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from segmenta.llm import decontaminate, mixing, neardup, quality, tokens
from segmenta.llm.common import stored, table
from segmenta.session import checkpoint_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(docs, threshold=0.8, words=5)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), remove="documents")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.token_digest(docs, f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}")


STAGES = [("quality", quality_stage), ("near_dup", near_dup_stage), ("decontaminate", decontaminate_stage), ("mix", mix_stage), ("tokens", token_stage)]

#: The classifier is learnt and the tokenizer is a library: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
