"""A training-data pipeline over ``documents``: five operators of brookline.llm, one after another.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps with their columns; its result is
written as Parquet and read again before the next. Rejected, duplicate and contaminated documents go,
secrets are masked in the text, and the last stage repeats or leaves out documents so that sources meet their
target weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brookline.llm import decontaminate, mixing, neardup, quality_model, secrets
from brookline.llm.common import drop_written, settled, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_model.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


STAGES = [
    ("quality_classifier", quality),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
]

#: SQL can't express the fitted classifier; the stages are tested against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, made = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = settled(spark, f"pipeline-{name}", lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        if made is not None:
            drop_written(made)
        made = docs
    return STAGES[-1][1](spark, docs, sf_dir)
