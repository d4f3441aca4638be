"""The queries of the training-data operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, langid, maxent, mixing, neardup, quality_model, quality_rules, secrets, toxicity, warc
from .common import table


def _documents(query: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": _documents(quality_model.query),
    "op2_language_id": _documents(langid.query),
    "op3_warc": lambda spark, sf_dir: warc.query(table(spark, sf_dir, "pages")),
    "op4_near_duplicates": _documents(neardup.query),
    "op5_secret_scan": _documents(secrets.query),
    "op6_lm_score": _documents(maxent.query),
    "op7_decontamination": lambda spark, sf_dir: decontaminate.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op8_toxicity": lambda spark, sf_dir: toxicity.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op9_quality_rules": _documents(quality_rules.query),
    "op10_source_mixing": _documents(mixing.query),
}

ORACLES: dict[str, str] = {
    "op3_warc": warc.ORACLE,
    "op10_source_mixing": mixing.ORACLE,
}
