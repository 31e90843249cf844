"""Queries of the text operators: callables for the driver and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import encode, pack, quality
from gridloom.session import table


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encoded(table(spark, sf_dir, "documents"))


def p7_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.reuse_report(table(spark, sf_dir, "documents"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.containers(table(spark, sf_dir, "documents"))


def p8_fill_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The method with complete differencing of overfull containers, and without it."""
    documents = table(spark, sf_dir, "documents")
    return pack.fill_report({"mended": pack.containers(documents), "differencing alone": pack.containers(documents, mend=False)})


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.not_speech(table(spark, sf_dir, "documents"))


def p9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def p9_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality.quality(table(spark, sf_dir, "documents"))
    return q.select("doc_id", F.col("n_chars").alias("n_characters"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p7_ids, p7_reuse, p8_containers, p8_fill_report, p9_found, p9_quality, p9_characters)}


def oracle_sql() -> dict[str, str]:
    return {
        "p9_characters": "SELECT doc_id, CAST(coalesce(length(replace(replace(text, chr(13), ''), chr(10), '')), 0) AS BIGINT) AS n_characters FROM documents",
    }
