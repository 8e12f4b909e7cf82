"""Documents to training sequences: quality rules, exact and near duplicates, source mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import exact, mixing, neardup, packing, quality
from plumbline.session import stored


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, with_ids=False)


STAGES = [("quality rules", keep_good), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("source mix", mix_sources), ("packing", pack)]

#: The expectation-maximisation fit and the tokenizer are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What each stage before keeps is written and read again, so it is evaluated once.

    Null and empty texts fail the quality rules and go; columns of any name or type pass through to the packing stage,
    which gives one row per piece of a document. An empty table gives no rows.
    """
    return apply(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)


def apply(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    *before, (_, last) = STAGES
    for name, stage in before:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return last(spark, docs, sf_dir)
