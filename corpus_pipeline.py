"""The corpus pipeline: quality rules, near-dedup, decontamination, PII and mixing, each over what the last one kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandline.llm import decontam, mixing, pii, quality, simhash
from strandline.session import shared_folder

ORACLE_SQL: str | None = None


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail the line rules go from every text, and documents that the rules reject go whole.

    A null or empty text is rejected; repeated rows stay repeated; a null id stays null; an empty table stays empty; other
    columns stay, whatever their names.
    """
    # The row travels in a struct, so that no column of its own can clash with a measure.
    kept = quality.quality_columns(docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))).where("kept")
    clean_text = F.col("clean_text")
    return kept.select(*[
        clean_text.alias(c) if c == "text" else F.length(clean_text).cast("long").alias(c) if c == "n_chars" else F.col("row").getField(c).alias(c)
        for c in docs.columns
    ])


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: that with the smallest doc_id (nulls last), then the smallest text hash.

    Five-word shingles, similarity 0.8.  Texts without a word are one class; a repeated row stays once; an empty table
    stays empty; other columns stay, whatever their names.
    """
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words a twentieth or more stand in benchmark windows go.

    Null and empty texts stay; repeated rows stay or go together; an empty table or benchmark takes nothing; other columns
    stay, whatever their names.
    """
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the text gives way to its kind in brackets; ``n_chars`` follows.

    Null and empty texts, repeated rows, null ids and empty tables stay as they are; so do other columns, whatever their names.
    """
    masked = pii.mask_pii(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, and how often.

    Null and empty texts have no words and are not taken; a null source is a source; repeated rows stay once, with the
    copies of all; an empty table stays empty; of other columns only those named as the results give way.
    """
    return mixing.mix_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", clean), ("simhash", dedup), ("decontamination", decontaminate), ("pii", mask), ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents; each is written to the shared folder before the next begins."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
