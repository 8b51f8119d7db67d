"""Cleaning a corpus: quality, near-duplicates, benchmark contamination, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns rows with the columns of
``documents``; the last returns the packed pieces. All stages read whole texts of any length, take null and empty texts, null
and repeated ids and equal rows each by its own row, carry other columns along under their names, and give an empty table
for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblio_spark.llm import decontaminate, packing, quality, secret_scan, simhash
from biblio_spark.storage import new_path, read_table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, ties at the limit included; null and empty texts are scored as empty. Without labels all
    stay."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id (null ids last, ties by the text's hash), of each group of near-duplicates. Texts
    without words are one group; equal rows leave one."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark, each judged by its own text; an empty benchmark leaves all."""
    return decontaminate.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret; n_chars follows the text and is null for a null text."""
    return secret_scan.redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences: one piece, the end id, for a null or empty text."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: The classifier, the fingerprints and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
