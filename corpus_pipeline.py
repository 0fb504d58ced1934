"""The corpus pipeline: each stage calls one operator and works on all that its predecessor kept.

Stages take (spark, docs, sf_dir) and return a DataFrame, which `run` writes as
Parquet and reads again as the next stage's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passagework.llm import language_id, packing, quality_rules, simhash, suffix_dedup
from passagework.session import materialize, prepare

def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    prepare(spark)
    return quality_rules.keep_good(docs, "lang", "source")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that label the table."""
    prepare(spark)
    return language_id.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    prepare(spark)
    return simhash.keep_first(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier one holds."""
    prepare(spark)
    return suffix_dedup.remove_repeats(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every piece of a document with the sequence it is packed into."""
    prepare(spark)
    found = packing.best_fit(docs, ["doc_id"])
    return found.select("row.doc_id", "piece", "first_word", "size", "bin_id", "capacity")


STAGES = [
    ("quality rules", quality),
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", passages),
    ("best-fit packing", sequences),
]

#: Neither character models nor suffix arrays can be put as SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
