"""Registered queries over the given tables, each with the SQL it must agree with."""

from pyspark.sql import DataFrame, SparkSession

from passagework.session import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table whose rows are costly to process, spread over the cores if it is small."""
    return spread(table(spark, folder, name))


def MODULES():
    from passagework.catalog import answers, cleaning, guards, lifecycle, monitoring, retrieval, streams

    return (cleaning, retrieval, lifecycle, guards, monitoring, answers, streams)
