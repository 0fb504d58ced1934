"""Retrieval quality against a golden set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.defaults import FINAL_TOP_K


def first_relevant(results: DataFrame, golden: DataFrame, k: int = FINAL_TOP_K) -> DataFrame:
    """(mode, qid, first_rank): the best rank at which an expected source appears, or NULL.

    `results(mode, qid, rank, source)`, `golden(qid, source)`; a question may have
    several expected sources. Questions without any hit are kept.
    """
    hits = (
        results.filter(F.col("rank") <= k)
        .join(golden.select("qid", "source").distinct(), ["qid", "source"])
        .groupBy("mode", "qid")
        .agg(F.min("rank").alias("first_rank"))
    )
    modes = results.select("mode").distinct()
    # Modes are a handful of names; questions are repeated once per mode.
    asked = golden.select("qid").distinct().withColumn(
        "mode", F.explode(modes.agg(F.collect_set("mode").alias("m")).scalar())
    )
    return asked.join(hits, ["mode", "qid"], "left").select("mode", "qid", "first_rank")


def retrieval_eval(results: DataFrame, golden: DataFrame, k: int = FINAL_TOP_K) -> DataFrame:
    """(mode, questions, hit_at_1, hit_at_3, mrr) over all golden questions."""
    rank = F.col("first_rank")
    return (
        first_relevant(results, golden, k)
        .groupBy("mode")
        .agg(
            F.count("*").alias("questions"),
            F.avg(F.when(rank == 1, 1.0).otherwise(0.0)).alias("hit_at_1"),
            F.avg(F.when(rank <= 3, 1.0).otherwise(0.0)).alias("hit_at_3"),
            F.avg(F.coalesce(1.0 / rank, F.lit(0.0))).alias("mrr"),
        )
    )


def mean_metrics(scores: DataFrame, names: list[str]) -> DataFrame:
    """Mean of per-question metric columns; missing values do not count."""
    return scores.agg(*[F.avg(n).alias(n) for n in names])


def report_lines(metrics: DataFrame) -> DataFrame:
    """One markdown table row per mode, for a text sink."""
    cells = [F.format_number(c, 3) for c in ("hit_at_1", "hit_at_3", "mrr")]
    return metrics.select(
        F.concat(F.lit("| "), F.concat_ws(" | ", "mode", *cells), F.lit(" |")).alias("value")
    )


def write_report(metrics: DataFrame, path: str) -> None:
    """Markdown table as one text file; the rows are the modes, so one task writes it."""
    spark = metrics.sparkSession
    head = spark.createDataFrame(
        [(0, "| Mode | Hit@1 | Hit@3 | MRR@5 |"), (1, "|------|-------|-------|-------|")],
        "line int, value string",
    )
    body = report_lines(metrics).withColumn("line", F.lit(2))
    rows = head.unionByName(body.select("line", "value"))
    rows.coalesce(1).sortWithinPartitions("line", "value").select("value").write.mode("overwrite").text(path)
