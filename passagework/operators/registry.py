"""Document records, versions, status history and removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.operators.sizing import ROWS_PER_TASK, rank_within

REGISTRY_SCHEMA = (
    "doc_id string, source string, format string, content_hash string, version int, "
    "status string, created_at timestamp, extra map<string,string>, signature array<bigint>, "
    "arrival bigint"
)


def document_records(docs: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Records with defaults filled in from (doc_id, filename, source, format, content_hash, ...).

    `source` defaults to the file name; `extra` always holds it; `version`
    defaults to 1 and `status` to pending.
    """
    has = set(docs.columns)
    extra = F.create_map(F.lit("filename"), F.col("filename"))
    if "extra" in has:
        none = F.create_map().cast("map<string,string>")
        extra = F.map_concat(F.map_filter(F.coalesce("extra", none), lambda k, _: k != "filename"), extra)
    stamp = created_at if created_at is not None else F.current_timestamp()
    return docs.select(
        "doc_id",
        F.coalesce("source", "filename").alias("source") if "source" in has else F.col("filename").alias("source"),
        "format",
        "content_hash",
        (F.coalesce("version", F.lit(1)) if "version" in has else F.lit(1)).cast("int").alias("version"),
        (F.coalesce("status", F.lit("pending")) if "status" in has else F.lit("pending")).alias("status"),
        (F.col("created_at") if "created_at" in has else stamp).alias("created_at"),
        extra.alias("extra"),
    )


def versions(
    docs: DataFrame, order: str, source: str = "source", rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Adds `version` (1.. per source by `order`), `superseded_by` and `status`.

    Rows whose `failed` column is true use up a version number but supersede
    nothing. One source may own most rows, so neither step gathers a source in
    one task: positions come from `rank_within` and the successor is found
    among block-wise, not source-wise, neighbours.
    """
    ranked = rank_within(docs, source, order, "version", rows_per_task)
    failed = F.coalesce(F.col("failed"), F.lit(False)) if "failed" in docs.columns else F.lit(False)
    # The next indexed version of a source is the next position among the good rows.
    if "failed" in docs.columns:
        good = docs.filter(~failed).select(source, order)
        places = rank_within(good, source, order, "place", rows_per_task)
    else:
        places = ranked.select(source, order, F.col("version").alias("place"))
    following = places.select(
        source, (F.col("place") - 1).alias("place"), F.col(order).alias("superseded_by")
    )
    linked = places.join(following, [source, "place"], "left").select(order, "superseded_by")
    status = (
        F.when(failed, "failed")
        .when(F.col("superseded_by").isNotNull(), "superseded")
        .otherwise("indexed")
    )
    return ranked.join(linked, order, "left").withColumn("status", status)


def active(registry: DataFrame) -> DataFrame:
    return registry.filter(F.col("status") != "superseded")


def latest_version(registry: DataFrame, source: str = "source") -> DataFrame:
    """The highest version per source that is not superseded; partial maxima only."""
    rest = [c for c in registry.columns if c != source]
    best = active(registry).groupBy(source).agg(F.max_by(F.struct(*rest), "version").alias("row"))
    return best.select(source, "row.*")


def latest_status(log: DataFrame) -> DataFrame:
    """(doc_id, status, seq) of the last entry per document in an append-only log."""
    return log.groupBy("doc_id").agg(
        F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq")
    )


def purge(rows: DataFrame, removed: DataFrame, on: str = "doc_id") -> DataFrame:
    """Chunks, vectors or postings without those of the removed documents."""
    return rows.join(removed.select(on), on, "left_anti")


def list_documents(registry: DataFrame) -> DataFrame:
    """By creation; documents created at the same time by id."""
    return registry.orderBy("created_at", "doc_id")
