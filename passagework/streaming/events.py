"""Sliding rates and quantiles over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.operators import metrics
from passagework.sources.tables import publish, read_table, write_part


def stream_rate(
    events: DataFrame, label: str, seconds: int = 300, slide: int = 60, late: str = "10 minutes", ts: str = "ts"
) -> DataFrame:
    """(label, window_start, window_end, n, per_second) in append mode.

    `late` bounds the state: windows are emitted once the watermark passes them.
    """
    window = F.window(F.col(ts), f"{seconds} seconds", f"{slide} seconds")
    counted = (
        events.withWatermark(ts, late).groupBy(window, label).agg(F.count("*").alias("n"))
    )
    return counted.select(
        label,
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "n",
        (F.col("n") / float(seconds)).alias("per_second"),
    )


def drop_repeats(rows: DataFrame, key: str, ts: str, horizon: str) -> DataFrame:
    """Rows whose `key` was not seen within `horizon`; state is bounded by the watermark."""
    return rows.withWatermark(ts, horizon).dropDuplicatesWithinWatermark([key])


def stream_panes(
    events: DataFrame, labels: list[str], value: str, bounds: tuple[float, ...], slide: int = 60, late: str = "10 minutes", ts: str = "ts"
) -> DataFrame:
    """(labels, pane, le_0 ..., samples): a mergeable vector of bucket counts per pane of `slide` seconds.

    In update mode a pane comes again when late events, up to `late` behind, have changed it; the
    state holds the panes of that time, whatever the number of events.
    """
    window = F.window(F.col(ts), f"{slide} seconds")
    counts = [*metrics.cumulative_counts(value, bounds), F.count(value).alias("samples")]
    counted = events.withWatermark(ts, late).groupBy(window, *labels).agg(*counts)
    return counted.select(*labels, F.col("window.start").alias("pane"), *metrics.count_names(bounds))


def merge_panes(changed: DataFrame, batch: int, root: str, labels: list[str], bounds: tuple[float, ...], seconds: int = 300, slide: int = 60) -> None:
    """Micro-batch writer: keep the changed panes, and write anew the sliding windows that they belong to.

    A window of an earlier batch that is touched again is replaced (`current_windows`). Only
    panes within a window's length of the changed ones are read, and a replay of the batch replaces what it wrote.
    """
    spark = changed.sparkSession
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in changed.schema)
    write_part(changed, root, "panes", batch)
    own = spark.read.schema(schema).parquet(f"{root}/panes/batch={batch}")
    first, last = own.agg(F.min("pane"), F.max("pane")).first()
    step, size = f"{slide} seconds", f"{seconds} seconds"
    windows = F.window(F.col("pane"), size, step)
    if first is not None:
        reach = F.expr(f"interval {seconds} seconds")
        near = F.col("pane").between(F.lit(first) - reach, F.lit(last) + reach)
        known = read_table(spark, root, "panes", schema, batch).filter(near)
        both = known.unionByName(own.withColumn("batch", F.lit(batch).cast("bigint")))
        names = metrics.count_names(bounds)
        latest = both.groupBy(*labels, "pane").agg(F.max_by(F.struct(*names), "batch").alias("c")).select(*labels, "pane", "c.*")
        touched = own.select(*labels, windows["start"].alias("window_start")).distinct()
        merged = metrics.slide_panes(latest, size, step, labels, *[F.sum(n).alias(n) for n in names])
        on = merged["window_start"].eqNullSafe(touched["window_start"])
        for label in labels:
            on = on & merged[label].eqNullSafe(touched[label])
        rows = merged.join(touched, on, "left_semi")
    else:
        rows = metrics.slide_panes(own, size, step, labels, *[F.sum(n).alias(n) for n in metrics.count_names(bounds)])
    write_part(rows, root, "windows", batch)
    publish(spark, root, batch)


def current_windows(spark: SparkSession, root: str, labels: dict[str, str], bounds: tuple[float, ...], q: float) -> DataFrame:
    """(labels, window_start, samples, quantile) of all windows as they were last written; `labels` come with their types."""
    names = metrics.count_names(bounds)
    typed = [f"{k} {t}" for k, t in labels.items()] + ["window_start timestamp"] + [f"{n} bigint" for n in names]
    rows = read_table(spark, root, "windows", ", ".join(typed))
    latest = rows.groupBy(*labels, "window_start").agg(F.max_by(F.struct(*names), "batch").alias("c"))
    latest = latest.select(*labels, "window_start", "c.*")
    return latest.select(*labels, "window_start", "samples", metrics.quantile_of(bounds, q).alias("quantile"))


def start_quantiles(events: DataFrame, root: str, checkpoint: str, labels: list[str], value: str, bounds: tuple[float, ...], seconds: int = 300, slide: int = 60, late: str = "10 minutes"):
    """Run `merge_panes` for every micro-batch of a stream of events."""
    return (
        stream_panes(events, labels, value, bounds, slide, late)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(lambda df, batch: merge_panes(df, batch, root, labels, bounds, seconds, slide))
        .start()
    )
