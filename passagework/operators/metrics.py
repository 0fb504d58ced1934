"""Counters, cumulative histograms, sliding rates and quantiles over event tables.

Sliding windows are computed from panes: events are first counted per pane of
the slide length (combined map-side), and only the pane totals are repeated for
the windows they belong to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.functions.text import let

# Upper bounds of the histograms, in seconds for latencies.
LATENCY_BOUNDS = (
    0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0,
)
CHUNK_BOUNDS = (0.0, 1.0, 2.0, 5.0, 8.0, 13.0, 21.0)
ROUND_BOUNDS = (0.0, 1.0, 2.0, 3.0, 5.0)


def counter(events: DataFrame, labels: list[str]) -> DataFrame:
    return events.groupBy(*labels).agg(F.count("*").alias("total"))


def cumulative_counts(value: str, bounds: tuple[float, ...]) -> list[Column]:
    """Counts of values up to each bound; NULL counts nowhere."""
    return [F.count_if(F.col(value) <= b).alias(f"le_{i}") for i, b in enumerate(bounds)]


def _bucket_array(bounds: tuple[float, ...]) -> Column:
    steps = [
        F.struct(F.lit(b).alias("le"), F.col(f"le_{i}").alias("cumulative")) for i, b in enumerate(bounds)
    ]
    last = F.struct(F.lit(float("inf")).alias("le"), F.col("samples").alias("cumulative"))
    return F.array(*steps, last)


def histogram(events: DataFrame, labels: list[str], value: str, bounds: tuple[float, ...]) -> DataFrame:
    """(labels, le, cumulative, samples, total): one row per bound, the last one infinite.

    All bounds are counted in one aggregate; events are not repeated per bound.
    """
    counted = events.groupBy(*labels).agg(
        *cumulative_counts(value, bounds), F.count(value).alias("samples"), F.sum(value).alias("total")
    )
    return counted.select(
        *labels, F.explode(_bucket_array(bounds)).alias("bucket"), "samples", "total"
    ).select(*labels, "bucket.le", "bucket.cumulative", "samples", "total")


def count_names(bounds: tuple[float, ...]) -> list[str]:
    """Columns of a vector of bucket counts."""
    return [f"le_{i}" for i in range(len(bounds))] + ["samples"]


def quantile_of(bounds: tuple[float, ...], q: float) -> Column:
    """Quantile of the bucket counts in the columns `count_names`."""
    return bucket_quantile(_bucket_array(bounds), q)


def bucket_quantile(buckets: Column, q: float) -> Column:
    """Quantile of ARRAY<STRUCT<le, cumulative>>, linear within the bucket it falls in.

    The lower edge of the first bucket is 0; beyond the last finite bound the
    answer is that bound; an empty histogram has none.
    """

    def within(b: Column) -> Column:
        last = F.size(b) - 1
        target = F.get(b, last)["cumulative"] * q
        return let(
            F.struct(target.alias("target"), F.size(F.filter(b, lambda x: x["cumulative"] < target)).alias("at")),
            lambda hit: interpolate(b, last, hit["target"], hit["at"]),
        )

    def interpolate(b: Column, last: Column, target: Column, at: Column) -> Column:
        upper, lower = F.get(b, at), F.get(b, at - 1)
        low = F.when(at == 0, F.lit(0.0)).otherwise(lower["le"])
        below = F.when(at == 0, F.lit(0)).otherwise(lower["cumulative"])
        linear = low + (upper["le"] - low) * (target - below) / (upper["cumulative"] - below)
        return (
            F.when(F.get(b, last)["cumulative"] == 0, F.lit(None).cast("double"))
            .when(at >= last, F.get(b, last - 1)["le"])
            .when((at == 0) & (upper["le"] <= 0), upper["le"])
            .otherwise(linear)
        )

    return let(buckets, within)


def panes(events: DataFrame, ts: str, slide: str, labels: list[str], *aggs: Column) -> DataFrame:
    """Aggregates per (labels, pane) with `pane` the start of the slide-long interval."""
    pane = F.window(F.col(ts), slide)["start"].alias("pane")
    return events.groupBy(*labels, pane).agg(*aggs)


def slide_panes(paned: DataFrame, size: str, slide: str, labels: list[str], *aggs: Column) -> DataFrame:
    """Combine pane totals into sliding windows (labels, window_start, window_end, ...)."""
    window = F.window(F.col("pane"), size, slide)
    rows = paned.groupBy(*labels, window).agg(*aggs)
    columns = [c for c in rows.columns if c not in {*labels, "window"}]
    return rows.select(
        *labels,
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        *columns,
    )


def sliding_rate(
    events: DataFrame, labels: list[str], seconds: int = 300, slide: int = 60, ts: str = "ts"
) -> DataFrame:
    """(labels, window_start, window_end, n, per_second)."""
    step, size = f"{slide} seconds", f"{seconds} seconds"
    paned = panes(events, ts, step, labels, F.count("*").alias("n"))
    rows = slide_panes(paned, size, step, labels, F.sum("n").alias("n"))
    return rows.withColumn("per_second", F.col("n") / float(seconds))


def sliding_quantile(
    events: DataFrame,
    labels: list[str],
    value: str,
    bounds: tuple[float, ...],
    q: float,
    seconds: int,
    slide: int,
    ts: str = "ts",
) -> DataFrame:
    """(labels, window_start, window_end, samples, quantile) from bucket counts."""
    step, size = f"{slide} seconds", f"{seconds} seconds"
    names = count_names(bounds)
    paned = panes(
        events, ts, step, labels, *cumulative_counts(value, bounds), F.count(value).alias("samples")
    )
    rows = slide_panes(paned, size, step, labels, *[F.sum(n).alias(n) for n in names])
    return rows.select(
        *labels,
        "window_start",
        "window_end",
        "samples",
        quantile_of(bounds, q).alias("quantile"),
    )


def sliding_mean(
    events: DataFrame, labels: list[str], value: str, seconds: int, slide: int, ts: str = "ts"
) -> DataFrame:
    """(labels, window_start, window_end, samples, mean): sum over count per window."""
    step, size = f"{slide} seconds", f"{seconds} seconds"
    paned = panes(events, ts, step, labels, F.sum(value).alias("s"), F.count(value).alias("samples"))
    rows = slide_panes(
        paned, size, step, labels, F.sum("s").alias("s"), F.sum("samples").alias("samples")
    )
    return rows.withColumn("mean", F.col("s") / F.col("samples")).drop("s")


def tumbling_count(events: DataFrame, labels: list[str], size: str, ts: str = "ts") -> DataFrame:
    """(labels, window_start, n)."""
    return panes(events, ts, size, labels, F.count("*").alias("n")).withColumnRenamed("pane", "window_start")
