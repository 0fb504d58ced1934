"""Streaming quantiles: panes with late events, merged into windows at the sink, against the batch form."""

import random

from pyspark.sql import functions as F

from passagework.operators import metrics
from passagework.session import scratch_path
from passagework.sources.tables import read_table
from passagework.streaming.events import current_windows, merge_panes, start_quantiles

SCHEMA = "ts timestamp, kind string, seconds double"
BOUNDS = (0.1, 0.5, 1.0, 2.0)


def events(spark, count, seed, minutes):
    rng = random.Random(seed)
    rows = [(rng.randint(0, minutes * 60), rng.choice(["a", "b", None]), rng.choice([None, rng.random() * 3])) for _ in range(count)]
    df = spark.createDataFrame(rows, "at int, kind string, seconds double")
    return df.select(F.timestamp_seconds(F.col("at") + 1_704_067_200).alias("ts"), "kind", "seconds")


def rounded(rows):
    return sorted((str(r.kind), r.window_start, r.samples, None if r.quantile is None else round(r.quantile, 9)) for r in rows)


def test_windows_follow_late_events(spark):
    root, inbox, state = (scratch_path(spark, n) for n in ("quantiles", "events", "checkpoint"))
    whole = events(spark, 400, 1, 40).withColumn("go", F.floor(F.rand(3) * 3)).cache()
    for go in range(3):
        whole.filter(F.col("go") == go).drop("go").write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(SCHEMA).parquet(inbox)
        start_quantiles(stream, root, state, ["kind"], "seconds", BOUNDS, late="2 hours").awaitTermination()
        so_far = metrics.sliding_quantile(whole.filter(F.col("go") <= go), ["kind"], "seconds", BOUNDS, 0.9, 300, 60)
        found = current_windows(spark, root, {"kind": "string"}, BOUNDS, 0.9)
        assert rounded(found.collect()) == rounded(so_far.collect())


def test_a_replayed_batch_replaces_its_panes(spark):
    root = scratch_path(spark, "replayed")
    names = metrics.count_names(BOUNDS)
    paned = metrics.panes(events(spark, 80, 2, 10), "ts", "60 seconds", ["kind"], *metrics.cumulative_counts("seconds", BOUNDS), F.count("seconds").alias("samples"))
    paned = paned.select("kind", "pane", *names)
    merge_panes(paned.limit(5), 0, root, ["kind"], BOUNDS)
    merge_panes(paned, 0, root, ["kind"], BOUNDS)
    merge_panes(paned.limit(0), 1, root, ["kind"], BOUNDS)
    found = current_windows(spark, root, {"kind": "string"}, BOUNDS, 0.5)
    wanted = metrics.sliding_quantile(events(spark, 80, 2, 10), ["kind"], "seconds", BOUNDS, 0.5, 300, 60)
    assert rounded(found.collect()) == rounded(wanted.collect())
    assert read_table(spark, root, "panes", "kind string, pane timestamp").count() == paned.count()
