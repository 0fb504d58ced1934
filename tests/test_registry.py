import random

from pyspark.sql import functions as F

from passagework.operators import registry
from passagework.operators.sizing import fits_broadcast, rank_within, salted_join, hot_keys


def test_rank_within_blocks_equals_a_plain_count(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if rng.random() < 0.4 else f"s{rng.randint(0, 5)}") for i in rng.sample(range(10_000), 500)]
    df = spark.createDataFrame(rows, "id bigint, source string")
    got = {r.id: r.n for r in rank_within(df, "source", "id", "n", rows_per_block=40).collect()}
    assert got == {i: sum(1 for j, t in rows if t == s and j <= i) for i, s in rows}


def test_versions_with_failures(spark):
    rows = [(1, "a", False), (2, "a", True), (3, "a", False), (4, "b", False), (5, "b", True), (6, "a", False)]
    df = spark.createDataFrame(rows, "id bigint, source string, failed boolean")
    got = {r.id: (r.version, r.status, r.superseded_by) for r in registry.versions(df, "id", rows_per_task=2).collect()}
    assert got == {
        1: (1, "superseded", 3),
        2: (2, "failed", None),
        3: (3, "superseded", 6),
        4: (1, "indexed", None),
        5: (2, "failed", None),
        6: (4, "indexed", None),
    }


def test_record_defaults(spark):
    df = spark.createDataFrame([("d", "f.txt", None, "text", "h")], "doc_id string, filename string, source string, format string, content_hash string")
    row = registry.document_records(df).first()
    assert (row.source, row.version, row.status, row.extra) == ("f.txt", 1, "pending", {"filename": "f.txt"})
    assert row.created_at is not None


def test_documents_are_listed_by_creation(spark):
    rows = [("d3", "2024-03-01"), ("d1", "2024-01-05"), ("d2", "2024-01-05"), ("d0", "2024-02-01"), ("d4", "2023-12-31")]
    df = spark.createDataFrame(rows, "doc_id string, day string").select("doc_id", F.to_timestamp("day").alias("created_at"))
    assert [r.doc_id for r in registry.list_documents(df.repartition(3)).collect()] == ["d4", "d1", "d2", "d0", "d3"]


def test_latest_and_active(spark):
    df = spark.createDataFrame(
        [("d1", "s", 1, "superseded"), ("d2", "s", 2, "indexed"), ("d3", "s", 3, "superseded"), ("d4", "t", 1, "failed")],
        "doc_id string, source string, version int, status string",
    )
    assert {(r.source, r.doc_id) for r in registry.latest_version(df).collect()} == {("s", "d2"), ("t", "d4")}
    assert {r.doc_id for r in registry.active(df).collect()} == {"d2", "d4"}


def test_latest_status_and_purge(spark):
    log = spark.createDataFrame([("d", "processing", 1), ("d", "indexed", 2), ("e", "failed", 1)], "doc_id string, status string, seq bigint")
    assert {(r.doc_id, r.status) for r in registry.latest_status(log).collect()} == {("d", "indexed"), ("e", "failed")}
    chunks = spark.createDataFrame([("d", 0), ("e", 0)], "doc_id string, n int")
    gone = registry.latest_status(log).filter("status = 'failed'")
    assert [r.doc_id for r in registry.purge(chunks, gone).collect()] == ["d"]


def test_salted_join_equals_a_join(spark):
    big = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 17).alias("k"))
    small = spark.range(17).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    hot = hot_keys(big.groupBy("k").agg(F.count("*").alias("n")), "n", 20)
    got = salted_join(big, small, ["k"], hot, "id").select("id", "k", "v")
    assert sorted(got.collect()) == sorted(big.join(small, "k").select("id", "k", "v").collect())
    assert max(r.splits for r in hot.collect()) > 10


def test_size_check(spark):
    assert fits_broadcast(spark.range(10).toDF("x"), 1000)
    assert not fits_broadcast(spark.range(1000).toDF("x"), 1000)
