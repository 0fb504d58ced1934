"""Approximate dense search: recall against the exact lists, exact scores, and what it reads."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework.operators import cells, dense


def clustered(count, dim=16, groups=12, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (groups, dim))
    return [(f"v{i:04d}", (centres[i % groups] + rng.normal(0, 0.25, dim)).tolist()) for i in range(count)]


def test_pieces_and_probes():
    rng = np.random.default_rng(1)
    vectors = dense.unit_rows(rng.normal(0, 1, (500, 20)))
    centroids = cells.fit_centroids(vectors, 9, 1)
    assert (cells.nearest(vectors, centroids) == ((vectors[:, None] - centroids) ** 2).sum(axis=2).argmin(axis=1)).all()
    left = vectors - centroids[cells.nearest(vectors, centroids)]
    pieces = cells.fit_pieces(left, 1)
    codes = cells.encode(left, pieces)
    near = np.concatenate([p[codes[:, i]] for i, p in enumerate(pieces)], axis=1)[:, :20]
    assert codes.shape == (500, cells.PARTS) and ((left - near) ** 2).sum() < 0.5 * (left**2).sum()
    few, many = (cells.enough_probes(vectors, centroids, 10, r) for r in (0.3, 1.0))
    assert 1 <= few < many <= 9


def test_recall_and_exact_scores(spark):
    rows = clustered(1500) + [("zero", [0.0] * 16), ("v0003", [1.0] * 16)]
    vectors = spark.createDataFrame(rows, "chunk_id string, vector array<double>").repartition(4)
    queries = spark.createDataFrame([(i, rows[i * 11][1]) for i in range(60)], "qid int, vector array<double>")
    index = cells.build(vectors, k=10)
    found = cells.search(index, queries, 10, query_bytes=3_000).collect()
    exact = {(r.qid, r.chunk_id): r.score for r in dense.dense_topk(vectors, queries, 10).collect()}
    hits = [r for r in found if (r.qid, r.chunk_id) in exact]
    assert len(hits) / len(exact) >= 0.9
    assert all(r.score == pytest.approx(exact[r.qid, r.chunk_id], abs=1e-8) for r in hits)
    shares = [r.share for r in cells.share_read(index, queries).collect()]
    assert len(shares) == 60 and max(shares) < 0.5
    assert index.rows.count() == 1502


def test_a_search_opens_the_cells_of_its_queries(spark):
    vectors = spark.createDataFrame(clustered(600), "chunk_id string, vector array<double>")
    index = cells.build(vectors, k=5, recall=0.5)
    query = vectors.limit(1).select(F.lit(1).alias("qid"), "vector")
    plan = cells.search(index, query, 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_empty_store_and_queries(spark):
    none = spark.createDataFrame([], "chunk_id string, vector array<double>")
    some = spark.createDataFrame([("a", [1.0, 0.0])], "chunk_id string, vector array<double>")
    queries = some.select(F.lit(1).alias("qid"), "vector")
    assert cells.search(cells.build(some), queries.limit(0)).collect() == []
    assert [r.chunk_id for r in cells.search(cells.build(some), queries).collect()] == ["a"]
    assert cells.search(cells.build(none), queries.limit(0)).collect() == []
    with pytest.raises(ValueError, match="zero norm"):
        cells.search(cells.build(some), queries.withColumn("vector", F.array(F.lit(0.0), F.lit(0.0))))


def test_blocks_of_many_queries(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(0, 1, (2000, 16)))]
    vectors = spark.createDataFrame(rows, "chunk_id bigint, vector array<double>").repartition(6)
    queries = vectors.withColumnRenamed("chunk_id", "qid")
    index = cells.build(vectors, k=10)
    found = cells.search(index, queries, 10, query_bytes=200 * (16 * 8 + 120 * cells.RESULT_BYTES)).collect()
    assert len(found) == 20_000
    exact = {(r.qid, r.chunk_id): r.score for r in dense.dense_topk(vectors, queries, 10).collect()}
    hits = [r for r in found if (r.qid, r.chunk_id) in exact]
    assert len(hits) / len(exact) >= 0.9 and all(r.score == pytest.approx(exact[r.qid, r.chunk_id], abs=1e-8) for r in hits)


def test_results_of_many_queries_take_the_stated_bytes():
    """Before, a task held 16 x 256 products of each query, and lists of objects for what it found."""
    count, k = 4000, 120
    rng = np.random.default_rng(4)
    tracemalloc.start()
    best = cells.BestRows(count, k)
    for start in range(0, 3000, 300):
        for rows in np.array_split(np.arange(count), 10):
            best.add(np.arange(start, start + 300), rng.normal(0, 1, (len(rows), 300)), rows)
    emitted = sum(b.num_rows for b in best.emit(cells.pa.array(range(count)), cells.pa.int64()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert emitted == count * k and peak < 1.25 * count * k * cells.RESULT_BYTES


def test_best_rows_equal_a_sort():
    rng = np.random.default_rng(2)
    scores, ids = np.round(rng.normal(0, 1, (7, 900)), 2), rng.permutation(900)
    best = cells.BestRows(7, 11, 3)
    for start in range(0, 900, 90):
        for rows in (np.arange(3), np.arange(3, 7)):
            best.add(ids[start : start + 90], scores[rows, start : start + 90], rows)
    got = [tuple(r.values()) for b in best.emit(cells.pa.array(range(7)), cells.pa.int64()) for r in b.to_pylist()]
    want = [(q, int(ids[i]), scores[q, i]) for q in range(7) for i in np.lexsort((ids, -scores[q]))[:11]]
    assert got == want
