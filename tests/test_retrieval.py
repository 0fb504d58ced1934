import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework.catalog import retrieval
from passagework.operators import dense, evaluation, fusion, sparse

WORDS = "alpha beta gamma delta eps zeta eta theta".split()


def corpus(count=40, seed=2):
    rng = random.Random(seed)
    return [(f"c{i:03d}", " ".join(rng.choices(WORDS, weights=range(9, 1, -1), k=rng.randint(0, 12)))) for i in range(count)]


def okapi(chunks, query):
    docs = {c: re.findall(r"\w+", t.lower()) for c, t in chunks}
    n, average = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(w for words in docs.values() for w in set(words))
    idf = {w: math.log(n - k + 0.5) - math.log(k + 0.5) for w, k in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else floor for w, v in idf.items()}
    scores = {}
    for c, words in docs.items():
        tf = Counter(words)
        scores[c] = sum(
            idf.get(w, 0) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(words) / average))
            for w in re.findall(r"\w+", query.lower())
        )
    best = sorted(((round(s, 9), c) for c, s in scores.items() if round(s, 9) > 0), key=lambda x: (-x[0], x[1]))
    return [(c, s) for s, c in best]


QUERIES = [(1, "alpha theta theta"), (2, "zeta"), (3, "unknown words"), (4, "Beta, GAMMA eta")]


@pytest.mark.parametrize(("query_bytes", "count"), [(1 << 20, 40), (1, 40), (1 << 20, 900)])
def test_bm25_equals_the_formula(spark, query_bytes, count, monkeypatch):
    monkeypatch.setattr(sparse, "RANGE_ROWS", 8)
    chunks = corpus(count)
    index = sparse.build_index(spark.createDataFrame(chunks, "chunk_id string, text string").repartition(3))
    queries = spark.createDataFrame(QUERIES, "qid bigint, text string")
    got = sparse.bm25_topk(index, queries, 7, query_bytes=query_bytes).collect()
    for qid, text in QUERIES:
        mine = sorted(((r.rank, r.chunk_id, r.score) for r in got if r.qid == qid))
        wanted = okapi(chunks, text)[:7]
        assert [(c, pytest.approx(s, abs=1e-8)) for _, c, s in mine] == wanted
    assert {r.origin for r in got} == {"sparse"}


def test_index_append_and_frequency_delta(spark):
    chunks = corpus()
    frame = lambda rows: sparse.bags(spark.createDataFrame(rows, "chunk_id string, text string"))
    old, new = frame(chunks[:25]), frame(chunks[20:])
    assert sparse.append(old, new).count() == 40
    gone = frame(chunks[20:25])
    merged = sparse.merge_frequency(*map(sparse.document_frequency, (old, new, gone)))
    whole = sparse.document_frequency(frame(chunks))
    assert {(r.term, r.df) for r in merged.collect()} == {(r.term, r.df) for r in whole.collect()}


def vectors(spark, count, dim, seed, name):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, dim)]) for i in range(count)]
    return rows, spark.createDataFrame(rows, f"{name} bigint, vector array<float>")


@pytest.mark.parametrize("query_bytes", [1 << 20, 100])
def test_dense_equals_brute_force(spark, query_bytes):
    stored, table = vectors(spark, 120, 4, 1, "chunk_id")
    asked, queries = vectors(spark, 10, 4, 2, "qid")
    asked = [(q, v) for q, v in asked if any(v)]
    queries = queries.filter(fusion.has_length(F.col("vector")))
    got = dense.dense_topk(table.repartition(5), queries, 9, query_bytes).collect()
    for qid, q in asked:
        scored = []
        for cid, v in stored:
            length = math.sqrt(sum(x * x for x in v)) * math.sqrt(sum(x * x for x in q))
            scored.append((-round(sum(a * b for a, b in zip(v, q)) / length, 9) if length else 0.0, cid))
        wanted = [(cid, -s) for s, cid in sorted(scored)[:9]]
        mine = sorted((r.rank, r.chunk_id, r.score) for r in got if r.qid == qid)
        assert [(c, pytest.approx(s, abs=1e-8)) for _, c, s in mine] == wanted


def test_dense_edges(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "chunk_id int, vector array<double>")
    zero = spark.createDataFrame([(1, [0.0, 0.0])], "qid int, vector array<double>")
    with pytest.raises(ValueError, match="zero norm"):
        dense.dense_topk(table, zero)
    assert dense.dense_topk(table, zero.limit(0)).count() == 0
    one = spark.createDataFrame([(1, [0.9, 0.1])], "qid int, vector array<double>")
    assert [(r.chunk_id, r.score > 0) for r in dense.dense_topk(table, one).orderBy("rank").collect()] == [(1, True), (2, False)]
    assert dense.dense_topk(table.limit(0), one).count() == 0


def test_upsert_and_mismatch(spark):
    schema = "chunk_id string, vector array<double>, batch int"
    old = spark.createDataFrame([("a", [1.0, 2.0], 0), ("b", [3.0, 4.0], 0)], schema)
    new = spark.createDataFrame([("b", [5.0, 6.0], 1), ("c", [7.0], 1)], schema)
    store, rejected = dense.upsert(old, new, 2)
    again, _ = dense.upsert(store.select(*old.columns), new, 2)
    for rows in (store, again):
        assert {r.chunk_id: r.vector for r in rows.collect()} == {"a": [1.0, 2.0], "b": [5.0, 6.0]}
    assert [r.chunk_id for r in rejected.collect()] == ["c"]
    chunks = spark.createDataFrame([("a",), ("x",)], "chunk_id string")
    assert {(r.chunk_id, r.missing) for r in dense.unmatched(chunks, old).collect()} == {("x", "vector"), ("b", "chunk")}


def ranked(spark, rows):
    return spark.createDataFrame(rows, "qid int, chunk_id string, rank int")


def test_fusion_prefers_shared_chunks_then_first_seen(spark):
    a = ranked(spark, [(1, "a", 1), (1, "b", 2)])
    b = ranked(spark, [(1, "c", 1), (1, "b", 2)])
    rows = fusion.rrf_fuse(a, b).orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == ["b", "a", "c"]
    assert rows[0].score == pytest.approx(2 / 62) and rows[1].score == pytest.approx(1 / 61)
    assert fusion.rrf_fuse(a.limit(0), b.limit(0)).count() == 0


def test_hybrid_finds_each_topic_and_rerank_reorders(spark):
    chunks = spark.createDataFrame(
        [("v", "vacation days policy"), ("p", "password reset policy"), ("e", "expense report for travel"), ("o", "other words here")],
        "chunk_id string, text string",
    )
    queries = spark.createDataFrame([(1, "vacation days"), (2, "password reset"), (3, "travel expense"), (4, ""), (5, "!!")], "qid int, text string")
    index = fusion.build_hybrid_index(chunks)
    rows = fusion.hybrid_topk(index, queries, 2).collect()
    first = {r.qid: r.chunk_id for r in rows if r.rank == 1}
    assert first == {1: "v", 2: "p", 3: "e"}
    assert max(r.rank for r in rows) == 2
    # Retrieval answers whatever it is asked; only the guard refuses long queries.
    long = spark.createDataFrame([(9, "password " * 1_000)], "qid int, text string")
    assert fusion.hybrid_topk(index, long, 1).first().chunk_id == "p"
    wide = fusion.hybrid_candidates(index, queries)
    best = fusion.rerank(wide, queries, chunks, k=1, scorer=lambda q, t: F.length(t).cast("double"))
    # All four chunks are candidates of every query, so the longest text wins throughout.
    assert {r.chunk_id for r in best.collect()} == {"e"}
    assert {r.origin for r in best.collect()} == {"reranked"}


def test_evaluation_counts_misses(spark, tmp_path):
    results = spark.createDataFrame(
        [("m", 1, 1, "s1"), ("m", 1, 2, "s2"), ("m", 2, 4, "s1"), ("m", 3, 1, "s9"), ("n", 1, 6, "s1")],
        "mode string, qid int, rank int, source string",
    )
    golden = spark.createDataFrame([(1, "s1"), (2, "s1"), (3, "s3"), (4, "s4")], "qid int, source string")
    got = {r["mode"]: r for r in evaluation.retrieval_eval(results, golden).collect()}
    assert (got["m"].questions, got["m"].hit_at_1, got["m"].hit_at_3, got["m"].mrr) == (4, 0.25, 0.25, 0.3125)
    assert (got["n"].hit_at_1, got["n"].mrr) == (0.0, 0.0)
    evaluation.write_report(evaluation.retrieval_eval(results, golden), str(tmp_path / "report"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert lines[0].startswith("| Mode") and "| m | 0.250 | 0.250 | 0.312 |" in lines


def test_mean_metrics_skip_missing_values(spark):
    scores = spark.createDataFrame([(0.5, 1.0), (None, 0.0)], "faithfulness double, relevancy double")
    row = evaluation.mean_metrics(scores, ["faithfulness", "relevancy"]).first()
    assert (row.faithfulness, row.relevancy) == (0.5, 0.5)


def test_evaluation_splits_the_documents_once(spark):
    """The golden set is asked for twice and must not be derived again each time."""
    found = retrieval.retrieval_eval(spark, "/root/testdata/sf0.001")
    assert not [f for f in found.inputFiles() if "documents.parquet" in f]
