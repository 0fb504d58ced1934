import json

import pytest
from pyspark.sql import functions as F

from passagework.functions.structured import parse_critique, parse_route
from passagework.operators import answering, fusion, inference, metrics


def test_structured_output(spark):
    raw = [
        '```json\n{"category": "summary", "reasoning": "x"}\n```',
        'text {"category": "analytical"} more',
        "no json",
        '{"category": "weather"}',
        "{bad}",
        '{"reasoning": "only"}',
        "",
    ]
    df = spark.createDataFrame(list(enumerate(raw)), "id int, t string").orderBy("id")
    rows = [r[0] for r in df.select(parse_route(F.col("t"))).collect()]
    assert [(r.category, r.fallback) for r in rows] == [
        ("summary", False), ("analytical", False), ("factual", True), ("factual", True),
        ("factual", True), ("factual", True), ("factual", True),
    ]
    verdict = spark.createDataFrame([('{"verdict": "revise", "issues": ["a"]}',), ("x",)], "t string")
    rows = [r[0] for r in verdict.select(parse_critique(F.col("t"))).collect()]
    assert [(r.verdict, r.grounded, r.issues, r.fallback) for r in rows] == [
        ("revise", True, ["a"], False), ("approve", True, [], True),
    ]


def test_retry_only_for_transient_errors():
    calls, waits = [], []

    def flaky(_):
        calls.append(1)
        if len(calls) < 2:
            raise inference.TransientError("busy")
        return "ok"

    assert inference.call_with_retry(flaky, None, waits.append) == ("ok", None)
    assert len(calls) == 2 and waits == [0.5]

    def always(_):
        calls.append(1)
        raise inference.TransientError("busy")

    calls.clear()
    waits.clear()
    assert inference.call_with_retry(always, None, waits.append) == (None, "busy")
    assert len(calls) == 3 and waits == [0.5, 1.0]

    def broken(_):
        calls.append(1)
        raise ValueError("bad")

    calls.clear()
    assert inference.call_with_retry(broken, None, waits.append) == (None, "bad")
    assert len(calls) == 1


def picky_model():
    def embed(texts):
        if any("bad" in t for t in texts):
            raise ValueError("bad text")
        return [[float(len(t)), 1.0] for t in texts]

    return embed


def test_embed_marks_only_failing_rows(spark):
    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "fine one")], "id int, text string").coalesce(1)
    rows = {r.id: (r.vector, r.error) for r in inference.embed(df, factory=picky_model).collect()}
    assert rows == {1: ([4.0, 1.0], None), 2: (None, "bad text"), 3: ([8.0, 1.0], None)}


def test_cache_hits_misses_and_ttl(spark):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    none = spark.createDataFrame([], "key string, vector array<double>, stored_at timestamp")
    df = spark.createDataFrame([(1, "good"), (2, "fine"), (3, "good")], "id int, text string")
    first, fresh = inference.cached_embed(df, none, "m", now, factory=picky_model, row_id="id")
    assert {(r.id, r.hit, r.vector[0]) for r in first.collect()} == {(1, False, 4.0), (2, False, 4.0), (3, False, 4.0)}
    assert fresh.count() == 2 and all(r.key.startswith("emb:") for r in fresh.collect())
    marked = fresh.withColumn("vector", F.array(F.lit(9.0)))
    part = spark.createDataFrame([(1, "good"), (4, "newer")], "id int, text string")
    second, _ = inference.cached_embed(part, marked, "m", now, factory=picky_model)
    assert {(r.id, r.hit, r.vector[0]) for r in second.collect()} == {(1, True, 9.0), (4, False, 5.0)}
    late = F.lit("2024-01-04 00:00:00").cast("timestamp")
    third, _ = inference.cached_embed(part, marked, "m", late, factory=picky_model)
    assert not any(r.hit for r in third.collect())


def counting_model(folder):
    def load():
        import os
        import uuid

        open(f"{folder}/load-{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def embed(texts):
            for _ in texts:
                open(f"{folder}/call-{uuid.uuid4().hex}", "w").close()
            return [[1.0] for _ in texts]

        return embed

    return load


def test_a_model_sees_each_miss_once_and_loads_once_per_worker(spark, tmp_path):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    none = spark.createDataFrame([], "key string, vector array<double>, stored_at timestamp")
    df = spark.createDataFrame([(i, f"text {i % 8}") for i in range(40)], "id int, text string").repartition(6)
    found, fresh = inference.cached_embed(df, none, "m", now, factory=counting_model(str(tmp_path)), row_id="id")
    assert found.count() == 40 and fresh.count() == 8
    names = [p.name for p in tmp_path.iterdir()]
    assert sum(n.startswith("call-") for n in names) == 8
    workers = [n.split("-")[1] for n in names if n.startswith("load-")]
    assert len(workers) == len(set(workers))


def test_names_are_checked_early():
    assert inference.embedder("hashing") is None and fusion.named(fusion.SCORERS, "overlap") is fusion.overlap_score
    for look in (inference.embedder, lambda n: fusion.named(fusion.SEARCHES, n)):
        with pytest.raises(ValueError, match="unknown"):
            look("other")


CHUNKS = [(f"d{i}:0", f"d{i}", 0, "vacation policy text " + "x" * 300 + str(i), {"source": f"s{i}"}) for i in range(3)]


def router():
    return lambda talk: "garbage" if "garble" in talk[-1]["content"] else json.dumps(
        {"category": "out_of_scope" if "joke" in talk[-1]["content"] else "factual"}
    )


def writer():
    def write(talk):
        if "fail" in talk[-1]["content"]:
            raise ValueError("no answer")
        if "hollow" in talk[-1]["content"]:
            return ""
        rounds = talk[0]["content"].count("Reviewers objected")
        return "second [1] [1] [9] [2]" if rounds else "first [1]"

    return write


def critic():
    def judge(talk):
        body = talk[-1]["content"]
        revise = "stubborn" in body or ("fix" in body and "first" in body)
        if "silent" in body:
            raise ValueError("critic down")
        return json.dumps({"verdict": "revise" if revise else "approve", "grounded": not revise, "issues": ["vague"]})

    return judge


def test_answer_paths(spark):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id string, doc_id string, chunk_index int, text string, metadata map<string,string>")
    queries = spark.createDataFrame(
        [(1, "vacation policy"), (2, "vacation fix"), (3, "vacation stubborn"), (4, "tell a joke"),
         (5, "vacation garble"), (6, "vacation fail"), (7, "vacation silent"), (8, "vacation hollow")],
        "qid int, text string",
    )
    index = fusion.build_hybrid_index(chunks)
    got = answering.answers(queries, lambda q: fusion.hybrid_topk(index, q), index.chunks, router, writer, critic)
    rows = {r.qid: r for r in got.collect()}
    assert (rows[1].text, rows[1].correction_rounds, rows[1].category) == ("first [1]", 0, "factual")
    assert (rows[2].text, rows[2].correction_rounds) == ("second [1] [1] [9] [2]", 1)
    assert [c.chunk_id for c in rows[2].citations] == list(dict.fromkeys(c.chunk_id for c in rows[2].citations))
    assert len(rows[2].citations) == 2 and all(len(c.quote) == 200 for c in rows[2].citations)
    assert rows[2].citations[0].source == "s" + rows[2].citations[0].document_id[1:]
    assert rows[3].correction_rounds == 2
    assert (rows[4].category, rows[4].citations, rows[4].context_size) == ("out_of_scope", [], None)
    assert rows[5].category == "factual"
    assert (rows[6].text, rows[6].error) == (None, "no answer")
    assert (rows[7].text, rows[7].correction_rounds, rows[7].error) == ("first [1]", 0, None)
    assert rows[8].error == "empty completion"
    pii = spark.createDataFrame([(1, True)], "qid int, pii_redacted boolean")
    bodies = {r.qid: json.loads(r.body) for r in answering.answer_json(got, pii).collect()}
    assert bodies[1]["pii_redacted"] is True and bodies[2]["pii_redacted"] is False
    log = answering.stage_log(got).filter("qid = 2").orderBy("seq").collect()
    assert [r.stage for r in log] == ["router", "retrieve", "reason", "critic", "reason", "critic", "cite", "answer"]
    assert [r.stage for r in answering.stage_log(got).filter("qid = 4").orderBy("seq").collect()] == ["router", "reject", "answer"]


def test_histogram_and_quantile(spark):
    events = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("a", 3.0), ("a", 30.0), ("b", None)], "k string, v double")
    rows = metrics.histogram(events, ["k"], "v", metrics.CHUNK_BOUNDS).filter("k = 'a'").orderBy("le").collect()
    assert [r.cumulative for r in rows] == [1, 2, 2, 3, 3, 3, 3, 4]
    assert rows[0].samples == 4 and rows[0].total == 34.0

    def quantile(pairs, q):
        items = F.array(*[F.struct(F.lit(float(le)).alias("le"), F.lit(c).alias("cumulative")) for le, c in pairs])
        return spark.range(1).select(metrics.bucket_quantile(items, q)).first()[0]

    inf = float("inf")
    assert quantile([(1, 2), (2, 4), (inf, 4)], 0.75) == pytest.approx(1.5)
    assert quantile([(1, 2), (2, 4), (inf, 4)], 0.25) == pytest.approx(0.5)
    assert quantile([(1, 0), (2, 1), (inf, 10)], 0.95) == 2.0
    assert quantile([(0, 3), (2, 4), (inf, 4)], 0.5) == 0.0
    assert quantile([(1, 0), (inf, 0)], 0.5) is None
