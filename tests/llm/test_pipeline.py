"""The pipeline's stages on planted cases, and the registered queries on the smallest tables."""

import os
import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from passagework.llm import catalog
from tests.llm.conftest import documents

FOLDER = "/root/testdata/sf0.001"


def test_stages_do_what_they_say(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    clean = [prose(150) for _ in range(300)]
    shared = prose(30)
    texts = clean + [clean[3], clean[4] + " tail"] + [prose(60) + " " + shared + " " + prose(60) for _ in range(4)]
    junk = [" ".join(["$$$ ### ***"] * 60), "buy now buy now " * 40, "short", "", None]
    docs = documents(spark, texts + junk)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, "none"), "stage")
        seen[name] = docs.collect()
    first, second, third, fourth, last = seen.values()
    assert {r.doc_id for r in first} == set(range(len(texts)))
    assert {r.doc_id for r in second} == {r.doc_id for r in first}
    assert {r.doc_id for r in third} == set(range(len(texts))) - {300, 301}
    holding = [r.text for r in fourth if r.doc_id >= 302]
    assert sum(shared in t for t in holding) == 1 and len(holding) == 4
    assert {r.doc_id: r.text for r in fourth if r.doc_id < 300} == dict(enumerate(clean))
    assert all(r.n_chars == len(r.text) for r in fourth)
    assert {r.doc_id for r in last} == {r.doc_id for r in fourth}
    room, capacity = {}, {}
    for r in last:
        room[r.bin_id] = room.get(r.bin_id, 0) + r["size"]
        capacity[r.bin_id] = r.capacity
    assert all(room[b] <= capacity[b] for b in room)


def test_stages_take_empty_tables(spark):
    docs = documents(spark, []).limit(0) if False else documents(spark, ["x"]).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "none")
        assert docs.collect() == []


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_registered_queries_cover_their_tables(spark, name):
    rows = entry.queries()[name](spark, FOLDER).collect()
    if name.startswith("op9"):
        assert len(rows) == 20 * spark.read.parquet(f"{FOLDER}/embeddings.parquet").filter("vec_id % 20 = 0").count()
    elif name.startswith("op11"):
        assert sorted(r.vec_id for r in rows) == sorted(r.vec_id for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect())
    elif name.startswith("op13"):
        items = {r.item_id for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
        assert {r.item_id for r in rows} == items and len(rows) == 20 * len(items)
    else:
        ids = {r.doc_id for r in rows}
        assert ids == {r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect()}
