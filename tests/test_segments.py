"""The sparse index in segments: batches of additions and removals against the formula over what is live."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType

from passagework.operators import segments, sparse
from passagework.session import scratch_path
from passagework.sources.tables import publish
from tests.test_retrieval import QUERIES, corpus, okapi

SCHEMA = "chunk_id string, text string"


def test_merging_takes_a_full_size_class_and_all_below():
    assert segments.to_merge({1: 10, 2: 11, 3: 12}) == []
    assert segments.to_merge({1: 10, 2: 11, 3: 12, 4: 15}) == [1, 2, 3, 4]
    assert segments.to_merge({1: 900, 2: 1, 3: 10, 4: 11, 5: 12, 6: 15}) == [2, 3, 4, 5, 6]
    assert segments.to_merge({1: 900, 2: 10, 3: 11, 4: 60}) == []


def test_index_follows_additions_and_removals(spark, monkeypatch):
    monkeypatch.setattr(sparse, "RANGE_ROWS", 8)
    rng = random.Random(5)
    root = scratch_path(spark, "segments")
    queries = spark.createDataFrame(QUERIES, "qid bigint, text string")
    chunks, live, counts = corpus(260), {}, []
    for batch, size in enumerate([60, 20, 25, 22, 0, 30, 28]):
        added = dict(chunks[sum(counts) : sum(counts) + size])
        counts.append(size)
        removed = dict(rng.sample(sorted(live.items()), min(len(live), 9))) if batch else {}
        frames = [spark.createDataFrame(list(rows.items()), SCHEMA) for rows in (added, removed)]
        if batch == 3:
            # A run that dies before it is listed leaves nothing that counts.
            segments.add_batch(root, batch, frames[0].limit(5), frames[1].limit(2))
        segments.add_batch(root, batch, *frames)
        publish(spark, root, batch)
        live = {c: t for c, t in live.items() if c not in removed} | added
        if batch in (2, 3, 6):
            found = sparse.bm25_topk(segments.open_index(spark, root), queries, 7).collect()
            for qid, text in QUERIES:
                mine = sorted((r.rank, r.chunk_id, r.score) for r in found if r.qid == qid)
                assert [(c, pytest.approx(s, abs=1e-8)) for _, c, s in mine] == okapi(list(live.items()), text)[:7]
    listed = segments.live_segments(spark, root)
    assert sum(listed.values()) >= len(live) and len(listed) == 3 and max(listed) > segments.MERGED
    merged = spark.read.parquet(f"{root}/{segments.INDEX}").filter(f"batch = {max(listed)} and bucket = {sparse.HEADS}").collect()
    assert max(r.n for r in merged) <= 12 and len(merged) <= 2 * sum(r.n for r in merged) / 8 + 2


def test_a_search_opens_the_folders_of_its_terms(spark):
    chunks = corpus(60)
    index = sparse.build_index(spark.createDataFrame(chunks, SCHEMA))
    row = spark.range(1).select(sparse.bucket_of(F.lit("beta")).alias("b")).first()
    blocks = sparse.wanted_blocks(index, {"beta": row.b})
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert f"(bucket#" in plan and f"= {row.b})" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {r.term for r in blocks.collect()} == {"beta"}


def test_a_range_has_one_row_for_each_folder(spark):
    """Not one for each term, most of which are rare; the blocks taken from it are those of all its terms."""
    chunks = [(f"c{i}", f"common word{i} other{i % 5}") for i in range(60)]
    index = sparse.build_index(spark.createDataFrame(chunks, SCHEMA).coalesce(1))
    assert index.rows.count() <= 1 + sparse.BUCKETS
    terms = {r.term: r.df for r in index.terms.collect()}
    assert len(terms) == 1 + 60 + 5
    folders = {r.term: r.b for r in index.terms.select("term", sparse.bucket_of(F.col("term")).alias("b")).collect()}
    blocks = sparse.wanted_blocks(index, folders).collect()
    assert {r.term: (r.n, len(r.slots), len(r.tfs), r.most, r.least) for r in blocks} == {t: (n, 2 * n, 4 * n, 1, 3) for t, n in terms.items()}


def test_bytes_of_slices():
    column = pa.array([b"ab", b"", None, b"c", b"de"], pa.binary())
    for part in (column, column.slice(1), column.slice(1, 3), column.slice(4), column.slice(2, 0), column.slice(1, 2)):
        assert bytes(sparse.joined(part)) == b"".join(x or b"" for x in part.to_pylist())
    assert bytes(sparse.joined(pa.array([None], pa.binary()))) == b""


def test_ranges_that_cannot_matter_are_not_scored():
    rows = [{"qid": 1, "term": "rare", "weight": 5.0}, {"qid": 1, "term": "word", "weight": 0.5}, {"qid": 2, "term": "word", "weight": 0.5}]
    search = sparse.RangeSearch(sparse._Weights(rows, 10.0), 2)
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in sparse.store_schema(StringType())])

    def offer(number, terms):
        codes, slots, tfs = zip(*[(i, slot, tf) for i, found in enumerate(terms.values()) for slot, tf in found])
        rows = sparse.range_rows(number, pa.array([f"{number}-{i}" for i in range(4)]), np.full(4, 10), pa.array([*terms]), np.array(codes), np.array(slots), np.array(tfs), schema)
        whole = pa.concat_batches([*rows])
        before = search.scored
        search.add(whole.append_column("gone", pa.nulls(whole.num_rows, pa.list_(pa.int32()))))
        return search.scored - before

    assert offer(1, {"rare": [(0, 1), (2, 1)], "word": [(0, 1), (1, 2)]}) == 2
    # The first query holds two scores that "word" alone cannot reach; the second is still open to more of it.
    assert offer(2, {"word": [(3, 4)]}) == 1
    assert offer(3, {"word": [(0, 1)]}) == 0
    assert offer(4, {"rare": [(3, 9)]}) == 1
    assert [i.tolist() for i in search.best.ids] == [["4-3", "1-0"], ["2-3", "1-1"]]


def test_an_empty_index_answers_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    queries = spark.createDataFrame(QUERIES, "qid bigint, text string")
    assert sparse.bm25_topk(sparse.build_index(none), queries).collect() == []
    blank = spark.createDataFrame([("a", ""), ("b", None)], SCHEMA)
    assert sparse.bm25_topk(sparse.build_index(blank), queries).collect() == []
    root = scratch_path(spark, "segments")
    segments.add_batch(root, 0, none, none)
    publish(spark, root, 0)
    assert sparse.bm25_topk(segments.open_index(spark, root), queries).collect() == []
