"""Reciprocal-rank fusion, reranking and hybrid retrieval."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.defaults import (
    DENSE_TOP_K,
    FINAL_TOP_K,
    HASH_DIM,
    MAX_QUERY_CHARS,
    MIN_QUERY_CHARS,
    RANK_DIGITS,
    RRF_K,
    SPARSE_TOP_K,
)
from passagework.functions.text import tokenize, words
from passagework.functions.vectors import embed_words
from passagework.operators.dense import dense_topk
from passagework.operators.sizing import BROADCAST_BYTES, fits_broadcast, top_k
from passagework.operators.sparse import SparseIndex, bm25_topk, index_words
from passagework.session import materialize


def valid_query(text: Column) -> Column:
    return F.length(text).between(MIN_QUERY_CHARS, MAX_QUERY_CHARS)


def embed_text(text: Column, dim: int = HASH_DIM) -> Column:
    """Unit vector of the built-in hashing model."""
    return embed_words(words(text), dim, unit=True)


def has_length(vector: Column) -> Column:
    return F.exists(vector, lambda x: x != 0)


def rrf_fuse(dense: DataFrame, sparse: DataFrame, k: int = RRF_K) -> DataFrame:
    """(qid, chunk_id, score, rank, origin): each list adds 1 / (k + rank).

    Equal scores keep the order of first appearance, the dense list first. The
    lists hold at most the retrieval depth per query, so the window is small.
    """
    lists = dense.select("qid", "chunk_id", "rank", F.lit(0).alias("list")).unionByName(
        sparse.select("qid", "chunk_id", "rank", F.lit(1).alias("list"))
    )
    fused = lists.groupBy("qid", "chunk_id").agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), RANK_DIGITS + 3).alias("score"),
        F.min(F.struct("list", "rank")).alias("seen"),
    )
    ranked = top_k(fused, "qid", [F.desc("score"), F.col("seen")], 1 << 30)
    return ranked.drop("seen").withColumn("origin", F.lit("fused"))


def overlap_score(query: Column, text: Column) -> Column:
    """Built-in pair scorer: the share of distinct query tokens found in the text."""
    asked = F.array_distinct(tokenize(query))
    shared = F.size(F.array_intersect(asked, tokenize(text)))
    return F.when(F.size(asked) > 0, shared / F.size(asked)).otherwise(F.lit(0.0))


def with_text(ranked: DataFrame, texts: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Attach chunk columns to a ranked list.

    The list holds a bounded number of ids per query; while it is small it is
    sent to the chunk table, so the texts are filtered where they are read.
    """
    # Stored first: measuring it would otherwise run the whole retrieval once more.
    ranked = materialize(ranked, "ranked")
    if fits_broadcast(ranked, broadcast_bytes):
        ranked = F.broadcast(ranked)
    return texts.join(ranked, "chunk_id")


def rerank(
    candidates: DataFrame,
    queries: DataFrame,
    chunks: DataFrame,
    pool: int = DENSE_TOP_K,
    k: int = FINAL_TOP_K,
    scorer=overlap_score,
) -> DataFrame:
    """Score the first `pool` candidates per query as (query, text) pairs and keep `k`.

    `scorer(query, text)` returns a Column: an expression or a Pandas UDF around a model.
    """
    pool_rows = candidates.filter(F.col("rank") <= pool).select(
        "qid", "chunk_id", F.col("rank").alias("before")
    )
    pairs = with_text(pool_rows, chunks.select("chunk_id", "text")).join(
        queries.select("qid", F.col("text").alias("query")), "qid"
    )
    scored = pairs.select(
        "qid",
        "chunk_id",
        "before",
        F.round(scorer(F.col("query"), F.col("text")), RANK_DIGITS).alias("score"),
    )
    best = top_k(scored, "qid", [F.desc("score"), F.col("before")], k)
    return best.drop("before").withColumn("origin", F.lit("reranked"))


def first_ranks(ranked: DataFrame, k: int = FINAL_TOP_K) -> DataFrame:
    """The reranker that changes nothing: a slice."""
    return ranked.filter(F.col("rank") <= k)


@dataclass(frozen=True)
class HybridIndex:
    """Chunk texts, postings and vectors of one collection."""

    chunks: DataFrame
    sparse: SparseIndex
    vectors: DataFrame


def build_hybrid_index(chunks: DataFrame, embed=None) -> HybridIndex:
    """One pass over the texts writes chunks, words and vectors side by side; the words are then inverted.

    `embed(text column)` is a model; the built-in one works on the words at hand.

    The table is columnar, so each leg later reads only its own columns.
    """
    vector = embed(F.col("text")) if embed else embed_words(F.col("words"), HASH_DIM, unit=True)
    rows = chunks.withColumn("words", words(F.col("text"))).withColumn("vector", vector)
    stored = materialize(rows, "index")
    return HybridIndex(
        stored.select(*chunks.columns),
        index_words(stored.select("chunk_id", "words")),
        stored.select("chunk_id", "vector"),
    )


def hybrid_candidates(
    index: HybridIndex,
    queries: DataFrame,
    dense_k: int = DENSE_TOP_K,
    sparse_k: int = SPARSE_TOP_K,
    rrf_k: int = RRF_K,
    embed=embed_text,
) -> DataFrame:
    """Dense and sparse lists of every query in `queries(qid, text)`, fused.

    A query without any known token has no vector; it has only its sparse list.
    """
    dense = dense_search(index, queries, dense_k, embed)
    sparse = bm25_topk(index.sparse, queries, sparse_k)
    return rrf_fuse(dense, sparse, rrf_k)


def hybrid_topk(index: HybridIndex, queries: DataFrame, k: int = FINAL_TOP_K, **options) -> DataFrame:
    return first_ranks(hybrid_candidates(index, queries, **options), k)


# Named pair scorers (None keeps the order) and searches; an unknown name fails before any job starts.
SCORERS = {"overlap": overlap_score, "none": None}
SEARCHES = {
    "bm25": lambda index, queries, k=SPARSE_TOP_K: bm25_topk(index.sparse, queries, k),
    "dense": lambda index, queries, k=DENSE_TOP_K: dense_search(index, queries, k),
    "hybrid": hybrid_topk,
}


def dense_search(index: HybridIndex, queries: DataFrame, k: int = DENSE_TOP_K, embed=embed_text) -> DataFrame:
    """Dense lists of `queries(qid, text)`; a query without any known token has none."""
    vectored = queries.select("qid", embed(F.col("text")).alias("vector")).filter(has_length(F.col("vector")))
    return dense_topk(index.vectors, vectored, k)


def named(registry: dict, name: str):
    if name not in registry:
        raise ValueError(f"unknown name: {name}")
    return registry[name]
