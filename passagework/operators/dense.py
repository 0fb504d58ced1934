"""Exact cosine search of a table of vectors for a table of query vectors.

Scores are computed as matrix products inside tasks; only the best `k` per task
and query leave it, so the |queries| x |vectors| pairs never become rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.defaults import DENSE_TOP_K, RANK_DIGITS
from passagework.operators.blocks import RESULT_BYTES, SCORES_AT_ONCE, BestRows, id_values, result_types
from passagework.operators.sizing import top_k

# Bytes of the query vectors that are sent to every task at a time, and of their results in a task.
QUERY_BYTES = 64 * 1024 * 1024


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; rows of length zero stay zero."""
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and not (sizes == dim).all():
        raise ValueError(f"every vector must have {dim} values")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(sizes), dim)


def _search(best: BestRows, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
    """Score `vectors` for unit-length `queries`, a bounded block of products at a time."""
    vectors = unit_rows(vectors)
    step = max(1, SCORES_AT_ONCE // max(1, len(vectors)))
    for start in range(0, len(queries), step):
        block = queries[start : start + step] @ vectors.T
        best.add(ids, block, np.arange(start, start + len(block)))


def _broadcast_scores(vectors: DataFrame, rows: list, dim: int, k: int, types: tuple) -> DataFrame:
    schema, qid_type, id_type = types
    matrix = np.array([row["vector"] for row in rows], dtype=np.float64).reshape(len(rows), dim)
    if not np.linalg.norm(matrix, axis=1).all():
        raise ValueError("query vector has zero norm")
    qids = pa.array([row["qid"] for row in rows], qid_type)
    sent = vectors.sparkSession.sparkContext.broadcast((qids, unit_rows(matrix)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries = sent.value
        best = BestRows(len(queries), k, RANK_DIGITS)
        for batch in batches:
            _search(best, queries, id_values(batch.column("chunk_id")), _matrix(batch.column("vector"), dim))
        yield from best.emit(names, id_type)

    return vectors.mapInArrow(search, schema)


def dense_topk(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = DENSE_TOP_K,
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """(qid, chunk_id, score, rank, origin) of the `k` vectors nearest to each query.

    `vectors(chunk_id, vector)`, `queries(qid, vector)`, of which so many meet all vectors at
    a time that they and what a task holds for them take `query_bytes`. Ties go to the smaller id. A stored vector of length zero scores 0; a query of length zero is an error.
    """
    vectors, queries = vectors.select("chunk_id", "vector"), queries.select("qid", "vector")
    types = result_types(queries, vectors)
    # The measure of the query side: one row of two numbers comes back.
    dim, count = queries.agg(F.max(F.size("vector")), F.count("*")).first()
    scored = queries.sparkSession.createDataFrame([], types[0])
    parts = min(count, -(-count * ((dim or 0) * 8 + k * RESULT_BYTES) // query_bytes))
    for part in range(parts):
        # Every slice of the queries is one scan of the vectors, which stay where they are read.
        own = queries.filter(F.pmod(F.xxhash64("qid"), F.lit(parts)) == part).collect()
        if own:
            scored = scored.unionByName(_broadcast_scores(vectors, own, dim, k, types))
    best = top_k(scored, "qid", [F.desc("score"), F.col("chunk_id")], k)
    return best.withColumn("origin", F.lit("dense"))


def upsert(old: DataFrame, new: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """(store, rejected): one row per chunk_id, that of the highest `batch`.

    Rows of `new` whose vector does not have `dim` values are rejected.
    """
    fits = F.coalesce(F.size("vector") == dim, F.lit(False))
    rows = old.unionByName(new.filter(fits))
    columns = [F.col(c) for c in rows.columns if c != "chunk_id"]
    newest = F.max_by(F.struct(*columns), "batch").alias("row")
    store = rows.groupBy("chunk_id").agg(newest).select("chunk_id", "row.*")
    return store, new.filter(~fits)


def unmatched(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks without a vector and vectors without a chunk; empty for a sound store."""
    lone_chunks = chunks.select("chunk_id").join(vectors, "chunk_id", "left_anti")
    lone_vectors = vectors.select("chunk_id").join(chunks, "chunk_id", "left_anti")
    return lone_chunks.withColumn("missing", F.lit("vector")).unionByName(
        lone_vectors.withColumn("missing", F.lit("chunk"))
    )
