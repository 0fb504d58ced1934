"""Exact top-k search by inner product, with a table of distances to pivots.

Vectors are scaled to integers, so scores are exact. With norms known, a large inner
product means a small distance: q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2. For every
vector the distances to PIVOTS vectors are computed beforehand; by the triangle
inequality d(q, x) is at least |d(q, p) - d(x, p)| for every pivot p, so the largest
of these gives an upper bound of the score. The candidates of a block are evaluated in
the order of their bounds, some at a time for some queries together; a query drops out
as soon as no bound that is left reaches its k-th best score, so nothing that could
still enter is left out.

The queries, a stated set of rows, are sent to the tasks in slices of SLICE_BYTES;
the vectors stay where they are read, and each task gives at most k rows a query.
Pivots are drawn from the table: the PIVOTS vectors with the smallest hash.

Defined cases: vectors that are null, empty, or hold null or non-finite components
take no part, neither as query nor as candidate; vectors of different length never
meet; a query's own row, by its number among the
stored rows, is no candidate, other rows with the same id are; query rows that repeat an id get a list each; ties go to
the smaller id, and rows that repeat id and vector each count; rows with a null id
take no part; only the two columns named are read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.session import materialize

PIVOTS = 16
SLICE_BYTES = 16 << 20
#: Candidates that a task scores together.
BLOCK_ROWS = 8_192
#: Queries whose bounds are held at the same time.
QUERY_ROWS = 256
#: Candidates whose scores are asked for at a time.
STEP = 1_024
LOWEST = np.iinfo(np.int64).min
#: Largest sum that doubles hold exactly.
EXACT = float(1 << 53)

FOUND = "query long, query_id long, vec_id long, score long"


def scaled(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(number, id, v): floor(scale * x) of every usable vector as longs; numbers are unique, and stay once stored."""
    x = F.col("x").cast("array<double>")
    usable = F.col("id").isNotNull() & (F.size(x) > 0) & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    )
    chosen = vectors.select(vectors[key].cast("long").alias("id"), vectors[vector].alias("x")).filter(usable)
    return chosen.select(F.monotonically_increasing_id().alias("number"), "id", F.transform(x, lambda c: F.floor(scale * c).cast("long")).alias("v"))


def _matrix(lists: list[list[int]]) -> np.ndarray:
    return np.array(lists, dtype=np.int64).reshape(len(lists), -1)


def _products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows; taken in doubles where these are exact."""
    most = vectors.shape[1] * float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0))
    if most < EXACT:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    return queries @ vectors.T


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distance of each vector to each pivot."""
    difference = vectors[:, None, :].astype(np.float64) - pivots[None, :, :]
    return np.sqrt((difference**2).sum(axis=2))


class Search:
    """The queries of one slice and length, with what they have found so far in one task."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, pivots: np.ndarray, k: int, numbers: np.ndarray | None = None):
        """`numbers` are those of the queries' rows; without them no candidate is a query's own row."""
        self.ids, self.queries, self.pivots, self.k = ids, queries, pivots, k
        self.numbers = -1 - np.arange(len(ids)) if numbers is None else numbers
        self.to_pivots = _distances(queries, pivots)
        self.norms = (queries.astype(np.float64) ** 2).sum(axis=1)
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(ids)
        self.evaluated = 0

    def add(self, ids: np.ndarray, vectors: np.ndarray, numbers: np.ndarray) -> None:
        """Offer a block of rows with their numbers."""
        table = _distances(vectors, self.pivots).astype(np.float32).T.copy()
        norms = (vectors.astype(np.float64) ** 2).sum(axis=1)
        to_pivots = self.to_pivots.astype(np.float32)
        for begin in range(0, len(self.ids), QUERY_ROWS):
            rows = slice(begin, begin + QUERY_ROWS)
            apart = to_pivots[rows]
            least = np.abs(apart[:, :1] - table[0])
            step = np.empty_like(least)
            for p in range(1, len(table)):
                np.subtract(apart[:, p, None], table[p], out=step)
                np.maximum(least, np.abs(step, out=step), out=least)
            # Single precision rounds distances by about 1e-7 of themselves; the room given here
            # covers that many times over, so a bound never falls below the score it stands for.
            bound = ((self.norms[rows, None] + norms) * (1 + 1e-5) - least.astype(np.float64) ** 2) / 2 + 1e-3
            self._offer(begin, bound, ids, vectors, numbers)

    def _offer(self, begin: int, bound: np.ndarray, ids: np.ndarray, vectors: np.ndarray, numbers: np.ndarray) -> None:
        """A block to the queries from `begin` on, in the order of the highest bound any of them has."""
        queries = self.queries[begin : begin + len(bound)]
        own = self.numbers[begin : begin + len(bound)]
        kth = np.array([x[0][-1] if len(x[0]) == self.k else LOWEST for x in self.best[begin : begin + len(bound)]])
        order = np.argsort(-bound.max(axis=0), kind="stable")
        parts = np.maximum.reduceat(bound[:, order], np.arange(0, len(order), STEP), axis=1)
        # The highest bound in a part or any later one.
        left = np.maximum.accumulate(parts[:, ::-1], axis=1)[:, ::-1]
        for at in range(0, len(order), STEP):
            waiting = np.flatnonzero(left[:, at // STEP] >= kth)
            if not len(waiting):
                break
            chosen = order[at : at + STEP]
            score = _products(queries[waiting], vectors[chosen])
            self.evaluated += score.size
            good = (score >= kth[waiting, None]) & (numbers[chosen] != own[waiting, None])
            for i in np.flatnonzero(good.any(axis=1)).tolist():
                q = begin + int(waiting[i])
                held_score, held_id = self.best[q]
                found = np.flatnonzero(good[i])
                score_of = np.concatenate([held_score, score[i, found]])
                name_of = np.concatenate([held_id, ids[chosen[found]]])
                first = np.lexsort((name_of, -score_of))[: self.k]
                self.best[q] = (score_of[first], name_of[first])
                if len(first) == self.k:
                    kth[waiting[i]] = score_of[first[-1]]

    def rows(self) -> Iterator[pa.RecordBatch]:
        for begin in range(0, len(self.ids), 4096):
            part = range(begin, min(begin + 4096, len(self.ids)))
            held = [len(self.best[q][1]) for q in part]
            query, query_id = (np.repeat(x[begin : begin + len(part)], held) for x in (self.numbers, self.ids))
            named = np.concatenate([self.best[q][1] for q in part])
            score = np.concatenate([self.best[q][0] for q in part])
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(query_id), pa.array(named), pa.array(score)], names=["query", "query_id", "vec_id", "score"])


def _search_slice(candidates: DataFrame, queries: DataFrame, pivots: list, k: int) -> DataFrame:
    """Rows of FOUND: the best `k` of every task for each query of one slice."""
    context = candidates.sparkSession.sparkContext
    grouped: dict[int, tuple[list[int], list[list[int]], list[int]]] = {}
    for r in queries.select("number", "id", "v").toLocalIterator():
        ids, rows, numbers = grouped.setdefault(len(r["v"]), ([], [], []))
        ids.append(r["id"])
        numbers.append(r["number"])
        rows.append(r["v"])
    near: dict[int, list[list[int]]] = {}
    for r in pivots:
        near.setdefault(len(r["v"]), []).append(r["v"])
    packed = {
        size: (np.array(ids, dtype=np.int64), _matrix(rows), _matrix(near[size]) if size in near else np.zeros((1, size), np.int64), k, np.array(numbers, dtype=np.int64))
        for size, (ids, rows, numbers) in grouped.items()
    }
    shared = context.broadcast(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = {size: Search(*parts) for size, parts in shared.value.items()}
        waiting: dict[int, list[tuple[int, list[int], int]]] = {size: [] for size in searches}

        def flush(size: int) -> None:
            rows = waiting[size]
            if rows:
                named, vectors, numbers = zip(*rows)
                searches[size].add(np.array(named, dtype=np.int64), _matrix(list(vectors)), np.array(numbers, dtype=np.int64))
                rows.clear()

        for batch in batches:
            for named, v, number in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if len(v) in waiting:
                    waiting[len(v)].append((named, v, number))
                    if len(waiting[len(v)]) == BLOCK_ROWS:
                        flush(len(v))
        for size, search in searches.items():
            flush(size)
            yield from search.rows()

    return candidates.select("id", "v", "number").mapInArrow(run, FOUND)


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: int = 64
) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` highest scores of each query.

    `is_query` is a condition on `vec_id`, which holds the key.
    """
    usable = materialize(scaled(vectors, key, vector, scale), "search-vectors")
    query = usable.withColumnRenamed("id", "vec_id").withColumn("own", is_query).filter("own")
    queries = query.select("number", F.col("vec_id").alias("id"), "v")
    size = queries.agg(F.sum(F.size("v") * 8 + 16)).first()[0] or 0
    parts = max(1, -(-size // SLICE_BYTES))
    pivots = usable.select("v").orderBy(F.xxhash64("v")).limit(PIVOTS).collect()
    found = None
    for i in range(parts):
        own = queries.filter(F.pmod(F.xxhash64("number"), F.lit(parts)) == i)
        part = materialize(_best(_search_slice(usable, own, pivots, k), k), "search-slice")
        found = part if found is None else found.union(part)
    return found


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
