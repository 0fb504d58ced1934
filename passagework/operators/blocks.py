"""The best `k` of blocks of scores, kept inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

# Scores held at once by a task: 32 MB of doubles.
SCORES_AT_ONCE = 4_000_000
# Offered scores that are worth sorting, and rows of a batch of results.
LEAST_SORTED = 1 << 16
ROWS_EMITTED = 100_000
# Bytes of a result of a query while it is found: held, offered, and both once more while they are sorted.
RESULT_BYTES = 128


class BestK:
    """Running best `k` (score descending, id ascending) for each of `count` queries."""

    def __init__(self, count: int, k: int) -> None:
        self.k = k
        self.scores = [np.empty(0)] * count
        self.ids = [np.empty(0, dtype=object)] * count

    def add(self, ids: np.ndarray, block: np.ndarray, first: int | np.ndarray = 0) -> None:
        """Offer scores (queries x ids) for the queries from `first` on, or for those of these numbers; -inf means none."""
        if block.shape[1] > self.k:
            floor = np.partition(block, -self.k, axis=1)[:, -self.k]
        else:
            floor = np.full(len(block), -np.inf)
        numbers = range(first, first + len(block)) if isinstance(first, int) else first.tolist()
        for row, query in enumerate(numbers):
            self._merge(query, ids, block[row], floor[row])

    def _merge(self, query: int, ids: np.ndarray, scores: np.ndarray, least: float) -> None:
        held = self.scores[query]
        if len(held) == self.k:
            least = max(least, held[-1])
        near = np.flatnonzero((scores >= least) & (scores > -np.inf))
        if not len(near):
            return
        scores = np.concatenate([held, scores[near]])
        names = np.concatenate([self.ids[query], ids[near]])
        order = np.lexsort((names, -scores))[: self.k]
        self.scores[query], self.ids[query] = scores[order], names[order]

    def emit(self, qids: list, qid_type: pa.DataType, id_type: pa.DataType) -> pa.RecordBatch:
        """(qid, chunk_id, score) of everything held."""
        owners = [q for q, s in zip(qids, self.scores) for _ in range(len(s))]
        ids = [i for part in self.ids for i in part]
        scores = np.concatenate(self.scores) if self.scores else np.empty(0)
        columns = [pa.array(owners, qid_type), pa.array(ids, id_type), pa.array(scores, pa.float64())]
        return pa.RecordBatch.from_arrays(columns, names=["qid", "chunk_id", "score"])


class BestRows:
    """The best `k` of blocks of scores for each of `count` queries, in flat arrays of numbers.

    What is offered gathers until there is more of it than is held; then both are sorted, and
    the `k`-th score of a query is what the next blocks must reach. With `digits`, scores are rounded first.
    """

    def __init__(self, count: int, k: int, digits: int | None = None) -> None:
        self.k, self.digits = k, digits
        # A score this much below another one may be equal to it once both are rounded.
        self.room = 0.0 if digits is None else 10.0**-digits
        self.floor = np.full(count, -np.inf)
        self.held: tuple[np.ndarray, ...] | None = None
        self.offered: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def add(self, ids: np.ndarray, block: np.ndarray, numbers: np.ndarray) -> None:
        """Offer scores (queries x ids) for the queries of these numbers."""
        floor = self.floor[numbers]
        open_ended = np.flatnonzero(np.isneginf(floor))
        if len(open_ended) and block.shape[1] > self.k:
            floor[open_ended] = np.partition(block[open_ended], -self.k, axis=1)[:, -self.k]
        row, column = np.nonzero(block >= (floor - self.room)[:, None])
        scores = block[row, column]
        if self.digits is not None:
            scores = np.round(scores, self.digits)
        self.offered.append((numbers[row].astype(np.int32), scores, ids[column]))
        self.waiting += len(row)
        if self.waiting > max(LEAST_SORTED, 0 if self.held is None else len(self.held[0])):
            self._settle()

    def _settle(self) -> None:
        parts = [*([] if self.held is None else [self.held]), *self.offered]
        self.offered, self.waiting = [], 0
        if not parts:
            return
        numbers, scores, ids = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((ids, -scores, numbers))
        numbers = numbers[order]
        first = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]]) if len(numbers) else np.empty(0, np.int64)
        sizes = np.diff(np.r_[first, len(numbers)])
        kept = np.arange(len(numbers)) - np.repeat(first, sizes) < self.k
        order = order[kept]
        self.held = (numbers[kept], scores[order], ids[order])
        full = sizes >= self.k
        self.floor[numbers[first[full]]] = scores[order][np.cumsum(np.minimum(sizes, self.k))[full] - 1]

    def emit(self, qids: pa.Array, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        """(qid, chunk_id, score) of everything held."""
        self._settle()
        for begin in range(0, 0 if self.held is None else len(self.held[0]), ROWS_EMITTED):
            numbers, scores, ids = (x[begin : begin + ROWS_EMITTED] for x in self.held)
            columns = [qids.take(pa.array(numbers)), pa.array(ids, id_type), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["qid", "chunk_id", "score"])


def id_values(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Ids as NumPy can sort them: numbers as numbers, others as objects."""
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy()
    return np.array(column.to_pylist(), dtype=object)


def result_types(queries: DataFrame, chunks: DataFrame) -> tuple[str, pa.DataType, pa.DataType]:
    """DDL of (qid, chunk_id, score) and the Arrow types of both ids."""
    qid, chunk = queries.schema["qid"].dataType, chunks.schema["chunk_id"].dataType
    ddl = f"qid {qid.simpleString()}, chunk_id {chunk.simpleString()}, score double"
    return ddl, to_arrow_type(qid), to_arrow_type(chunk)
