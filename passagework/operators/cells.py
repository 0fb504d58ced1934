"""Approximate cosine search: inverted cells, residual product codes, exact scores of a short list.

Unit vectors are dealt into cells around coarse centroids. What is left of a vector, its
residual, is cut into PARTS pieces, and each piece is written as the number of the nearest
of CODES small centroids: a code of PARTS bytes. A store has one folder for each cell, with
code and vector of its members in columns of their own.

A query reads only the codes of the cells nearest to it, scores them by inner products with
what they stand for (cell centroid plus small centroids, a block of a cell at a time), keeps the
best SHORT x k, and only these are scored exactly, by their vectors.

Centroids are fitted on a sample of at most SAMPLE vectors; every vector is indexed. How many
cells are read is found on that sample, too: the fewest that give the wanted recall for
TRIALS of its vectors against a search of the whole sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from passagework.defaults import DENSE_TOP_K, RANK_DIGITS
from passagework.operators.blocks import RESULT_BYTES, SCORES_AT_ONCE, BestRows, id_values, result_types
from passagework.operators.dense import QUERY_BYTES, _matrix, unit_rows
from passagework.operators.sizing import top_k
from passagework.session import materialize, scratch_path

SAMPLE = 20_000
TRIALS = 256
RECALL = 0.95
PARTS = 16
CODES = 256
TURNS = 12
#: Codes scored for every candidate that is looked at exactly.
SHORT = 12
#: Files that a cell is dealt out to, at least.
FILES = 4
#: Pairs of blocks for each core, codes of a block, and queries of a block that are not dealt out further.
BLOCKS_A_CORE = 4
CODES_AT_ONCE = 1_000_000
LEAST_QUERIES = 256
#: Vectors that a task has as numbers at a time, besides its blocks.
DECODED = 10_000
#: Most cells: each is a folder.
MOST_CELLS = 4_096


@dataclass(frozen=True)
class CellIndex:
    """The store, what was fitted, how many cells a query reads, and the dimension."""

    rows: DataFrame
    centroids: np.ndarray
    pieces: np.ndarray
    probes: int


def fit_centroids(vectors: np.ndarray, count: int, seed: int, turns: int = TURNS) -> np.ndarray:
    """Centroids by Lloyd's rounds, from `count` vectors drawn at random; an empty one keeps its place."""
    rng = np.random.default_rng(seed)
    found = vectors[np.sort(rng.choice(len(vectors), min(count, len(vectors)), replace=False))].copy()
    for _ in range(turns):
        own = nearest(vectors, found)
        sums = np.zeros_like(found)
        np.add.at(sums, own, vectors)
        n = np.bincount(own, minlength=len(found))
        found[n > 0] = sums[n > 0] / n[n > 0, None]
    return found


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The number of the nearest centroid; of equally near ones the first."""
    return ((centroids**2).sum(axis=1) - 2 * vectors @ centroids.T).argmin(axis=1)


def cells_of(queries: np.ndarray, centroids: np.ndarray, probes: int) -> np.ndarray:
    """The nearest cells of each query, nearest first."""
    far = (centroids**2).sum(axis=1) - 2 * queries @ centroids.T
    return np.argsort(far, axis=1, kind="stable")[:, :probes]


def fit_pieces(residuals: np.ndarray, seed: int) -> np.ndarray:
    """(parts, codes, width): small centroids for each piece of the residuals."""
    parts = cut(residuals)
    return np.stack([_filled(fit_centroids(p, CODES, seed + 1 + i)) for i, p in enumerate(parts)])


def _filled(centroids: np.ndarray) -> np.ndarray:
    """As many as CODES, the last one repeated."""
    return centroids[np.minimum(np.arange(CODES), len(centroids) - 1)]


def cut(vectors: np.ndarray) -> list[np.ndarray]:
    """PARTS pieces of equal width; the last ones are filled with zeros."""
    width = -(-vectors.shape[1] // PARTS)
    wide = np.pad(vectors, ((0, 0), (0, width * PARTS - vectors.shape[1])))
    return [wide[:, i * width : (i + 1) * width] for i in range(PARTS)]


def encode(residuals: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    return np.stack([nearest(p, c) for p, c in zip(cut(residuals), pieces)], axis=1).astype(np.uint8)


def decode(codes: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """The residuals that codes stand for, filled with zeros like those of `cut`."""
    return np.concatenate([p[codes[:, i]] for i, p in enumerate(pieces)], axis=1)


def enough_probes(sample: np.ndarray, centroids: np.ndarray, k: int, recall: float) -> int:
    """The fewest cells that hold `recall` of the `k` nearest of the sample, over TRIALS of its vectors."""
    step = max(1, len(sample) // TRIALS)
    asked = sample[::step]
    best = np.argsort(-(asked @ sample.T), axis=1, kind="stable")[:, :k]
    own = nearest(sample, centroids)
    order = cells_of(asked, centroids, len(centroids))
    place = np.argsort(order, axis=1)
    # A neighbour is found if its cell comes among the first ones of the query.
    needed = np.sort(np.take_along_axis(place, own[best], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1 if len(needed) else 1


def build(vectors: DataFrame, k: int = DENSE_TOP_K, recall: float = RECALL, cells: int | None = None, seed: int = 7) -> CellIndex:
    """Index `vectors(chunk_id, vector)`; all of one length. Vectors of length zero have a cell like any other."""
    spark = vectors.sparkSession
    chosen = vectors.select("chunk_id", "vector")
    rows = chosen.orderBy(F.xxhash64("chunk_id")).limit(SAMPLE).select("vector").collect()
    sample = unit_rows(np.array([r["vector"] for r in rows], dtype=np.float64)) if rows else np.zeros((1, 1))
    count = cells or min(MOST_CELLS, max(1, int(np.sqrt(chosen.count()))))
    centroids = fit_centroids(sample, count, seed)
    pieces = fit_pieces(sample - centroids[nearest(sample, centroids)], seed)
    probes = enough_probes(sample, centroids, k, recall)
    dim = sample.shape[1]
    shared = spark.sparkContext.broadcast((centroids, pieces))
    schema = StructType([chosen.schema["chunk_id"], *StructType.fromDDL("vector array<double>, cell int, code binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, pieces = shared.value
        for batch in batches:
            units = unit_rows(_matrix(batch.column("vector"), dim))
            cell = nearest(units, centroids)
            codes = encode(units - centroids[cell], pieces)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(units) + 1) * dim, pa.int32()), pa.array(units.ravel()))
            columns = [batch.column("chunk_id"), lists, pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk_id", "vector", "cell", "code"])

    path = scratch_path(spark, "cells")
    # A cell is several files, so no cell is one task's work, and a task writes few cells.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = F.pmod(F.xxhash64("chunk_id"), F.lit(max(FILES, tasks // len(centroids))))
    dealt = chosen.mapInArrow(run, schema).repartition(tasks, "cell", spread)
    dealt.sortWithinPartitions("cell").write.partitionBy("cell").parquet(path)
    stored = StructType([f for f in schema if f.name != "cell"] + [schema["cell"]])
    return CellIndex(spark.read.schema(stored).parquet(path), centroids, pieces, probes)


def search(index: CellIndex, queries: DataFrame, k: int = DENSE_TOP_K, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(qid, chunk_id, score, rank, origin) of the `k` nearest found; scores are exact, the choice is approximate.

    Blocks of queries `(qid, vector)` meet blocks of codes, each pair of blocks in a task of its
    own; queries and what is found for them take at most `query_bytes` there.
    """
    asked = queries.select("qid", "vector")
    schema, qid_type, id_type = result_types(asked, index.rows)
    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    count, least = asked.agg(F.count("*"), F.min(squares)).first()
    if least == 0:
        raise ValueError("query vector has zero norm")
    own = index.rows.filter(F.col("cell").isin(_cells_wanted(index, asked)))
    listed = _short_lists(index, asked, own, count, SHORT * k, query_bytes, (schema, qid_type, id_type))
    met = _exact(index, asked, own, listed, count, query_bytes, (schema, qid_type, id_type))
    return top_k(met, "qid", [F.desc("score"), F.col("chunk_id")], k).withColumn("origin", F.lit("dense"))


def _cells_wanted(index: CellIndex, asked: DataFrame) -> list[int]:
    """The cells that any query reads, at most MOST_CELLS."""
    shared = asked.sparkSession.sparkContext.broadcast(index.centroids)
    probes, dim = index.probes, index.centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = cells_of(unit_rows(_matrix(batch.column("vector"), dim)), shared.value, probes)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(near), pa.int32())], names=["cell"])

    return [r["cell"] for r in asked.select("vector").mapInArrow(run, "cell int").distinct().collect()]


def _block(key: str, blocks: int):
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _every(blocks: int):
    return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))


def _short_lists(index: CellIndex, asked: DataFrame, own: DataFrame, count: int, short: int, query_bytes: int, types: tuple) -> DataFrame:
    """(qid, chunk_id): the `short` best by codes for every query, stored."""
    schema, qid_type, id_type = types
    spark = asked.sparkSession
    dim, probes = index.centroids.shape[1], index.probes
    tasks = BLOCKS_A_CORE * spark.sparkContext.defaultParallelism
    # Codes are small and sent to every block of queries, so a block finds its lists whole.
    blocks = max(1, -(-count * (dim * 8 + short * RESULT_BYTES) // query_bytes), min(tasks, count // LEAST_QUERIES))
    parts = max(1, -(-own.count() // CODES_AT_ONCE), -(-tasks // blocks))
    shared = spark.sparkContext.broadcast((index.centroids, index.pieces))

    def guess(queries: pa.Table, members: pa.Table) -> pa.Table:
        centroids, pieces = shared.value
        units = unit_rows(_matrix(queries.column("vector"), dim))
        asks = np.zeros((len(centroids), len(units)), dtype=bool)
        np.put_along_axis(asks.T, cells_of(units, centroids, probes), True, axis=1)
        cell = members.column("cell").to_numpy()
        order = np.argsort(cell, kind="stable")
        ids = id_values(members.column("chunk_id"))
        codes = np.frombuffer(b"".join(members.column("code").to_pylist()), dtype=np.uint8).reshape(-1, PARTS)
        best = BestRows(len(units), short)
        cuts = np.r_[0, np.flatnonzero(np.diff(cell[order])) + 1, len(order)].tolist()
        for begin, end in zip(cuts, cuts[1:]):
            for first in range(begin, end, DECODED):
                at = order[first : min(first + DECODED, end)]
                c = cell[at[0]]
                near = centroids[c] + decode(codes[at], pieces)[:, :dim]
                numbers = np.flatnonzero(asks[c])
                step = max(1, SCORES_AT_ONCE // len(at))
                for start in range(0, len(numbers), step):
                    some = numbers[start : start + step]
                    best.add(ids[at], units[some] @ near.T, some)
        names = queries.column("qid").combine_chunks()
        found = pa.schema([("qid", qid_type), ("chunk_id", id_type), ("score", pa.float64())])
        return pa.Table.from_batches([b.cast(found) for b in best.emit(names, id_type)], found)

    left = asked.select("qid", "vector", _block("qid", blocks).alias("qb"), _every(parts).alias("part"))
    right = own.select("chunk_id", "cell", "code", _block("chunk_id", parts).alias("part"), _every(blocks).alias("qb"))
    met = left.groupBy("qb", "part").cogroup(right.groupBy("qb", "part")).applyInArrow(guess, schema)
    best = top_k(met, "qid", [F.desc("score"), F.col("chunk_id")], short)
    return materialize(best.select("qid", "chunk_id").distinct(), "short-lists")


def _exact(index: CellIndex, asked: DataFrame, own: DataFrame, listed: DataFrame, count: int, query_bytes: int, types: tuple) -> DataFrame:
    """(qid, chunk_id, score) of the pairs `listed`: they meet the vectors of both sides by blocks of both."""
    schema, qid_type, id_type = types
    dim = index.centroids.shape[1]
    least = int(np.ceil(np.sqrt(BLOCKS_A_CORE * asked.sparkSession.sparkContext.defaultParallelism)))
    blocks, parts = (max(least, -(-n * dim * 8 // query_bytes)) for n in (count, own.count()))
    wide = F.col("vector").cast("array<double>").alias("vector")
    no_qid, no_chunk = (F.lit(None).cast(t.schema[c].dataType).alias(c) for t, c in ((asked, "qid"), (own, "chunk_id")))
    qb, part = _block("qid", blocks).alias("qb"), _block("chunk_id", parts).alias("part")
    queries = asked.select("qid", no_chunk, wide, F.lit(True).alias("asked"), qb, _every(parts).alias("part"))
    vectors = own.select(no_qid, "chunk_id", wide, F.lit(False).alias("asked"), _every(blocks).alias("qb"), part)

    def score(sides: pa.Table, pairs: pa.Table) -> pa.Table:
        flags = sides.column("asked")
        mine, theirs = sides.filter(flags), sides.filter(pc.invert(flags))
        units, near = (unit_rows(_matrix(t.column("vector"), dim)) for t in (mine, theirs))
        for side, key, place in ((mine, "qid", "q"), (theirs, "chunk_id", "v")):
            placed = pa.table({key: side.column(key), place: pa.array(np.arange(side.num_rows))})
            pairs = pairs.join(placed, key, join_type="inner", use_threads=False)
        q, v = pairs.column("q").to_numpy(), pairs.column("v").to_numpy()
        dots = [np.einsum("ij,ij->i", units[q[i : i + DECODED]], near[v[i : i + DECODED]]) for i in range(0, len(q), DECODED)]
        scores = np.round(np.concatenate([np.empty(0), *dots]), RANK_DIGITS)
        return pa.table({"qid": pairs.column("qid").cast(qid_type), "chunk_id": pairs.column("chunk_id").cast(id_type), "score": scores})

    pairs = listed.select("qid", "chunk_id", qb, part)
    both = queries.unionByName(vectors)
    return both.groupBy("qb", "part").cogroup(pairs.groupBy("qb", "part")).applyInArrow(score, schema)


def share_read(index: CellIndex, queries: DataFrame) -> DataFrame:
    """(qid, share): which share of all vectors lies in the cells that a query reads."""
    spark = queries.sparkSession
    sizes = {r["cell"]: r["count"] for r in index.rows.groupBy("cell").count().collect()}
    counts = np.array([sizes.get(c, 0) for c in range(len(index.centroids))], dtype=np.float64)
    shared = spark.sparkContext.broadcast((index.centroids, counts / max(counts.sum(), 1)))
    probes, dim = index.probes, index.centroids.shape[1]
    schema = StructType([queries.schema["qid"], *StructType.fromDDL("share double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, weights = shared.value
        for batch in batches:
            chosen = cells_of(unit_rows(_matrix(batch.column("vector"), dim)), centroids, probes)
            yield pa.RecordBatch.from_arrays([batch.column("qid"), pa.array(weights[chosen].sum(axis=1))], names=["qid", "share"])

    return queries.select("qid", "vector").mapInArrow(run, schema)
