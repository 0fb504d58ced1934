"""Centroid clustering whose bounds are loosened by the geometry of each cluster's sphere.

Every vector keeps an upper bound of the distance to its own centroid and one lower bound
for all others. When centroids move, the upper bound grows by the own centroid's drift.
The lower bound need not shrink by the largest drift of the others: all members of a
cluster lie in a sphere around its old centroid, and seen from there a centroid that moves
sideways or away comes hardly nearer. With m the middle of a drift of length d along the
unit vector u, any x satisfies

    |x - old| - |x - new| = 2 d (x - m).u / (|x - old| + |x - new|) <= d cos(x - m, u)

where the cosine is positive, and the difference is at most 0 elsewhere. In the plane of
the sphere's centre c, m and u the angle of (x - m, u) is at least that of (c - m, u) less
arcsin(radius / |c - m|); `loosening` takes d times the cosine of that angle, and d itself
if m lies in the sphere. A vector whose upper bound stays below its lower bound, or below
half the distance of its centroid to the nearest other, keeps its cluster unread; the
ambiguous ones are scanned exactly, in integers.

Vectors are stored once, in blocks, and never rewritten. A block's clusters and bounds
(12 bytes a vector) are a narrow table of their own, bucketed like the blocks, so a round
joins the two without a shuffle and writes the narrow one only. Centroids follow by the
sums of the vectors that changed cluster, added up in Spark; the driver sees `k` centroids.

Defined cases: vectors that are null, of another length, or hold null or non-finite
components, or scaled ones of 2^27 and more (their distances need not fit a long), take no
part; repeated rows each count; rows with a null key take part but never start a centroid,
and come back with a null key; among equal keys the smaller vector starts; with fewer
vectors than `k` there are fewer centroids; ties go to the smaller centroid number; a
centroid that loses all its vectors stays where it is; other columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import drop_stored, stored_by
from passagework.session import materialize

#: Vectors in a block.
BLOCK_ROWS = 2_048
#: Bytes of vectors that one bucket, the work of one task, should have; and the most buckets that Spark allows.
BUCKET_BYTES = 256 << 20
MOST_BUCKETS = 100_000
#: Scaled components stay below this, so that squared distances fit a long.
LARGEST = 1 << 27
#: Room for the rounding of bounds, as a share of the lengths they are computed from.
ROOM = 1e-9

BLOCKS = "block long, ids array<long>, vectors binary"
MOVES = "block long, clusters binary, upper binary, lower binary, cluster int, moved long, sums array<long>, radius double"


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster, how much nearer any other centroid can have come to any of its members.

    `radius` is that of the sphere around the old centroid that holds the members.
    """
    k = len(old)
    out = np.zeros(k)
    for j in range(k):
        step = new[j] - old[j]
        drift = float(np.sqrt((step**2).sum()))
        if not drift:
            continue
        towards = old - (old[j] + new[j]) / 2
        apart = np.sqrt((towards**2).sum(axis=1))
        outside = apart > radius * (1 + ROOM)
        safe = np.where(outside, apart, 1.0)
        cosine = np.clip((towards @ step) / (safe * drift), -1.0, 1.0)
        angle = np.arccos(cosine) - np.arcsin(np.clip(radius / safe, 0.0, 1.0))
        nearer = np.where(outside, drift * np.maximum(np.cos(np.maximum(angle, 0.0)), 0.0), drift)
        nearer[j] = 0.0
        out = np.maximum(out, np.minimum(nearer * (1 + ROOM) + drift * 1e-7, drift * (1 + ROOM)))
    return out


def half_gaps(centroids: np.ndarray) -> np.ndarray:
    """Half the distance of each centroid to the nearest other one."""
    gaps = np.sqrt(np.maximum(squares(centroids, centroids), 0).astype(np.float64))
    np.fill_diagonal(gaps, np.inf)
    return gaps.min(axis=1) / 2


def squares(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all vectors to all centroids."""
    out = np.empty((len(vectors), len(centroids)), dtype=np.int64)
    for j, c in enumerate(centroids):
        apart = vectors.astype(np.int64) - c.astype(np.int64)
        out[:, j] = (apart * apart).sum(axis=1)
    return out


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 + ROOM)).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 - ROOM)).astype(np.float32), np.float32(-np.inf))


def first_bounds(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Clusters, upper and lower bounds after an exact scan."""
    if not len(vectors):
        return np.empty(0, np.int32), np.empty(0, np.float32), np.empty(0, np.float32)
    apart = squares(vectors, centroids)
    nearest = apart.argmin(axis=1).astype(np.int32)
    rows = np.arange(len(vectors))
    upper = _up(np.sqrt(apart[rows, nearest].astype(np.float64)))
    if apart.shape[1] == 1:
        return nearest, upper, np.full(len(vectors), np.inf, dtype=np.float32)
    apart[rows, nearest] = np.iinfo(np.int64).max
    return nearest, upper, _down(np.sqrt(apart.min(axis=1).astype(np.float64)))


def tightened(
    vectors: np.ndarray, held: tuple[np.ndarray, np.ndarray, np.ndarray], centroids: np.ndarray, drift: np.ndarray, loosened: np.ndarray, gaps: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Clusters and bounds after a move of the centroids, and how many vectors were scanned."""
    clusters, upper, lower = (x.copy() for x in held)
    upper = _up(upper.astype(np.float64) + drift[clusters])
    lower = _down(lower.astype(np.float64) - loosened[clusters])
    sure = np.maximum(lower.astype(np.float64), gaps[clusters] * (1 - ROOM))
    doubtful = np.flatnonzero(upper >= sure)
    clusters[doubtful], upper[doubtful], lower[doubtful] = first_bounds(vectors[doubtful], centroids)
    return clusters, upper, lower, len(doubtful)


def usable(vectors: DataFrame, key: str, vector: str, dimension: int, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of every vector that takes part, as ints."""
    x = F.col("x").cast("array<double>")
    good = (F.size("x") == dimension) & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.floor(c * scale) > -LARGEST) & (F.floor(c * scale) < LARGEST)
    )
    named = vectors.select(vectors[key].cast("long").alias("id"), vectors[vector].alias("x")).filter(good)
    return named.select("id", F.transform(x, lambda c: F.floor(c * scale).cast("int")).alias("v"))


def starts(chosen: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors of the `k` smallest SHA-256 of `seed:key`, in that order."""
    hashed = chosen.filter(F.col("id").isNotNull()).withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256))
    return np.array([r["v"] for r in hashed.orderBy("h", "v").limit(k).collect()], dtype=np.int64)


class Blocks:
    """The vectors in a bucketed table, and the narrow tables of clusters and bounds that go with it."""

    def __init__(self, chosen: DataFrame, dimension: int):
        self.spark = chosen.sparkSession
        self.dimension = dimension

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for begin in range(0, batch.num_rows, BLOCK_ROWS):
                    part = batch.slice(begin, BLOCK_ROWS)
                    ids = part.column("id")
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("row").slice(0, 1),
                            pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                            pa.array([part.column("v").flatten().to_numpy().astype("<i4").tobytes()], pa.binary()),
                        ],
                        names=["block", "ids", "vectors"],
                    )

        rows = chosen.count()
        size = rows * dimension * 4
        cores = self.spark.sparkContext.defaultParallelism
        self.buckets = int(min(MOST_BUCKETS, max(size // BUCKET_BYTES, min(cores, rows // BLOCK_ROWS), 1)))
        numbered = chosen.select("id", "v", F.monotonically_increasing_id().alias("row"))
        packed = numbered.mapInArrow(pack, BLOCKS)
        self.vectors = stored_by(packed.repartition(self.buckets, "block"), "block", self.buckets, "blocks")

    def with_state(self, state: DataFrame) -> DataFrame:
        """Blocks beside their clusters and bounds, each where it lies."""
        return self.vectors.join(state.hint("shuffle_hash"), "block")


def _unpack(batch: pa.RecordBatch, row: int, dimension: int) -> np.ndarray:
    return np.frombuffer(batch.column("vectors")[row].as_py(), dtype="<i4").reshape(-1, dimension)


def _held(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kinds = (("clusters", "<i4"), ("upper", "<f4"), ("lower", "<f4"))
    return tuple(np.frombuffer(batch.column(name)[row].as_py(), dtype=kind) for name, kind in kinds)


class Moves:
    """Per cluster of one task: vectors won less vectors lost, the sum of these, and the members' radius."""

    def __init__(self, k: int, dimension: int):
        self.count = np.zeros(k, dtype=np.int64)
        self.sums = np.zeros((k, dimension), dtype=np.int64)
        self.radius = np.full(k, -1.0)

    def add(self, vectors: np.ndarray, before: np.ndarray | None, after: np.ndarray, upper: np.ndarray) -> None:
        changed = np.arange(len(after)) if before is None else np.flatnonzero(before != after)
        for j in np.unique(after[changed]).tolist():
            rows = changed[after[changed] == j]
            self.count[j] += len(rows)
            self.sums[j] += vectors[rows].sum(axis=0, dtype=np.int64)
        if before is not None:
            for j in np.unique(before[changed]).tolist():
                rows = changed[before[changed] == j]
                self.count[j] -= len(rows)
                self.sums[j] -= vectors[rows].sum(axis=0, dtype=np.int64)
        np.maximum.at(self.radius, after, upper.astype(np.float64))

    def batch(self) -> pa.RecordBatch:
        k = len(self.count)
        empty = pa.nulls(k, pa.binary())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(k + 1) * self.sums.shape[1], pa.int32()), pa.array(self.sums.ravel()))
        values = [pa.nulls(k, pa.int64()), empty, empty, empty, pa.array(np.arange(k), pa.int32()), pa.array(self.count), lists, pa.array(self.radius)]
        return pa.RecordBatch.from_arrays(values, names=[x.split()[0] for x in MOVES.split(", ")])


def _state_batch(block: pa.Scalar, clusters: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> pa.RecordBatch:
    packed = [clusters.astype("<i4").tobytes(), upper.astype("<f4").tobytes(), lower.astype("<f4").tobytes()]
    values = [pa.array([block.as_py()], pa.int64()), *(pa.array([x], pa.binary()) for x in packed)]
    values += [pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.float64())]
    return pa.RecordBatch.from_arrays(values, names=[x.split()[0] for x in MOVES.split(", ")])


def _states(stored: DataFrame) -> DataFrame:
    return stored.filter("block is not null").select("block", "clusters", "upper", "lower")


def _assign(blocks: Blocks, state: DataFrame | None, centroids: np.ndarray, moved: tuple | None) -> tuple[DataFrame, list]:
    """One pass: the stored state that follows, and for each (cluster, axis) the part of the sum, vectors won, and radius."""
    dimension, spark = blocks.dimension, blocks.spark
    shared = spark.sparkContext.broadcast((centroids, moved))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, moved = shared.value
        seen = Moves(len(centroids), dimension)
        for batch in batches:
            for row in range(batch.num_rows):
                vectors = _unpack(batch, row, dimension)
                if moved is None:
                    before, found = None, first_bounds(vectors, centroids)
                else:
                    held = _held(batch, row)
                    before, found = held[0], tightened(vectors, held, centroids, *moved)[:3]
                seen.add(vectors, before, found[0], found[1])
                yield _state_batch(batch.column("block")[row], *found)
        yield seen.batch()

    source = blocks.vectors if state is None else blocks.with_state(_states(state))
    both = stored_by(source.drop("ids").mapInArrow(run, MOVES), "block", blocks.buckets, "state")
    sums = both.filter("cluster is not null").select("cluster", "moved", "radius", F.posexplode("sums").alias("axis", "part"))
    # k x dimension rows come back: the centroids themselves.
    found = sums.groupBy("cluster", "axis").agg(F.sum("part").alias("part"), F.sum("moved").alias("moved"), F.max("radius").alias("radius"))
    return both, found.collect()


def fit(chosen: DataFrame, k: int, rounds: int, dimension: int, seed: int) -> tuple[Blocks, DataFrame | None, np.ndarray]:
    """The stored blocks, their clusters under the last centroids, and these centroids."""
    blocks = Blocks(chosen, dimension)
    centroids = starts(chosen, k, seed)
    if not len(centroids):
        return blocks, None, centroids
    count = np.zeros(len(centroids), dtype=np.int64)
    sums = np.zeros((len(centroids), dimension), dtype=object)
    state, moved = None, None
    for turn in range(rounds + 1):
        before = state
        state, found = _assign(blocks, before, centroids, moved)
        drop_stored(before)
        radius = np.zeros(len(centroids))
        for r in found:
            sums[r["cluster"], r["axis"]] += r["part"]
            if not r["axis"]:
                count[r["cluster"]] += r["moved"]
                radius[r["cluster"]] = max(r["radius"], 0.0)
        if turn == rounds:
            break
        old = centroids
        centroids = np.array([[int(s) // int(n) for s in row] if n else c.tolist() for row, n, c in zip(sums, count, old)], dtype=np.int64)
        drift = np.sqrt(((centroids - old).astype(np.float64) ** 2).sum(axis=1)) * (1 + ROOM)
        moved = (drift, loosening(old.astype(np.float64), centroids.astype(np.float64), radius), half_gaps(centroids))
    return blocks, state, centroids


def cluster(
    vectors: DataFrame,
    k: int = 8,
    rounds: int = 10,
    key: str = "vec_id",
    vector: str = "embedding",
    dimension: int = 64,
    scale: int = 1024,
    seed: int = 3,
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part.

    Centroids start as the `k` vectors with the smallest SHA-256 of `seed:key`; each round
    assigns every vector to the nearest one and moves every centroid to the floor of its
    vectors' mean; then vectors are assigned once more. `distance` is squared.
    """
    spark = vectors.sparkSession
    blocks, state, centroids = fit(usable(vectors, key, vector, dimension, scale), k, rounds, dimension, seed)
    if state is None:
        drop_stored(blocks.vectors)
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    shared = spark.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                found = np.frombuffer(batch.column("clusters")[row].as_py(), dtype="<i4")
                apart = _unpack(batch, row, dimension).astype(np.int64) - shared.value[found]
                ids = batch.column("ids").slice(row, 1).flatten()
                yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.int32()), pa.array((apart * apart).sum(axis=1))], names=["vec_id", "cluster", "distance"])

    found = materialize(blocks.with_state(_states(state)).select("ids", "vectors", "clusters").mapInArrow(run, "vec_id long, cluster int, distance long"), "clustered")
    drop_stored(state, blocks.vectors)
    totals = {r["cluster"]: r["total"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    inertia = sum(totals.values())
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    rows = [(j, totals[j], inertia, digest(centroids[j])) for j in sorted(totals)]
    names = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(names), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
