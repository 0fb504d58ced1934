"""Near duplicates over a stream, by a store of bands that is read where a micro-batch's own bands lie.

Of every kept document the band rows (bucket, id) go to folders by a hash of the bucket, and
its signature to folders by a hash of the id. A micro-batch opens the folders of its own
buckets, finds the kept documents it shares one with, opens the folders of these for their
signatures, and decides as if all earlier kept documents had been compared.

Each batch writes runs of its own. As soon as several runs are of one size class they are
written as one, so the files of a folder grow with the logarithm of the stream. The list of
runs is part of the batch; a batch counts once it is published.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.defaults import NEAR_THRESHOLD, PERMUTATIONS
from passagework.operators.dedup import keep_first
from passagework.operators.segments import MERGED, to_merge
from passagework.operators.signatures import bands
from passagework.operators.sizing import fits_broadcast
from passagework.session import discard, materialize
from passagework.sources.tables import publish, published, read_table, write_part

#: Folders that a run's rows are dealt into.
PARTS = 64
BAND_SCHEMA = "bucket bigint, id bigint, run bigint, part int"
SIGNED_SCHEMA = "id bigint, signature array<bigint>, run bigint, part int"
RUN_SCHEMA = "run bigint, documents bigint"
DECIDED_SCHEMA = "id bigint, match bigint, similarity double"


def part_of(key: str):
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


def live_runs(spark: SparkSession, root: str, before: int) -> dict[int, int]:
    """Runs and their documents after the last published batch below `before`; a few for each size class."""
    last = published(spark, root).filter(F.col("batch") < before).agg(F.max("batch")).first()[0]
    if last is None:
        return {}
    listed = read_table(spark, root, "runs", RUN_SCHEMA).filter(F.col("batch") == last)
    return {r["run"]: r["documents"] for r in listed.collect()}


def _read(spark: SparkSession, root: str, table: str, schema: str, runs, keys: DataFrame, key: str) -> DataFrame:
    """Rows of some runs whose `key` occurs in `keys`; only the folders that these keys fall into are opened."""
    parts = [r["part"] for r in keys.select(part_of(key).alias("part")).distinct().collect()]
    if not runs or not parts:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(f"{root}/{table}")
    rows = rows.filter(F.col("run").isin([int(r) for r in runs]) & F.col("part").isin(parts))
    wanted = keys.select(key).distinct()
    return rows.join(F.broadcast(wanted) if fits_broadcast(wanted) else wanted, key, "left_semi")


def _write(rows: DataFrame, root: str, table: str, run: int, key: str) -> None:
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("part", part_of(key)).repartition(tasks, "part", F.pmod(F.xxhash64("id"), F.lit(max(1, tasks // PARTS))))
    dealt.sortWithinPartitions("part", key).write.mode("overwrite").partitionBy("part").parquet(f"{root}/{table}/run={run}")


def earlier_like(spark: SparkSession, root: str, runs, own_bands: DataFrame) -> DataFrame:
    """(id, signature) of the kept documents that share a bucket with `own_bands(id, bucket)`."""
    met = _read(spark, root, "bands", BAND_SCHEMA, runs, own_bands, "bucket").select("id").distinct()
    met = materialize(met, "band-matches")
    return _read(spark, root, "signed", SIGNED_SCHEMA, runs, met, "id").select("id", "signature")


def near_batch(rows: DataFrame, batch: int, root: str, threshold: float = NEAR_THRESHOLD, permutations: int = PERMUTATIONS) -> None:
    """Decide `rows(id, signature)` of one micro-batch; ids are in the order of arrival.

    Only lower batch ids are looked at, and doing it again replaces what it wrote. A document
    without a signature is kept and matches nothing.
    """
    spark = rows.sparkSession
    rows = materialize(rows.select("id", "signature"), "signed-batch")
    runs = live_runs(spark, root, batch)
    own = materialize(bands(rows.filter("signature is not null"), "id", permutations, threshold), "own-bands")
    seeds = materialize(earlier_like(spark, root, runs, own), "seeds")
    decided = materialize(keep_first(rows, threshold, permutations, seeds), "near-decided")
    write_part(decided.select("id", "match", "similarity"), root, "near", batch)
    kept = decided.filter("match is null").select("id")
    # A copy of a kept signature finds the kept document by it, so one row of each suffices.
    _write(own.join(kept, "id", "left_semi"), root, "bands", batch, "bucket")
    signed = rows.filter("signature is not null").join(kept, "id", "left_semi")
    _write(signed, root, "signed", batch, "id")
    if size := spark.read.schema("id bigint").parquet(f"{root}/signed/run={batch}").count():
        runs[batch] = size
    together = to_merge(runs)
    if together:
        merged = MERGED + batch
        for table, schema, key in (("bands", BAND_SCHEMA, "bucket"), ("signed", SIGNED_SCHEMA, "id")):
            whole = spark.read.schema(schema).parquet(f"{root}/{table}").filter(F.col("run").isin([int(r) for r in together]))
            _write(whole.drop("run", "part"), root, table, merged, key)
        runs = {r: n for r, n in runs.items() if r not in together} | {merged: sum(runs[r] for r in together)}
    write_part(spark.createDataFrame([(r, int(n)) for r, n in runs.items()], RUN_SCHEMA), root, "runs", batch)
    publish(spark, root, batch)
    discard(rows, own, seeds, decided)


def start_near(signed: DataFrame, root: str, checkpoint: str, **options):
    """Run `near_batch` for every micro-batch of a stream of (id, signature)."""
    writer = signed.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(lambda rows, batch: near_batch(rows, batch, root, **options)).start()


def near_decisions(spark: SparkSession, root: str) -> DataFrame:
    """(id, match, similarity) of everything decided; `match` is null for kept documents."""
    return read_table(spark, root, "near", DECIDED_SCHEMA).drop("batch")
