"""Joins and rankings that hold when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 * 1024 * 1024
ROWS_PER_TASK = 1_000_000


def measured_bytes(df: DataFrame) -> int:
    """Size of the rows of `df` as text; one pass, one number to the driver."""
    row = df.select(F.octet_length(F.to_json(F.struct("*"))).alias("n")).agg(F.sum("n")).first()
    return int(row[0] or 0)


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    return measured_bytes(df) <= limit


def keep_matching(big: DataFrame, keys: DataFrame, on: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Rows of `big` whose `on` occurs in `keys`.

    As long as the distinct keys measure at most `limit` bytes they are sent to
    `big`, which is then filtered where it is read instead of being shuffled.
    """
    keys = keys.select(on).distinct()
    if fits_broadcast(keys, limit):
        keys = F.broadcast(keys)
    return big.join(keys, on, "left_semi")


def drop_matching(big: DataFrame, keys: DataFrame, on: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Rows of `big` whose `on` does not occur in `keys`, by the same way as `keep_matching`."""
    keys = keys.select(on).distinct()
    if fits_broadcast(keys, limit):
        keys = F.broadcast(keys)
    return big.join(keys, on, "left_anti")


def hot_keys(counts: DataFrame, count_col: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Keys with more than `rows_per_task` rows and how many tasks each should use.

    At most total / rows_per_task keys can qualify, so the result is small by
    construction and safe to broadcast.
    """
    splits = F.ceil(F.col(count_col) / rows_per_task).cast("int").alias("splits")
    keys = [c for c in counts.columns if c != count_col]
    return counts.filter(F.col(count_col) > rows_per_task).select(*keys, splits)


def salted_join(
    big: DataFrame, small: DataFrame, on: list[str], hot: DataFrame, spread_by: str
) -> DataFrame:
    """Inner equi-join in which a hot key of `big` is spread over several tasks.

    Rows of `big` under a hot key get a salt from `spread_by`; the matching rows
    of `small` are repeated once per salt. Other keys keep salt 0. `hot` comes
    from `hot_keys`.
    """
    hot = F.broadcast(hot)
    splits = F.coalesce(F.col("splits"), F.lit(1))
    left = (
        big.join(hot, on, "left")
        .withColumn("salt", F.pmod(F.xxhash64(spread_by), splits).cast("int"))
        .drop("splits")
    )
    right = (
        small.join(hot, on, "left")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), splits - 1)))
        .drop("splits")
    )
    return left.join(right, [*on, "salt"]).drop("salt")


def rank_within(
    df: DataFrame, key: str, order: str, out: str, rows_per_block: int = ROWS_PER_TASK
) -> DataFrame:
    """1-based position of each row within `key` by numeric, unique `order`.

    A plain window would sort all rows of a key in one task. Here `order` is cut
    at quantiles into blocks, rows are ranked within (key, block), and the sizes
    of the earlier blocks of the key are added. No task gets more than about
    `rows_per_block` rows of one key.
    """
    total = df.count()
    blocks = max(1, -(-total // rows_per_block))
    if blocks <= 1:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(key).orderBy(order)))
    grid = [i / blocks for i in range(1, blocks)]
    cuts = df.select(F.percentile_approx(F.col(order).cast("double"), grid, 10 * blocks)).first()[0]
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    cut = Bucketizer(splits=splits, inputCol="_order", outputCol="_block")
    blocked = cut.transform(df.withColumn("_order", F.col(order).cast("double"))).drop("_order")
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocked.groupBy(key, "_block")
        .agg(F.count("*").alias("_n"))
        .select(key, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    within = F.row_number().over(Window.partitionBy(key, "_block").orderBy(order))
    return (
        blocked.withColumn("_within", within)
        .join(offsets, [key, "_block"])
        .withColumn(out, (F.col("_within") + F.col("_before")).cast("int"))
        .drop("_block", "_within", "_before")
    )


def top_k(df: DataFrame, key: str, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first `k` rows per key. Catalyst cuts every input partition to `k` rows per
    key before the shuffle (WindowGroupLimit), so a hot key costs k rows per task."""
    position = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn(rank, position).filter(F.col(rank) <= k)
