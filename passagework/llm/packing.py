"""Packing of documents into training sequences of several permitted lengths.

Sizes are words. A document longer than the longest sequence is cut into full
sequences and a rest; every piece is then placed by best fit: among all open bins,
of whatever capacity, into the one it leaves the least room in. If it fits in none,
the bin is opened whose cost for each word that it is likely to hold is least: a
sequence of n words costs n plus n^2 / QUADRATIC (the share of attention), divided by
the words that the shard's unplaced pieces can put into it. At the end each bin is
cut down to the smallest permitted length that holds its contents.

Because sizes are whole numbers up to the longest length, a shard is packed over
counts of sizes: the pieces of one size are alike, and open bins are kept in lists by
room left. Shards hold about SHARD_PIECES pieces each, dealt out at random, so that no
group is large whatever the input, and their number follows from the table's. What
shards waste is one partly filled bin each for every permitted length.

Defined cases: a null or empty text has size 0 and shares a bin with others at no
cost; a null id is kept; repeated rows are pieces of their own; columns other than
those named are not read; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from passagework.llm.common import as_bytes, carried, text_slices
from passagework.session import materialize

LENGTHS = (256, 512, 1024, 2048, 4096)
QUADRATIC = 16_384
SHARD_PIECES = 50_000
#: Different sizes that are tried out to see how well a new bin would fill.
LOOK_AHEAD = 4


def cost(length: int) -> float:
    return length + length**2 / QUADRATIC


def pack(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each size, capacity of each bin); sizes are at most the longest length."""
    left = np.bincount(sizes, minlength=lengths[-1] + 1).tolist()
    # The largest size up to each number that occurs at all. Sizes are placed in
    # falling order, so all that are smaller than the present one are still there.
    occurs = np.where(np.array(left) > 0, np.arange(len(left)), 0)
    at_most = np.maximum.accumulate(occurs).tolist()

    def filled(length: int, size: int) -> int:
        """Words in a bin of this length if the largest pieces that fit followed."""
        room, reach = length - size, size if left[size] else size - 1
        for _ in range(LOOK_AHEAD):
            step = at_most[min(room, reach)] if min(room, reach) > 0 else 0
            if step <= 0:
                break
            room -= min(room // step, left[step]) * step
            reach = step - 1
        return length - room

    bins = np.empty(len(sizes), dtype=np.int64)
    used: list[int] = []
    open_bins: dict[int, list[int]] = {}
    rooms: list[int] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        left[size] -= 1
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            chosen = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room], rooms[at]
        else:
            room = min((n for n in lengths if n >= size), key=lambda n: cost(n) / max(filled(n, size), 1))
            chosen = len(used)
            used.append(0)
        used[chosen] += size
        bins[i] = chosen
        room -= size
        if room not in open_bins:
            open_bins[room] = []
            insort(rooms, room)
        open_bins[room].append(chosen)
    permitted = np.array(lengths)
    return bins, permitted[np.searchsorted(permitted, np.array(used, dtype=np.int64))]


def _sized(docs: DataFrame, columns: list[str], text: str) -> DataFrame:
    """`columns` of each row as the struct `row`, and its number of words."""
    chosen = docs.select(*carried(docs, columns, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, columns, text):
            n = [len(x.split()) for x in as_bytes(part.column("_text"))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64())], names=["row", "n_words"])

    return chosen.mapInArrow(run, StructType(chosen.schema[:1].fields).add("n_words", "long"))


def best_fit(docs: DataFrame, columns: list[str], text: str = "text", lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """A row for every piece: `columns` as the struct `row`, piece, first_word, size, bin_id and capacity.

    `bin_id` is "shard-bin"; pieces of a bin lie in the same shard.
    """
    longest = lengths[-1]
    sized = materialize(_sized(docs, columns, text), "pack-sizes")
    full = F.floor(F.greatest(F.col("n_words") - 1, F.lit(0)) / longest)
    pieces = sized.select("row", "n_words", F.posexplode(F.sequence(F.lit(0), full.cast("int"))).alias("piece", "_"))
    pieces = pieces.select(
        "row",
        "piece",
        (F.col("piece").cast("long") * longest).alias("first_word"),
        F.least(F.col("n_words") - F.col("piece").cast("long") * longest, F.lit(longest)).alias("size"),
    )
    total = pieces.agg(F.count("*")).first()[0]
    shards = max(1, -(-total // SHARD_PIECES))
    # Drawn at random, so that copies and repeated rows spread, too; written down before it is used.
    placed = materialize(pieces.withColumn("shard", F.floor(F.rand(7) * shards)), "pack-pieces")
    schema = StructType([*placed.schema.fields]).add("bin", "long").add("capacity", "integer")

    def run(group: pa.Table) -> pa.Table:
        bins, capacity = pack(group.column("size").to_numpy().astype(np.int64), lengths)
        found = group.append_column("bin", pa.array(bins))
        return found.append_column("capacity", pa.array(capacity[bins].astype(np.int32)))

    packed = placed.groupBy("shard").applyInArrow(run, schema)
    return packed.select("row", "piece", "first_word", "size", F.concat_ws("-", "shard", "bin").alias("bin_id"), "capacity")
