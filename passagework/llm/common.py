"""Helpers shared by the operators: Arrow slices bounded in bytes, folds, and stored intermediate tables."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.session import discard, scratch_path

SLICE_BYTES = 2 << 20


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")), F.lit(0)) % parts


def carried(docs: DataFrame, columns: list[str], text: str) -> list[Column]:
    """`columns` as the struct `row`, and the text as `_text` unless it is one of them.

    In the struct names cannot clash with those of an operator, and no text is sent twice.
    """
    row = F.struct(*[docs[c] for c in columns] or [F.lit(0).alias("none")]).alias("row")
    return [row] if text in columns else [row, docs[text].alias("_text")]


def text_slices(batches: Iterator[pa.RecordBatch], columns: list[str], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """`slices` of batches as `carried` makes them; each has `_text`."""

    def with_text() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if text in columns:
                names = [*batch.schema.names, "_text"]
                batch = pa.RecordBatch.from_arrays([*batch.columns, batch.column("row").field(columns.index(text))], names=names)
            yield batch

    return slices(with_text(), "_text", limit)


def give_back() -> None:
    """Return freed memory to the system: workers live on, and share their executor with others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def drop_shuffles(spark: SparkSession) -> None:
    """Have the shuffle files of plans that are over deleted now, not when the driver next collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that `column` has about `limit` bytes in each; one long row stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        groups = (np.cumsum(sizes, dtype=np.int64) - sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:]):
            yield batch.slice(begin, end - begin)
        give_back()


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def numbering() -> defaultdict:
    """A dictionary that numbers what it is asked for, in order of appearance."""
    found: defaultdict = defaultdict()
    found.default_factory = found.__len__
    return found


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Exclusive prefix sums, with the total as last entry."""
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def sums_between(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of `values` within consecutive bounds; empty ranges give 0."""
    total = np.zeros(len(values) + 1, dtype=values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def stored_by(df: DataFrame, key: str, buckets: int, label: str) -> DataFrame:
    """A table in the shared folder, bucketed by `key`: two such tables of as many buckets are joined without a shuffle.

    It has a name of its own in the session's catalog until `drop_stored`.
    """
    spark = df.sparkSession
    path, name = scratch_path(spark, label), f"passagework_{label.replace('-', '_')}_{uuid.uuid4().hex}"
    df.write.option("path", path).bucketBy(buckets, key).saveAsTable(name)
    stored = spark.table(name)
    stored.scratch, stored.listed = path, name
    return stored


def drop_stored(*tables: DataFrame | None) -> None:
    """Forget tables of `stored_by` that nothing reads any more, and delete their files."""
    for stored in tables:
        if stored is not None:
            stored.sparkSession.sql(f"DROP TABLE {stored.listed}")
            discard(stored)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
