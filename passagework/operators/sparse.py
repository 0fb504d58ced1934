"""BM25 over postings stored by term, for a table of queries.

Chunks are dealt into ranges of at most RANGE_ROWS. A range has a block for each term, with
the postings and what bounds their gain (the largest count, the smallest length), and a head
with chunk ids and lengths. Most terms are rare, so a row of the store holds all blocks of a
range whose terms share a hash. Rows lie in folders by that hash, so a search opens only the
folders of its terms; from their rows it takes its own blocks before anything is shuffled.

A search is exact. The wanted blocks are dealt out by range, and a task goes through its
ranges one after the other as NumPy arrays: from the bounds of a range's blocks it knows
how high any chunk there can score for a query, and only the queries whose best `k` so far
this could change are scored; only the best `k` per task and query leave it.

A store consists of immutable segments, one per batch, and tombstones (`segments`).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, LongType, StructType

from passagework.defaults import BM25_B, BM25_EPSILON, BM25_K1, RANK_DIGITS, SPARSE_TOP_K
from passagework.functions.text import term_counts, tokenize, words
from passagework.functions.vectors import byte_values, word_lists
from passagework.operators.blocks import SCORES_AT_ONCE, BestK, result_types
from passagework.operators.sizing import BROADCAST_BYTES, top_k
from passagework.session import CODEC, materialize, scratch_path

#: Chunks of one range.
RANGE_ROWS = 4_096
#: Folders that the terms of a segment are dealt into; head rows have one of their own.
BUCKETS = 32
HEADS = -1
#: More than the rounding of a sum of gains.
ROOM = 1e-6

def bags(chunks: DataFrame, text: str = "text", chunk: str = "chunk_id") -> DataFrame:
    """(chunk_id, len, bag MAP<term, tf>): one row per chunk, counted inside the row."""
    rows = chunks.select(F.col(chunk).alias("chunk_id"), tokenize(F.col(text)).alias("tokens"))
    return rows.select("chunk_id", F.size("tokens").alias("len"), term_counts(F.col("tokens")).alias("bag"))


def postings(bagged: DataFrame) -> DataFrame:
    """(chunk_id, term, tf)."""
    return bagged.select("chunk_id", F.explode("bag").alias("term", "tf"))


def document_frequency(bagged: DataFrame) -> DataFrame:
    """(term, df); partial counts are combined before the shuffle."""
    terms = bagged.select(F.explode(F.map_keys("bag")).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(bagged: DataFrame) -> DataFrame:
    """One row: n_chunks, avg_len."""
    return bagged.agg(
        F.count("*").alias("n_chunks"), F.avg("len").alias("avg_len")
    )


def inverse_frequency(
    frequency: DataFrame, stats: DataFrame, epsilon: float = BM25_EPSILON
) -> DataFrame:
    """(term, df, idf): ln((N - df + .5) / (df + .5)); terms below zero get `epsilon`
    times the mean over the vocabulary instead."""
    total = stats.select("n_chunks").scalar()
    raw = frequency.withColumn(
        "raw", F.log(total - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    )
    floor = raw.agg((F.avg("raw") * epsilon).alias("floor")).scalar()
    return raw.select("term", "df", F.when(F.col("raw") < 0, floor).otherwise(F.col("raw")).alias("idf"))


def bucket_of(term: Column) -> Column:
    return (F.crc32(term.cast("binary")) % BUCKETS).cast("int")


def buckets_of(terms: pa.Array) -> np.ndarray:
    """`bucket_of` in a task."""
    return np.array([zlib.crc32(t) for t in byte_values(terms)], dtype=np.int64) % BUCKETS


def file_schema(chunk_type: DataType) -> StructType:
    """Columns of a segment's rows; `bucket` names their folder."""
    own = StructType.fromDDL(
        "range bigint, bucket int, n int, words bigint, terms array<string>, counts array<int>, mosts array<int>, "
        "leasts array<int>, slots binary, tfs binary, lens binary"
    )
    return own.add("ids", ArrayType(chunk_type))


def store_schema(chunk_type: DataType) -> StructType:
    """Columns of heads and blocks."""
    own = StructType.fromDDL("range bigint, term string, n int, words bigint, most int, least int, slots binary, tfs binary, lens binary")
    return own.add("ids", ArrayType(chunk_type))


# How the numbers of a block are packed; a range has at most 65,536 slots.
SLOT, COUNT = "<u2", "<u4"


def packed(values: np.ndarray, offsets: np.ndarray, kind: str) -> pa.Array:
    """A binary array of the runs of `values` between `offsets`."""
    data = values.astype(kind)
    places = (offsets * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(places), pa.py_buffer(data)])


def joined(column: pa.Array) -> pa.Buffer:
    """The bytes of all values of a binary array, which lie one after the other, without a copy."""
    if not len(column):
        return pa.py_buffer(b"")
    _, places, data = column.buffers()
    places = np.frombuffer(places, dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return pa.py_buffer(b"") if data is None else data.slice(int(places[0]), int(places[-1] - places[0]))


def unpacked(column: pa.Array, kind: str) -> np.ndarray:
    """All numbers of a binary array, one after the other."""
    return np.frombuffer(joined(column), dtype=kind).astype(np.int64)


def _inverted(part: pa.RecordBatch, size: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Head and blocks of one range, whose number is that of its first chunk."""
    tokens = word_lists(part.column("words"))
    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    named = tokens.flatten().dictionary_encode()
    code = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    keys, tfs = np.unique(code * size + np.repeat(np.arange(part.num_rows), lengths), return_counts=True)
    found = keys // size, keys % size, tfs
    yield from range_rows(part.column("at")[0].as_py(), part.column("chunk_id"), lengths, named.dictionary, *found, schema)


def range_rows(
    number: int, ids: pa.Array, lengths: np.ndarray, terms: pa.Array, code: np.ndarray, slots: np.ndarray, tfs: np.ndarray, schema: pa.Schema
) -> Iterator[pa.RecordBatch]:
    """The head row of a range, and a block for each term; postings come as (term's place in `terms`, slot, tf)."""
    whole = pa.array([0, len(ids)], pa.int32())
    head = {"range": [number], "n": [len(ids)], "words": [int(lengths.sum())]}
    head |= {"ids": pa.ListArray.from_arrays(whole, ids), "lens": packed(lengths, np.array([0, len(ids)]), COUNT)}
    yield _filled(head, 1, schema)
    if not len(code):
        return
    order = np.lexsort((slots, code))
    code, slots, tfs = code[order], slots[order], tfs[order]
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    offsets = np.append(starts, len(code))
    blocks = {
        "range": np.full(len(starts), number),
        "term": terms.take(pa.array(code[starts])),
        "n": np.diff(offsets),
        "most": np.maximum.reduceat(tfs, starts),
        "least": np.minimum.reduceat(lengths[slots], starts),
        "slots": packed(slots, offsets, SLOT),
        "tfs": packed(tfs, offsets, COUNT),
    }
    yield _filled(blocks, len(starts), schema)


# A row of the store has the lists of these columns of its blocks.
BLOCK_SCHEMA = "batch bigint, range bigint, term string, n int, most int, least int, slots binary, tfs binary"
LISTS = {"terms": "term", "counts": "n", "mosts": "most", "leasts": "least"}
RUNS = {"slots": SLOT, "tfs": COUNT}


def bundled(rows: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of the store from the head and the blocks of one range, as `range_rows` gives them."""
    head = next(rows)
    own = {c: head.column(c) for c in ("range", "n", "words", "lens", "ids")}
    yield _filled(own | {"bucket": [HEADS]}, 1, schema)
    for blocks in rows:
        folder = buckets_of(blocks.column("term"))
        order = np.argsort(folder, kind="stable")
        blocks, folder = blocks.take(pa.array(order)), folder[order]
        starts = np.flatnonzero(np.diff(folder, prepend=-1))
        edges = np.append(starts, len(folder))
        columns = {"range": blocks.column("range").take(pa.array(starts)), "bucket": folder[starts]}
        for name, one in LISTS.items():
            columns[name] = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), blocks.column(one))
        postings = np.concatenate(([0], np.cumsum(blocks.column("n").to_numpy())))
        for name, kind in RUNS.items():
            columns[name] = _cut(blocks.column(name), postings[edges], kind)
        yield _filled(columns, len(starts), schema)


def unbundled(rows: pa.RecordBatch) -> pa.RecordBatch:
    """(batch, range, term, n, most, least, slots, tfs): the blocks of some rows of the store."""
    sizes = rows.column("terms").value_lengths().to_numpy()
    at = pa.array(np.repeat(np.arange(rows.num_rows), sizes))
    columns = {c: rows.column(c).take(at) for c in ("batch", "range")}
    columns |= {one: rows.column(name).flatten() for name, one in LISTS.items()}
    postings = np.concatenate(([0], np.cumsum(columns["n"].to_numpy())))
    columns |= {name: _cut(rows.column(name), postings, kind) for name, kind in RUNS.items()}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _cut(column: pa.Array, postings: np.ndarray, kind: str) -> pa.Array:
    """The bytes of a binary array, cut anew at these numbers of values."""
    places = (postings * np.dtype(kind).itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(places) - 1, [None, pa.py_buffer(places), joined(column)])


def _filled(columns: dict, rows: int, schema: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for field in schema:
        values = columns.get(field.name)
        if values is None:
            arrays.append(pa.nulls(rows, field.type))
        else:
            arrays.append(values.cast(field.type) if isinstance(values, pa.Array) else pa.array(values, field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def invert(texts: DataFrame) -> DataFrame:
    """Store rows of `texts(chunk_id, words)`: every task inverts the chunks it reads."""
    chunk_type = texts.schema["chunk_id"].dataType
    schema = file_schema(chunk_type)
    blocks, arrow = (pa.schema([(f.name, to_arrow_type(f.dataType)) for f in s]) for s in (store_schema(chunk_type), schema))
    size = RANGE_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, size):
                yield from bundled(_inverted(batch.slice(begin, size), size, blocks), arrow)

    return texts.select("chunk_id", "words", F.monotonically_increasing_id().alias("at")).mapInArrow(run, schema)


def _tasks(df: DataFrame) -> int:
    """Tasks of a costly step, which must not be merged for their few bytes."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def write_segment(texts: DataFrame, path: str) -> None:
    """Write the store of `texts(chunk_id, words)`; every posting is shuffled once."""
    write_rows(invert(texts), path)


def write_rows(rows: DataFrame, path: str) -> None:
    """Store rows in folders by a hash of the term, sorted by range.

    Ranges are spread over several files of a folder; their number follows the session's shuffle partitions.
    """
    tasks = _tasks(rows)
    files = max(1, tasks // BUCKETS)
    dealt = rows.repartition(tasks, "bucket", F.pmod(F.xxhash64("range"), F.lit(files)))
    ordered = dealt.sortWithinPartitions("bucket", "range")
    ordered.write.mode("overwrite").option("compression", CODEC).partitionBy("bucket").parquet(path)


@dataclass(frozen=True)
class SparseIndex:
    """Store rows with their `batch` and `bucket`, dead slots by range, inverse frequencies, one row of statistics."""

    rows: DataFrame
    terms: DataFrame
    stats: DataFrame
    dead: DataFrame | None = None


def counted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, df) and one row (n_chunks, words) of store rows, without reading a posting."""
    listed = rows.filter(F.col("bucket") != HEADS).select(F.inline(F.arrays_zip("terms", "counts")))
    frequency = listed.groupBy(F.col("terms").alias("term")).agg(F.sum("counts").alias("df"))
    heads = rows.filter(F.col("bucket") == HEADS)
    return frequency, heads.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_chunks"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")
    )


def index_of(rows: DataFrame, frequency: DataFrame, totals: DataFrame, dead: DataFrame | None = None) -> SparseIndex:
    """The index over store rows; the vocabulary is summed once and written down."""
    stats = totals.select("n_chunks", (F.col("words") / F.nullif("n_chunks", F.lit(0))).alias("avg_len"))
    return SparseIndex(rows, inverse_frequency(materialize(frequency, "terms"), stats), stats, dead)


def build_index(chunks: DataFrame, text: str = "text", chunk: str = "chunk_id") -> SparseIndex:
    """An index of one segment over `chunks`, in the shared folder."""
    return index_words(chunks.select(F.col(chunk).alias("chunk_id"), words(F.col(text)).alias("words")))


def index_words(texts: DataFrame) -> SparseIndex:
    spark, path = texts.sparkSession, scratch_path(texts.sparkSession, "postings")
    write_segment(texts, f"{path}/batch=0")
    rows = read_store(spark, path, texts.schema["chunk_id"].dataType)
    return index_of(rows, *counted(rows))


def read_store(spark: SparkSession, path: str, chunk_type: DataType) -> DataFrame:
    return spark.read.schema(file_schema(chunk_type).add("batch", LongType())).parquet(path)


def append(old: DataFrame, added: DataFrame) -> DataFrame:
    """Bags after adding chunks; an id that is already there is replaced."""
    return old.join(added.select("chunk_id"), "chunk_id", "left_anti").unionByName(added)


def merge_frequency(old: DataFrame, added: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """Document frequencies after a change, from the old ones and those of the delta only."""
    delta = old.unionByName(added)
    if removed is not None:
        delta = delta.unionByName(removed.select("term", (-F.col("df")).alias("df")))
    return delta.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")


def query_terms(queries: DataFrame, text: str = "text") -> DataFrame:
    """(qid, term, qtf): a repeated token counts each time."""
    bag = term_counts(tokenize(F.col(text)))
    return queries.select("qid", F.explode(bag).alias("term", "qtf"))


def _gain(tf, length, average):
    """Saturating weight of a term count in a chunk of the given length."""
    return tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / average))


class _Weights:
    """Query weights grouped by term."""

    def __init__(self, rows: list, average: float) -> None:
        self.average = average
        self.qids = sorted({row["qid"] for row in rows})
        place = {qid: i for i, qid in enumerate(self.qids)}
        rows = sorted(rows, key=lambda row: row["term"])
        terms, starts = np.unique([row["term"] for row in rows], return_index=True)
        self.terms = terms.tolist()
        self.starts = np.append(starts, len(rows))
        self.queries = np.array([place[row["qid"]] for row in rows], dtype=np.int64)
        self.weights = np.array([row["weight"] for row in rows], dtype=np.float64)

    def entries(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each term in turn its (query, weight) entries: which of `term`, and which entry."""
        times = self.starts[term + 1] - self.starts[term]
        entry = np.repeat(self.starts[term] - np.cumsum(times) + times, times) + np.arange(times.sum())
        return np.repeat(np.arange(len(term)), times), entry

    def bounds(self, term: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
        """What no chunk with these blocks can exceed, per query."""
        block, entry = self.entries(term)
        gain = _gain(most, least, self.average)[block] * np.maximum(self.weights[entry], 0)
        return np.bincount(self.queries[entry], gain, minlength=len(self.qids))

    def scores(self, wanted: np.ndarray, term: np.ndarray, sizes: np.ndarray, slots: np.ndarray, tfs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(wanted queries x chunks) over the postings of some blocks; -inf where no score is positive."""
        gain = _gain(tfs, lengths[slots], self.average)
        block = np.repeat(np.arange(len(term)), sizes)
        row = np.full(len(self.qids), -1)
        row[wanted] = np.arange(len(wanted))
        posting, entry = self.entries(term[block])
        asked = row[self.queries[entry]] >= 0
        posting, entry = posting[asked], entry[asked]
        cells = row[self.queries[entry]] * len(lengths) + slots[posting]
        flat = np.bincount(cells, gain[posting] * self.weights[entry], minlength=len(wanted) * len(lengths))
        scored = np.round(flat.reshape(len(wanted), len(lengths)), RANK_DIGITS)
        return np.where(scored > 0, scored, -np.inf)


def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one range at a time, from batches sorted by batch and range."""
    waiting: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("batch", "range")])
        cuts = [0, *(np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:]):
            if begin < end:
                own = (int(keys[0, begin]), int(keys[1, begin]))
                if own != last and waiting:
                    yield pa.concat_batches(waiting)
                    waiting = []
                last = own
                waiting.append(batch.slice(begin, end - begin))
    if waiting:
        yield pa.concat_batches(waiting)


class RangeSearch:
    """The best `k` chunks of each query among the ranges gone through so far."""

    def __init__(self, asked: _Weights, k: int) -> None:
        self.asked, self.k = asked, k
        self.vocabulary = pa.array(asked.terms, pa.string())
        self.best = BestK(len(asked.qids), k)
        self.least = np.full(len(asked.qids), -np.inf)
        self.scored = 0

    def add(self, rows: pa.RecordBatch) -> None:
        """Offer the head and the wanted blocks of one range."""
        is_head = pc.is_null(rows.column("term"))
        head, blocks = rows.filter(is_head), rows.filter(pc.invert(is_head))
        term = pc.index_in(blocks.column("term"), value_set=self.vocabulary).to_numpy()
        bounds = self.asked.bounds(term, blocks.column("most").to_numpy(), blocks.column("least").to_numpy())
        wanted = np.flatnonzero((bounds > 0) & (bounds + ROOM >= self.least))
        if not len(wanted):
            return
        self.scored += len(wanted)
        ids = np.array(head.column("ids")[0].as_py(), dtype=object)
        lengths = unpacked(head.column("lens"), COUNT)
        gone = head.column("gone")[0].as_py() or []
        slots, tfs = unpacked(blocks.column("slots"), SLOT), unpacked(blocks.column("tfs"), COUNT)
        sizes = blocks.column("n").to_numpy()
        step = max(1, SCORES_AT_ONCE // len(ids))
        for begin in range(0, len(wanted), step):
            own = wanted[begin : begin + step]
            scores = self.asked.scores(own, term, sizes, slots, tfs, lengths)
            scores[:, gone] = -np.inf
            self.best.add(ids, scores, own)
        for query in wanted.tolist():
            held = self.best.scores[query]
            if len(held) == self.k:
                self.least[query] = held[-1]


def bm25_topk(
    index: SparseIndex,
    queries: DataFrame,
    k: int = SPARSE_TOP_K,
    text: str = "text",
    query_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(qid, chunk_id, score, rank, origin) of the `k` best chunks with a positive score.

    The weights of the queries are sent to the tasks, `query_bytes` of them at a time.
    """
    weighted = query_terms(queries, text).join(index.terms, "term").select(
        "qid", "term", (F.col("qtf") * F.col("idf")).alias("weight"), bucket_of(F.col("term")).alias("bucket")
    )
    weighted = materialize(weighted, "query-weights")
    size = weighted.agg(F.sum(F.octet_length("term") + 32)).first()[0] or 0
    parts = -(-size // query_bytes)
    types = result_types(queries, index.rows.select(F.get("ids", F.lit(0)).alias("chunk_id")))
    found = queries.sparkSession.createDataFrame([], types[0])
    for part in range(parts):
        own = weighted.filter(F.pmod(F.xxhash64("qid"), F.lit(parts)) == part)
        found = found.unionByName(_search(index, own.collect(), k, types))
    best = top_k(found, "qid", [F.desc("score"), F.col("chunk_id")], k)
    return best.withColumn("origin", F.lit("sparse"))


def wanted_blocks(index: SparseIndex, terms: dict[str, int]) -> DataFrame:
    """The blocks of some terms, given with their buckets; only these folders are read."""
    own = index.rows.filter(F.col("bucket").isin(sorted(set(terms.values()))))
    sent = index.rows.sparkSession.sparkContext.broadcast(sorted(terms))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(sent.value, pa.string())
        for batch in batches:
            blocks = unbundled(batch)
            yield blocks.filter(pc.is_in(blocks.column("term"), value_set=wanted))

    return own.select("batch", "range", *LISTS, *RUNS).mapInArrow(pick, BLOCK_SCHEMA)


def _search(index: SparseIndex, rows: list, k: int, types: tuple) -> DataFrame:
    """The best `k` chunks of every task for the queries of one slice, given by their weights."""
    spark = index.rows.sparkSession
    schema, qid_type, id_type = types
    if not rows:
        return spark.createDataFrame([], schema)
    sent = spark.sparkContext.broadcast(_Weights(rows, index.stats.first()["avg_len"]))
    found = wanted_blocks(index, {r["term"]: r["bucket"] for r in rows})
    missing = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("term", "most", "least")]
    heads = index.rows.filter(F.col("bucket") == HEADS).select("batch", "range", "n", "slots", "tfs", "ids", "lens", *missing)
    none = F.lit(None).cast("array<int>").alias("gone")
    heads = heads.withColumn("gone", none) if index.dead is None else heads.join(index.dead, ["batch", "range"], "left")
    both = heads.unionByName(found.withColumn("gone", none), allowMissingColumns=True)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = RangeSearch(sent.value, k)
        for own in by_range(batches):
            found.add(own)
        yield found.best.emit(sent.value.qids, qid_type, id_type)

    dealt = both.repartition(_tasks(both), "batch", "range").sortWithinPartitions("batch", "range")
    return dealt.mapInArrow(search, schema)
