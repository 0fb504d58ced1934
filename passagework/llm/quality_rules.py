"""Quality rules whose limits come from the data.

Every document gets a few integer ratios. Their distribution within each
(language, source) is kept as a mergeable quantile sketch: counts per bucket,
the bucket being exact below 16 and 1/16 wide in relation to the value above.
Sketches of a language or of everything are sums of the finer ones, so one
aggregation over the documents gives all three levels. A document is rejected
when a ratio lies beyond both limits that its own group's sketch gives: the far-out fence
of the quartiles, and the mean plus some standard deviations, which does not vanish
where most documents have a ratio of 0; groups with few
documents use the language's sketch, and failing that the sketch of all.

Defined cases: a null text counts as empty and fails the base rule; null
languages and sources form groups of their own; repeated rows each count;
columns other than those named are never read, and an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from passagework.llm.common import as_bytes, carried, numbering, starts_of, sums_between, text_slices
from passagework.operators.sizing import fits_broadcast
from passagework.session import materialize

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
SLICE_BYTES = 1 << 20
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Documents that a group needs for limits of its own.
MIN_GROUP = 200
#: A limit is the upper quartile plus so many times the distance between the quartiles.
FENCE = 3.0
#: The other limit is the mean plus so many standard deviations.
DEVIATIONS = 3.0

_WORD_BYTE = np.ones(256, dtype=np.int64)
_WORD_BYTE[[32, *range(9, 14)]] = 0
_CODE_POINT = _WORD_BYTE.copy()
_CODE_POINT[0x80:0xC0] = 0
_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(SYMBOLS)] = 1
_MIX = np.uint64(0x9E3779B97F4A7C15)

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def _line_counts(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\v\f\r")]
    return len(lines), len(lines) - len(set(lines))


def _repeated(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each word, 1 if it lies in a window that its text holds at least twice."""
    n = len(ids) - WINDOW + 1
    if n <= 0:
        return np.zeros(len(ids), dtype=np.int64)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :])
    key = (owner[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    key ^= key >> np.uint64(32)
    for j in range(WINDOW):
        key = (key + ids[at + j].astype(np.uint64) + np.uint64(1)) * _MIX
        key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(order) + 1, dtype=bool)
    same[1:-1] = key[order[1:]] == key[order[:-1]]
    later = np.flatnonzero(same[:-1])
    left, right = at[order[later - 1]], at[order[later]]
    # Keys are hashes; compare what they stand for, and count exactly should two ever clash.
    equal = owner[left] == owner[right]
    for j in range(WINDOW):
        equal &= ids[left + j] == ids[right + j]
    if equal.all():
        hits = at[order[same[:-1] | same[1:]]]
    else:
        places: dict[tuple, list[int]] = {}
        for i in at.tolist():
            places.setdefault((owner[i], *ids[i : i + WINDOW].tolist()), []).append(i)
        hits = np.array([i for found in places.values() if len(found) > 1 for i in found], dtype=np.int64)
    cover = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(cover, hits, 1)
    np.add.at(cover, hits + WINDOW, -1)
    return (np.cumsum(cover[:-1]) > 0).astype(np.int64)


def text_stats(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The six counts of STATS for each text."""
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    spans = starts_of(np.array([len(x) for x in texts], dtype=np.int64))
    number = numbering().__getitem__
    parts = [np.fromiter(map(number, words), dtype=np.int64, count=len(words)) for words in map(bytes.split, texts)]
    counts = np.array([len(x) for x in parts], dtype=np.int64)
    bounds = starts_of(counts)
    ids = np.concatenate(parts)
    lines = [_line_counts(x) for x in texts]
    return {
        "n_words": counts,
        "word_chars": sums_between(_CODE_POINT[raw], spans),
        "n_symbols": sums_between(_SYMBOL[raw], spans),
        "n_dup_lines": np.array([x[1] for x in lines], dtype=np.int64),
        "n_repeat_words": sums_between(_repeated(ids, bounds), bounds),
        "n_lines": np.array([x[0] for x in lines], dtype=np.int64),
    }


def with_stats(docs: DataFrame, columns: list[str], lang: str, source: str, text: str = "text") -> DataFrame:
    """`columns` of every document as the struct `row`, its `_lang` and `_source`, and the counts of its whole text."""
    row, *rest = carried(docs, columns, text)
    groups = [docs[lang].cast("string").alias("_lang"), docs[source].cast("string").alias("_source")]
    chosen = docs.select(row, *groups, *rest)
    schema = StructType(chosen.schema[:3].fields + StructType.fromDDL(STATS).fields)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, columns, text, SLICE_BYTES):
            stats = text_stats(as_bytes(part.column("_text")))
            arrays = [*part.columns[:3], *(pa.array(x) for x in stats.values())]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "_lang", "_source", *stats])

    return chosen.mapInArrow(count, schema)


#: Ratio: (numerator, denominator, multiplier).
RATIOS = {
    "symbol_rate": ("n_symbols", "word_chars", 1000),
    "dup_line_rate": ("n_dup_lines", "n_lines", 1000),
    "repeat_rate": ("n_repeat_words", "n_words", 1000),
    "word_length": ("word_chars", "n_words", 10),
}


def ratio(metric: str) -> Column:
    """The ratio as an integer, rounded down; 0 where there is nothing to divide by."""
    top, bottom, times = RATIOS[metric]
    return F.floor(F.col(top) * times / F.greatest(F.col(bottom), F.lit(1))).cast("long")


def bucket(value: Column) -> Column:
    """Sketch bucket of a non-negative integer."""
    top = F.length(F.bin(value)) - 1
    wide = 16 * (top - 3) + F.call_function("shiftright", value, top - 4) % 16
    return F.when(value < 16, value).otherwise(wide).cast("int")


def upper_edge(number: Column) -> Column:
    """Largest value of a bucket."""
    top = F.floor(number / 16) + 3
    size = F.pow(F.lit(2.0), top - 4)
    return F.when(number < 16, number.cast("double")).otherwise((16 + number % 16 + 1) * size - 1)


def sketches(stats: DataFrame, groups: list[str]) -> DataFrame:
    """(groups..., metric, bucket, n): the mergeable sketch of every group and ratio."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bucket(ratio(m)).alias("bucket")) for m in RATIOS]))
    # Documents that fail the base rule say nothing about the others.
    return (
        stats.filter(~failed())
        .select(*groups, each.alias("s"))
        .groupBy(*groups, "s.metric", "s.bucket")
        .agg(F.count("*").alias("n"))
    )


def limits(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """(groups..., metric, size, upper): limits from merged sketches of `groups`."""
    merged = sketch.groupBy(*groups, "metric", "bucket").agg(F.sum("n").alias("n"))
    of = Window.partitionBy(*groups, "metric")
    upto = of.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = merged.withColumn("size", F.sum("n").over(of)).withColumn("upto", F.sum("n").over(upto))
    edge = upper_edge(F.col("bucket"))
    quartile = lambda q: F.min(F.when(F.col("upto") >= F.col("size") * q, edge))
    mean = F.sum(F.col("n") * edge) / F.sum("n")
    square = F.sum(F.col("n") * edge * edge) / F.sum("n")
    wide = F.col("mean") + DEVIATIONS * F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0)))
    fence = F.col("q3") + FENCE * (F.col("q3") - F.col("q1"))
    return (
        ranked.groupBy(*groups, "metric")
        .agg(F.max("size").alias("size"), quartile(0.25).alias("q1"), quartile(0.75).alias("q3"), mean.alias("mean"), square.alias("square"))
        .select(*groups, "metric", "size", F.greatest(fence, wide).alias("upper"))
    )


def failed() -> Column:
    """The base rule: too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _flat(bounds: DataFrame, groups: list[str], suffix: str) -> DataFrame:
    own = [F.max(F.when(F.col("metric") == m, F.col("upper"))).alias(f"{m}_{suffix}") for m in RATIOS]
    return bounds.groupBy(*groups).agg(*own)


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which null keys match each other."""
    renamed = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [left[k].eqNullSafe(renamed[f"_{k}"]) for k in keys]
    return left.join(renamed, on, "left").drop(*[f"_{k}" for k in keys])


def limit_table(stats: DataFrame) -> DataFrame:
    """(_lang, _source, an upper limit per ratio): a row for each group that occurs."""
    lang, source = "_lang", "_source"
    sketch = materialize(sketches(stats, [lang, source]), "sketch")
    enough = F.col("size") >= MIN_GROUP
    bounds = sketch.select(lang, source).distinct()
    bounds = _joined(bounds, _flat(limits(sketch, [lang, source]).filter(enough), [lang, source], "f"), [lang, source])
    bounds = _joined(bounds, _flat(limits(sketch, [lang]).filter(enough), [lang], "m"), [lang])
    whole = _flat(limits(sketch, []), [], "w").first()
    level = lambda m: F.coalesce(f"{m}_f", f"{m}_m", F.lit(whole[f"{m}_w"]).cast("double")).alias(f"{m}_upper")
    return materialize(bounds.select(lang, source, *[level(m) for m in RATIOS]), "limits")


def apply_limits(stats: DataFrame, bounds: DataFrame) -> DataFrame:
    """`stats` with `base_failed` and `kept`.

    The limits are sent to the documents if they measure little, else joined by key.
    """
    if fits_broadcast(bounds):
        bounds = F.broadcast(bounds)
    beyond = F.lit(False)
    for m in RATIOS:
        beyond = beyond | F.coalesce(ratio(m) > F.col(f"{m}_upper"), F.lit(False))
    return (
        _joined(stats, bounds, ["_lang", "_source"])
        .withColumn("base_failed", failed())
        .withColumn("kept", ~failed() & ~beyond)
        .drop(*[f"{m}_upper" for m in RATIOS])
    )


def judge(stats: DataFrame) -> DataFrame:
    """A stored table of counts with its verdicts."""
    return apply_limits(stats, limit_table(stats))


def keep_good(docs: DataFrame, lang: str, source: str, text: str = "text") -> DataFrame:
    """The documents that the rules keep, with their own columns.

    The counts are taken twice, once for the sketches and once beside the texts,
    because writing texts and counts would cost more than counting again.
    """
    bounds = limit_table(with_stats(docs, [], lang, source, text))
    return apply_limits(with_stats(docs, docs.columns, lang, source, text), bounds).filter("kept").select("row.*")
