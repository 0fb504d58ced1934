"""Documents to chunks: fixed windows, recursive splitting, semantic grouping."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.defaults import (
    CHUNK_OVERLAP,
    CHUNK_SIZE,
    HASH_DIM,
    RANK_DIGITS,
    SEMANTIC_MAX_CHARS,
    SEMANTIC_PERCENTILE,
)
from passagework.functions.ids import chunk_id
from passagework.functions.text import fixed_chunks, once, split_sentences, tokenize
from passagework.functions.vectors import dot, hash_embed, hash_gaps, l2_normalize

# Separators from coarse to fine; the empty one cuts anywhere.
SEPARATORS = ("\n\n", "\n", " ", "")


def explode_chunks(docs: DataFrame, parts: Column, doc: str = "doc_id") -> DataFrame:
    """(chunk_id, doc_id, chunk_index, text, metadata): one row per part.

    `metadata` is taken from the document if it has the column; its `source`
    entry is filled from the `source` column unless it is set already.
    """
    given = F.col("metadata") if "metadata" in docs.columns else F.create_map().cast("map<string,string>")
    if "source" in docs.columns:
        filled = F.map_concat(given, F.create_map(F.lit("source"), F.col("source")))
        given = F.when(F.map_contains_key(given, "source"), given).otherwise(filled)
    rows = docs.select(
        F.col(doc).alias("doc_id"), given.alias("metadata"), F.posexplode(parts).alias("chunk_index", "text")
    )
    return rows.select(
        chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"),
        "doc_id",
        "chunk_index",
        "text",
        "metadata",
    )


def chunk_fixed(
    docs: DataFrame, text: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    return explode_chunks(docs, fixed_chunks(F.col(text), size, overlap))


def _pieces(text: str, start: int, end: int, level: int) -> tuple[list[int], int]:
    """Cut points of text[start:end] at the coarsest separator it contains.

    A separator belongs to the piece it opens. Returns the piece starts and the
    level below the one used.
    """
    for deeper, separator in enumerate(SEPARATORS[level:], level + 1):
        if not separator:
            return list(range(start, end)), deeper
        at = text.find(separator, start, end)
        if at < 0:
            continue
        cuts = [start] if at > start else []
        while at >= 0:
            cuts.append(at)
            at = text.find(separator, at + len(separator), end)
        return cuts, deeper
    return [start], len(SEPARATORS)


def _windows(starts: list[int], end: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """Greedy spans of consecutive pieces, at most `size` long, the next one reaching
    back over whole pieces of at most `overlap` characters."""
    spans = []
    first = 0
    edges = [*starts, end]
    for piece in range(len(starts)):
        if edges[piece + 1] - edges[first] > size and piece > first:
            spans.append((edges[first], edges[piece]))
            reach = max(edges[piece] - overlap, edges[piece + 1] - size)
            first = min(max(first, bisect_left(edges, reach)), piece)
    spans.append((edges[first], end))
    return spans


def recursive_spans(
    text: str, size: int, overlap: int, start: int = 0, end: int | None = None, level: int = 0
) -> list[tuple[int, int]]:
    end = len(text) if end is None else end
    starts, deeper = _pieces(text, start, end, level)
    spans: list[tuple[int, int]] = []
    run: list[int] = []
    for at, until in zip(starts, [*starts[1:], end]):
        if until - at < size:
            run.append(at)
            continue
        if run:
            spans += _windows(run, at, size, overlap)
            run = []
        if deeper < len(SEPARATORS):
            spans += recursive_spans(text, size, overlap, at, until, deeper)
        else:
            spans.append((at, until))
    if run:
        spans += _windows(run, end, size, overlap)
    return spans


def recursive_split(text: str, size: int, overlap: int) -> list[str]:
    parts = (text[a:b].strip() for a, b in recursive_spans(text, size, overlap))
    return [p for p in parts if p]


def recursive_chunks(col: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """ARRAY<STRING>: pieces of at most `size` characters cut at paragraphs, lines, words."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: recursive_split(t, size, overlap), na_action="ignore")

    return once(split)(col)


def chunk_recursive(
    docs: DataFrame, text: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    return explode_chunks(docs, recursive_chunks(F.col(text), size, overlap))


def sentence_vectors(docs: DataFrame, text: str = "text", embed=None) -> DataFrame:
    """(doc_id, pos, sentence, vector): unit vectors of the hashing model or of `embed(column)`."""
    keys = [c for c in ("doc_id", "source") if c in docs.columns]
    rows = docs.select(*keys, F.posexplode(split_sentences(F.col(text))).alias("pos", "sentence"))
    if embed is None:
        return rows.withColumn("vector", hash_embed(tokenize(F.col("sentence")), HASH_DIM, unit=True))
    return rows.withColumn("vector", embed(F.col("sentence"))).withColumn("vector", l2_normalize(F.col("vector")))


def sentence_distances(vectors: DataFrame) -> DataFrame:
    """Adds `distance` to the sentence before (NULL for the first), rounded for stable cuts."""
    before = F.lag("vector").over(Window.partitionBy("doc_id").orderBy("pos"))
    rows = vectors.withColumn("before", before)
    gap = F.round(1.0 - dot(F.col("before"), F.col("vector")), RANK_DIGITS)
    return rows.withColumn("distance", F.when(F.col("before").isNotNull(), gap)).drop("before", "vector")


def sentence_gaps(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, pos, sentence, distance) by the hashing model, as `sentence_distances` of `sentence_vectors` gives them.

    A document is one row until its sentences have their distances, so vectors are not shuffled.
    """
    keys = [c for c in ("doc_id", "source") if c in docs.columns]
    rows = docs.select(*keys, split_sentences(F.col(text)).alias("_sentences"))
    rows = rows.withColumn("_gaps", hash_gaps(F.transform("_sentences", tokenize), HASH_DIM))
    rows = rows.select(*keys, F.posexplode(F.arrays_zip("_sentences", "_gaps")).alias("pos", "_both"))
    return rows.select(
        *keys, "pos", F.col("_both._sentences").alias("sentence"), F.round("_both._gaps", RANK_DIGITS).alias("distance")
    )


def semantic_groups(distances: DataFrame, percentile: float = SEMANTIC_PERCENTILE) -> DataFrame:
    """Adds `threshold` per document and `grp`, which grows where the distance passes it."""
    if not 0.0 < percentile < 100.0:
        raise ValueError("percentile must be in (0, 100)")
    whole = Window.partitionBy("doc_id")
    limit = F.round(F.percentile("distance", F.lit(percentile / 100)).over(whole), RANK_DIGITS)
    rows = distances.withColumn("threshold", limit)
    opens = F.when(F.col("distance") > F.col("threshold"), 1).otherwise(0)
    running = whole.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("grp", F.sum(opens).over(running))


def semantic_chunks(
    docs: DataFrame,
    text: str = "text",
    percentile: float = SEMANTIC_PERCENTILE,
    max_chars: int = SEMANTIC_MAX_CHARS,
    embed=None,
) -> DataFrame:
    """Chunks cut where neighbouring sentences differ most.

    All windows and the grouping share one shuffle by document; a group is at
    most one document's text.
    """
    gaps = sentence_gaps(docs, text) if embed is None else sentence_distances(sentence_vectors(docs, text, embed))
    grouped = semantic_groups(gaps, percentile)
    keys = [c for c in ("doc_id", "source") if c in docs.columns]
    parts = grouped.groupBy(*keys, "grp").agg(
        F.array_sort(F.collect_list(F.struct("pos", "sentence"))).alias("items")
    )
    joined = F.array_join(F.transform("items", lambda i: i["sentence"]), " ")
    # Only groups over the limit go to the Python splitter; the rest pass as NULL.
    rows = parts.select(*keys, "grp", joined.alias("joined"))
    too_long = F.length("joined") > max_chars
    cut = recursive_chunks(F.when(too_long, F.col("joined")), max_chars, 0)
    pieces = rows.select(*keys, "grp", F.coalesce(cut, F.array("joined")).alias("pieces"))
    whole = pieces.groupBy(*keys).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("grp", "pieces"))), lambda g: g["pieces"])).alias(
            "parts"
        )
    )
    return explode_chunks(whole, F.col("parts"))


def in_order(chunks: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Chunks with those of a document together and by position: sorted within partitions, not over all."""
    return chunks.repartition(doc_id).sortWithinPartitions(doc_id, "chunk_index")


# Named chunkers; an unknown name fails before any job starts.
CHUNKERS = {"fixed": chunk_fixed, "recursive": chunk_recursive, "semantic": semantic_chunks}


def chunker(name: str):
    if name not in CHUNKERS:
        raise ValueError(f"unknown chunker: {name}")
    return CHUNKERS[name]
