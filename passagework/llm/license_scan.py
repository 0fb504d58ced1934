"""Licence labels of texts by a positional index of rare template words, in DataFrame functions only.

Every template is a short run of licence words with a mandatory phrase at a known
place in it. The index maps a word to its postings (template, position). One
aggregation over all documents gives the document frequency of each indexed word;
of every template the two words with the highest inverse frequency are kept as its
anchors. A document is then scanned for anchors alone: their postings, shifted by
their position in the template, are intersected, so that only places at which the
anchors stand at the right distance remain. There the template's words are compared
and the mandatory phrase is verified. A template that is nothing but its mandatory
phrase is found at exactly those places where the words stand consecutively.

All of it happens within a document's row; only word counts are shuffled.

Defined cases: a null text counts as empty (no words, empty labels, score 0); words
of any length and repeated rows need nothing special; only `key` and `text` are read;
an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words, and the phrases with the labels they stand for.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
#: Label: (template, mandatory phrase within it). Short, so that a mention is enough.
TEMPLATES = {
    "agpl": ("gnu affero general public license", "affero general public license"),
    "all-rights-reserved": ("all rights reserved", "all rights reserved"),
    "apache-2.0": ("licensed under the apache license version 2 0", "apache license"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    "cc-by": ("licensed under cc by 4 0", "cc by 4"),
    "cc-by-nc": ("licensed under cc by nc 4 0", "cc by nc"),
    "gpl-3.0": ("gnu general public license version 3", "general public license version 3"),
    "lgpl": ("gnu lesser general public license", "lesser general public license"),
    "mit-grant": ("permission is hereby granted free of charge to any person obtaining a copy", "hereby granted free of charge"),
    "mpl-2.0": ("mozilla public license version 2 0", "mozilla public license"),
}
#: Share of a template's words that must stand in place.
LEAST_SHARE = 0.75
ANCHORS = 2


def _templates() -> list[tuple[str, list[str], int, int, bool]]:
    """(label, words, start and length of the mandatory phrase, base or not)."""
    out = [(label, phrase.split(), 0, len(phrase.split()), True) for label, phrase in BASE.items()]
    for label, (text, phrase) in TEMPLATES.items():
        words, must = text.split(), phrase.split()
        at = next(i for i in range(len(words)) if words[i : i + len(must)] == must)
        out.append((label, words, at, len(must), False))
    return out


def _strings(values: list[str]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def _words(text: str) -> Column:
    pieces = F.split(F.coalesce(F.col(text), F.lit("")), BREAKS)
    return F.filter(pieces, lambda w: w != "")


def _indexed(words: str, vocabulary: list[str]) -> str:
    """Places of indexed words. They are ASCII, so a word with other letters is none of them."""
    listed = ", ".join(f"'{v}'" for v in vocabulary)
    return (
        f"filter(transform({words}, (w, i) -> struct(if(octet_length(w) <= {max(map(len, vocabulary))}, lower(w), '') AS w, i AS i,"
        f" octet_length(w) AS n)), x -> x.w IN ({listed}) AND x.n = length(x.w))"
    )


def word_frequencies(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """In how many documents each word of the templates occurs; one row per template word comes back."""
    vocabulary = sorted({w for _, words, *_ in _templates() for w in words})
    found = docs.select(_words(text).alias("_words")).select(
        F.explode(F.array_distinct(F.expr(f"transform({_indexed('_words', vocabulary)}, x -> x.w)"))).alias("word")
    )
    counts = {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return {w: counts.get(w, 0) for w in vocabulary}


def anchors(words: list[str], frequency: dict[str, int], total: int) -> list[tuple[str, int]]:
    """The words of highest inverse document frequency with their positions; each word at its first place.

    Words that no document has come last: with them nothing could be found.
    """
    idf = {w: math.log((total + 1) / (frequency[w] + 1)) for w in words}
    first = {w: words.index(w) for w in words}
    best = sorted(first, key=lambda w: (frequency[w] == 0, -idf[w], first[w]))[:ANCHORS]
    return [(w, first[w]) for w in best]


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row."""
    total = docs.count()
    frequency = word_frequencies(docs, text)
    index = [(*t, anchors(t[1], frequency, total)) for t in _templates()]
    wanted = sorted({w for *_, found in index for w, _ in found})
    rows = []
    for label, words, at, size, base, found in index:
        postings = ", ".join(f"struct('{w}' AS w, {i} AS off)" for w, i in found)
        rows.append(
            f"named_struct('label', '{label}', 'words', {_strings(words)}, 'at', {at}, 'size', {size},"
            f" 'base', {str(base).lower()}, 'anchors', array({postings}))"
        )
    # Starts at which both anchors stand in their places.
    shifted = "transform(filter(_places, x -> x.w = p.w), x -> x.i - p.off)"
    starts = (
        "array_distinct(aggregate(t.anchors, cast(null AS array<int>),"
        f" (met, p) -> if(met IS NULL, {shifted}, array_intersect(met, {shifted}))))"
    )
    hits = (
        "flatten(transform(_index, t -> transform(filter(" + starts + ", s -> s >= 0),"
        " s -> struct(t AS t, s AS s, zip_with(t.words, transform(slice(_words, s + 1, size(t.words)), w -> lower(w)), (a, b) -> coalesce(a = b, false)) AS same))))"
    )
    shares = (
        f"transform({hits}, h -> struct(h.t.label AS label, h.t.base AS base, h.s AS s,"
        " forall(slice(h.same, h.t.at + 1, h.t.size), m -> m) AS verified,"
        " size(filter(h.same, m -> m)) / size(h.t.words) AS share))"
    )
    out = (
        docs.select(F.col(key), _words(text).alias("_words"))
        .withColumn("_places", F.expr(_indexed("_words", wanted)))
        .withColumn("_index", F.expr(f"array({', '.join(rows)})"))
        .withColumn("_found", F.expr(f"filter({shares}, f -> f.verified AND f.share >= {LEAST_SHARE}D)"))
    )
    base = "transform(filter(_found, f -> f.base), f -> f.s)"
    labels = "concat_ws(',', sort_array(array_distinct(transform({of}, f -> f.label))))"
    return out.select(
        F.col(key),
        F.size("_words").cast("long").alias("n_words"),
        F.expr(f"size({base})").cast("long").alias("n_base"),
        F.expr(f"array_min({base})").cast("long").alias("first_word"),
        F.expr(f"array_max({base})").cast("long").alias("last_word"),
        F.expr(labels.format(of="filter(_found, f -> f.base)")).alias("base_labels"),
        F.expr(labels.format(of="_found")).alias("labels"),
        F.coalesce(F.expr("array_max(transform(_found, f -> f.share))"), F.lit(0.0)).alias("score"),
    )
