"""Ranked lexical search by an Aho-Corasick scan of the documents, without an index of them.

The terms of all items make one automaton, whose patterns are guarded by a blank on
either side, and texts are brought to terms separated by single guards of the same kind;
so whatever the automaton finds is a whole term. One pass over the texts gives, for each
document, its number of terms and how often each item term occurs. Document frequencies
are sums of these; then every document is scored for all items that its terms belong to,
and each task gives at most `k` rows an item.

Items are the stated queries. Their terms are sent to the tasks in slices of at most
TERM_BYTES (an item's terms travel together); each slice is one automaton and one scan.

A term is a maximal run of ASCII letters, digits and characters beyond ASCII; only A-Z
are lower-cased. Weights, lengths and scores are integers: see `weight` and `scores`.

Defined cases: a null, empty or separator-only text has no term and counts nowhere; an
item without terms, or none of whose terms occurs, has no rows; repeated rows are
documents, or items, of their own; ids are taken as longs, documents with a null id are
ranked after all others of the same score; ties go to the smaller id; very long texts are
scanned in pieces cut between terms; other columns are not read, whatever their names;
an empty table on either side gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagework.llm.common import as_bytes, slices, starts_of
from passagework.session import discard, materialize

TOP_K = 20
#: Bytes of item terms in one automaton; its states take some hundred times as much.
TERM_BYTES = 1 << 20
#: Bytes that the automaton reads at a time.
PIECE = 1 << 20
#: Scores, or single additions to scores, that a task holds at a time.
CELLS = 2_000_000

#: The characters that belong to terms, and the scoring constants.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GUARD = b" "
LENGTH_PERCENT = 25
GAIN = 1_000_000_000
TF_UNIT, LENGTH_UNIT = 1000, 12

_BYTES = bytes(
    c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else GUARD[0]
    for c in range(256)
)

COUNTED = "doc_id long, n long, terms array<int>, tfs array<int>"
RANKED = "item long, doc_id long, score long"


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(number, item_id, term, times): the terms of each item row; rows are numbered."""
    lowered = F.translate(items[text], UPPER, LOWER)
    found = items.select(
        F.monotonically_increasing_id().alias("number"),
        items[key].cast("long").alias("item_id"),
        F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0)).alias("terms"),
    )
    each = found.select("number", "item_id", F.explode("terms").alias("term"))
    return each.groupBy("number", "item_id", "term").agg(F.count("*").alias("times"))


@dataclass
class Automaton:
    """The terms of one slice of items, and for each term the items it belongs to (CSR)."""

    terms: list[bytes]
    starts: np.ndarray
    items: np.ndarray
    times: np.ndarray
    item_ids: list

    def matcher(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for i, term in enumerate(self.terms):
            found.add_word((GUARD + term + GUARD).decode("latin-1"), i)
        found.make_automaton()
        return found


def automaton(rows: list) -> Automaton:
    """From the collected rows (number, item_id, term, times) of one slice."""
    numbers = sorted({r["number"] for r in rows})
    place = {n: i for i, n in enumerate(numbers)}
    ids = {r["number"]: r["item_id"] for r in rows}
    ordered = sorted((r["term"].encode(), place[r["number"]], r["times"]) for r in rows)
    terms = sorted({x[0] for x in ordered})
    number = {t: i for i, t in enumerate(terms)}
    counts = np.bincount([number[x[0]] for x in ordered], minlength=len(terms))
    return Automaton(
        terms,
        starts_of(counts),
        np.array([x[1] for x in ordered], dtype=np.int64),
        np.array([x[2] for x in ordered], dtype=np.int64),
        [ids[n] for n in numbers],
    )


def term_bytes(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The texts lower-cased, every separator a guard, with guards around; and where each begins."""
    joined = GUARD + GUARD.join(texts) + GUARD
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    return joined.translate(_BYTES), starts_of(sizes) + 1


def count_terms(joined: bytes, starts: np.ndarray) -> np.ndarray:
    """How many terms each text has."""
    inside = np.frombuffer(joined, dtype=np.uint8) != GUARD[0]
    begins = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    return np.diff(np.searchsorted(begins, starts))


def occurrences(matcher: ahocorasick.Automaton, joined: bytes) -> Iterator[np.ndarray]:
    """Arrays of (place of the guard after it, term) for all item terms in `joined`."""
    at = 0
    while at < len(joined) - 1:
        # A piece ends with a guard, which also begins the next: no match lies across.
        end = joined.find(GUARD, min(at + PIECE, len(joined) - 1))
        found = matcher.iter(joined[at : end + 1].decode("latin-1"))
        pairs = np.fromiter(chain.from_iterable(found), dtype=np.int64).reshape(-1, 2)
        pairs[:, 0] += at
        yield pairs
        at = end


def term_counts(matcher: ahocorasick.Automaton, n_terms: int, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms in each text, text, term, how often) for all item terms that occur."""
    joined, starts = term_bytes(texts)
    found = [
        (np.searchsorted(starts, part[:, 0] - 1, "right") - 1) * n_terms + part[:, 1]
        for part in occurrences(matcher, joined)
    ]
    keys, times = np.unique(np.concatenate(found) if found else np.empty(0, np.int64), return_counts=True)
    return count_terms(joined, starts), keys // max(n_terms, 1), keys % max(n_terms, 1), times


def scan(docs: DataFrame, items: Automaton, key: str = "doc_id", text: str = "text") -> DataFrame:
    """COUNTED: of every document with a term, how many it has and which item terms, how often."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_terms = len(shared.value.terms)
        matcher = shared.value.matcher()
        for batch in slices(batches, "text"):
            n, doc, term, times = term_counts(matcher, n_terms, as_bytes(batch.column("text")))
            lists = pa.array(starts_of(np.bincount(doc, minlength=len(n))), pa.int32())
            out = pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n, pa.int64()),
                    pa.ListArray.from_arrays(lists, pa.array(term, pa.int32())),
                    pa.ListArray.from_arrays(lists, pa.array(times, pa.int32())),
                ],
                names=["doc_id", "n", "terms", "tfs"],
            )
            yield out.filter(pa.array(n > 0))

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, COUNTED)


def weight(documents: int, holding: int) -> int:
    """floor(1000 ln((2 N + 2) / (2 df + 1)))."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def lengths(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """A document's m: 100 - 25 + (25 n N div L)."""
    if len(n) and LENGTH_PERCENT * documents * int(n.max()) >= 1 << 62:
        share = np.array([LENGTH_PERCENT * documents * int(x) // total for x in n], dtype=np.int64)
    else:
        share = LENGTH_PERCENT * documents * n // max(total, 1)
    return 100 - LENGTH_PERCENT + share


def gains(tf: np.ndarray, m: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """What a term adds to a score each time it stands in an item."""
    return weights * (GAIN * tf // (TF_UNIT * tf + LENGTH_UNIT * m))


class Ranking:
    """The best `k` documents of every item among those offered."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, dtype=np.int64)
        self.rows = [np.empty(0, dtype=np.int64)] * 4

    def offer(self, ids: np.ndarray, unnamed: np.ndarray, table: np.ndarray) -> None:
        """Scores as documents x items; a score below 1 is none."""
        doc, item = np.nonzero(table >= self.least)
        offered = (item, table[doc, item], unnamed[doc], ids[doc])
        self.rows = [np.concatenate(pair) for pair in zip(self.rows, offered)]
        item, score, unnamed, ids = self.rows
        order = np.lexsort((ids, unnamed, -score, item))
        first = np.searchsorted(item[order], item[order])
        place = np.arange(len(order)) - first
        self.rows = [x[order[place < self.k]] for x in self.rows]
        last = order[place == self.k - 1]
        self.least[item[last]] = score[last]


def rank_counted(counted: DataFrame, items: Automaton, weights: np.ndarray, documents: int, total: int, k: int) -> DataFrame:
    """RANKED: at most `k` rows of each task for every item."""
    shared = counted.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weights = shared.value
        width = len(own.item_ids)
        best = Ranking(width, k)
        per_term = np.diff(own.starts)
        step = max(1, CELLS // width)
        for batch in batches:
            for begin in range(0, batch.num_rows, step):
                part = batch.slice(begin, step)
                held = part.column("terms")
                sizes = np.diff(held.offsets.to_numpy())
                doc = np.repeat(np.arange(len(sizes)), sizes)
                term = held.flatten().to_numpy().astype(np.int64)
                tf = part.column("tfs").flatten().to_numpy().astype(np.int64)
                m = lengths(part.column("n").to_numpy(), documents, total)
                gain = gains(tf, m[doc], weights[term])
                table = np.zeros(len(sizes) * width, dtype=np.int64)
                fan = per_term[term]
                cuts = np.searchsorted(np.cumsum(fan), np.arange(0, fan.sum(), CELLS), "left").tolist()
                for low, high in zip(cuts, [*cuts[1:], len(fan)]):
                    times = fan[low:high]
                    offset = np.arange(times.sum()) - np.repeat(starts_of(times)[:-1], times)
                    link = np.repeat(own.starts[term[low:high]], times) + offset
                    np.add.at(table, np.repeat(doc[low:high], times) * width + own.items[link], np.repeat(gain[low:high], times) * own.times[link])
                named = part.column("doc_id")
                unnamed = named.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                best.offer(named.fill_null(0).to_numpy(), unnamed, table.reshape(-1, width))
        item, score, unnamed, ids = best.rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(item), pa.array(ids, pa.int64(), mask=unnamed.astype(bool)), pa.array(score)], names=["item", "doc_id", "score"]
        )

    return counted.mapInArrow(run, RANKED)


def _slices(terms: DataFrame, limit: int) -> int:
    """Into how many parts, by a hash of the item, the items go so that each part's terms fit `limit`."""
    size = F.octet_length("term") + 16
    number, total = terms.agg(F.count_distinct("number"), F.coalesce(F.sum(size), F.lit(0))).first()
    parts = 1
    while total > limit and parts < 4 * number:
        parts *= 2
        by_part = terms.groupBy(_part(parts).alias("part")).agg(F.sum(size).alias("size"))
        total = by_part.agg(F.max("size")).first()[0]
    return parts if number else 0


def _part(parts: int):
    return F.pmod(F.xxhash64("number"), F.lit(parts))


def rank(
    docs: DataFrame,
    items: DataFrame,
    k: int = TOP_K,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    term_limit: int = TERM_BYTES,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the `k` documents with the highest scores above 0 of each item."""
    spark = docs.sparkSession
    terms = materialize(item_terms(items, item, item_text), "item-terms")
    parts = _slices(terms, term_limit)
    found = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for i in range(parts):
        own = automaton(terms.filter(_part(parts) == i).collect())
        if own.terms:
            found = found.unionByName(_rank_slice(docs, own, k, key, text))
    return found


def _rank_slice(docs: DataFrame, own: Automaton, k: int, key: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    counted = materialize(scan(docs, own, key, text), "term-counts")
    documents, total = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = np.zeros(len(own.terms), dtype=np.int64)
    # One row for each term of the slice.
    for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        holding[r["term"]] = r["count"]
    weights = np.array([weight(documents, int(d)) for d in holding], dtype=np.int64)
    ranked = rank_counted(counted, own, weights, documents, total, k)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(own.item_ids)), "item long, item_id long")
    found = materialize(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "ranked")
    discard(counted)
    return found
