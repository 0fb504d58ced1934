"""Log-probabilities of whole texts under a smoothed n-gram model, as a weighted back-off automaton.

Tokens are words (ASCII white space apart, A-Z lowered) and one end for each text.
The lowest order is the base distribution: (c + 0.1) / (N + 0.1 (V + 1)).

Encoding. Texts are tokenised once, into blocks of BLOCK_BYTES: a block holds its own
vocabulary with counts and its texts as numbers in it. Blocks are a table bucketed by block, and so
is all that is answered to them, so that a block meets its answers without a shuffle.

Counting. A block asks for its own words by 128 bits of hash, dealt out to as many parts as the
corpus needs; a part sums each word's counts over all blocks and answers every block. A word comes
once for a block, so a frequent word has as many rows as there are blocks, not as it
has occurrences. Nothing is pruned here: the base distribution counts every word.

N-grams. Every pair and triple of neighbouring words in training texts is an arc, whatever
its count; nothing is pruned, so what is gathered grows with the corpus. A block asks for its own
different n-grams: their 64-bit keys are dealt out to as many parts as the corpus needs, a
part sums each key's counts over all blocks and answers every block, with a mark for one
block of each n-gram that occurs. The marks of triples, counted by their pair, travel with the
pairs' requests, and those of pairs with the words'; so each history learns how many arcs it has.
No key and no history is one task's work: a key comes once for a block.

Automaton. States are the histories that have arcs: the root, words, pairs. An arc's probability
is its discounted count over its history's, plus the weight of the history's failure arc times the
probability one order down. A failure weight is what the arcs leave over, DISCOUNT times their
number over the history's count, so every state's probabilities add up to 1. Every block
builds the automaton of the n-grams it can ask for (`Automaton`) and walks its texts from left to right:
the state's arc for the next token is taken, or its failure arc, which adds its weight and leads to the next
shorter history; at the root the base distribution answers. An arc leads to the longest history that is a state.

Two n-grams count as one if their 64-bit keys agree, which among a billion different ones is
expected for 0.03 pairs; words count as one if 128 bits agree.

Defined cases: a null or empty text is its end alone; without a training text every
count is 0; null ids are kept; repeated rows count and are scored each; only the
columns named are read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from passagework.functions.vectors import byte_values
from passagework.llm.common import as_bytes, drop_shuffles, drop_stored, give_back, numbering, slices, starts_of, stored_by
from passagework.session import materialize

BLOCK_BYTES = 4 << 20
ADDED = 0.1
DISCOUNT = 0.5
#: Tokens of the corpus for each part that n-grams are dealt out to.
PART_TOKENS = 1 << 20
#: The most buckets that Spark allows.
MOST_BUCKETS = 100_000
#: The end of a text; no word is empty.
END = ""
BLOCK = "block long, tokens long, sizes binary, ids binary, words array<string>, counts array<long>"
SCORES = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def encode_blocks(docs: DataFrame, columns: list[str], train: Column, text: str = "text") -> DataFrame:
    """(block, tokens, rows, sizes, ids, words, counts, train). `counts` are those of texts for which `train` holds."""
    chosen = docs.select(
        F.struct(*[docs[c] for c in columns]).alias("row"), F.coalesce(train, F.lit(False)).alias("_train"), docs[text].alias("_text")
    )
    schema = StructType.fromDDL(BLOCK).add("rows", ArrayType(chosen.schema["row"].dataType)).add("train", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for part in slices(batches, "_text", BLOCK_BYTES):
            known = numbering()
            texts = []
            for words in (x.lower().split() for x in as_bytes(part.column("_text"))):
                words.append(END.encode())
                texts.append(np.fromiter(map(known.__getitem__, words), dtype=np.int32, count=len(words)))
            sizes = np.array([len(x) for x in texts], dtype=np.int32)
            ids = np.concatenate(texts)
            train = part.column("_train").to_numpy(zero_copy_only=False)
            counts = np.bincount(ids[np.repeat(train, sizes)], minlength=len(known))
            words = pa.array([*known], pa.binary()).cast(pa.string())
            whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    pa.array([len(ids)], pa.int64()),
                    pa.array([sizes.tobytes()]),
                    pa.array([_pack(ids, len(known))]),
                    whole(words),
                    whole(pa.array(counts, pa.int64())),
                    whole(part.column("row")),
                    pa.array([train.astype(np.uint8).tobytes()]),
                ],
                names=["block", "tokens", "sizes", "ids", "words", "counts", "rows", "train"],
            )
            number += 1

    return chosen.mapInArrow(run, schema)


def _pack(ids: np.ndarray, distinct: int) -> bytes:
    """Numbers as three bytes each where that is enough, else four."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    return (raw[:, :3] if distinct <= 1 << 24 else raw).tobytes()


def _unpack(data: bytes, sizes: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8).reshape(int(sizes.sum()), -1).astype(np.int32)
    out = raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16
    return out | raw[:, 3] << 24 if raw.shape[1] == 4 else out


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(w, seed) for w in byte_values(words)]), dtype=">u8").astype(np.uint64)


class Grams:
    """The different pairs and triples of a block, each numbered by the order of their keys."""

    def __init__(self, row: pa.RecordBatch, pairs: bool = True, triples: bool = True):
        self.sizes = np.frombuffer(row.column("sizes")[0].as_py(), dtype=np.int32)
        self.ids = _unpack(row.column("ids")[0].as_py(), self.sizes)
        self.train = np.repeat(np.frombuffer(row.column("train")[0].as_py(), dtype=np.uint8), self.sizes)
        first = np.zeros(len(self.ids), dtype=bool)
        first[np.cumsum(self.sizes[:-1])] = True
        first[0] = True
        #: Tokens that have one before them, or two, in their text; and the number of the pair or triple they end.
        self.at2 = np.flatnonzero(~first)
        self.words = word_hashes(row.column("words").flatten())
        hashes = self.words[self.ids]
        key = np.zeros(len(self.ids), dtype=np.uint64)
        key[1:] = _mix(_mix(hashes[:-1] + np.uint64(1)) ^ hashes[1:])
        if pairs:
            self.keys2, self.pair, place = _numbered(key, self.at2)
            self.left, self.right = self.ids[place - 1], self.ids[place]
        if triples:
            self.at3 = self.at2[~first[self.at2 - 1]]
            key[1:] = _mix(_mix(key[:-1] + np.uint64(3)) ^ hashes[1:])
            self.keys3, self.triple, place = _numbered(key, self.at3)
            if pairs:
                ends = np.zeros(len(self.ids), dtype=np.int32)
                ends[self.at2] = self.pair
                # The pairs of a triple's first and last two words, and its last word.
                self.head, self.under, self.tail = ends[place - 1], ends[place], self.ids[place]

    def counts(self, order: int) -> np.ndarray:
        """Occurrences in training texts by local number."""
        at, number, n = (self.at2, self.pair, len(self.keys2)) if order == 2 else (self.at3, self.triple, len(self.keys3))
        return np.bincount(number, weights=self.train[at], minlength=n).astype(np.int64)


def _numbered(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted different keys at some places, the number of each place's key, a place of each key)."""
    order, keys = _ordered(key[at])
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    number = np.empty(len(keys), dtype=np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return keys[new], number, at[order[new]]


def _ordered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stable order, sorted keys). Places ride in the lower bits, so that plain numbers are sorted; if keys differ there alone, they are sorted whole."""
    low = np.uint64((1 << max(len(keys) - 1, 0).bit_length()) - 1)
    packed = keys & ~low
    packed |= np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    packed &= low
    order = packed.view(np.int64)
    found = keys[order]
    if (found[1:] < found[:-1]).any():
        order = np.argsort(keys, kind="stable")
        found = keys[order]
    return order, found


def _narrow(values: np.ndarray) -> bytes:
    """Non-negative numbers in as few bytes as the largest takes, behind one byte that says how many."""
    most = int(values.max(initial=0))
    size = next(x for x in (1, 2, 4, 8) if most < 1 << 8 * x)
    return bytes([size]) + values.astype(f"<u{size}").tobytes()


def _gaps(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences, byte by byte of all of them, which leaves the upper ones to compression."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_gaps(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, dtype=np.uint8).reshape(8, -1).T.copy().view(np.uint64).reshape(-1), dtype=np.uint64)


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{data[0]}", offset=1).astype(np.int64)


ANSWER = "block long, part long, n binary, t binary, first binary"


def _answered(row: pa.RecordBatch, name: str, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count, arcs, marked) by the order of keys, from a block's answers."""
    out = [np.zeros(size, dtype=np.int64) for _ in range(3)]
    begin = 0
    for x in sorted(row.column(name)[0].as_py() or [], key=lambda x: x["part"]):
        n = _wide(x["n"])
        place = slice(begin, begin + len(n))
        out[0][place] = n
        out[1][place] = _wide(x["t"])
        out[2][place] = np.unpackbits(np.frombuffer(x["first"], dtype=np.uint8), count=len(n))
        begin += len(n)
    return out[0], out[1], out[2]


def _word_order(hashes: np.ndarray, words: pa.Array) -> np.ndarray:
    """The numbers of a block's words in the order of 128 bits of hash, of which `hashes` are the first 64."""
    order = np.argsort(hashes)
    if (np.diff(hashes[order]) == 0).any():
        order = np.lexsort((word_hashes(words, 1), hashes))
    return order


def _by_block(answers: DataFrame, columns: list[str], name: str, buckets: int) -> DataFrame:
    """A stored table with one row of all answers for each block."""
    found = answers.repartition(buckets, "block").groupBy("block").agg(F.collect_list(F.struct(*columns)).alias(name))
    return stored_by(found, "block", buckets, f"lm-{name}")


def _with(blocks: DataFrame, *answers: DataFrame) -> DataFrame:
    """Blocks with their answers; all are bucketed by block."""
    for found in answers:
        blocks = blocks.join(found.hint("shuffle_hash"), "block", "left")
    return blocks


def _each_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1)
            give_back()


def _asked(row: pa.RecordBatch, order: int) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
    """(sorted keys, 64 more bits of each word, counts in training texts, arcs marked here) of a block's n-grams."""
    if order == 3:
        grams = Grams(row, pairs=False)
        return grams.keys3, None, grams.counts(3), np.zeros(len(grams.keys3), dtype=np.int64)
    if order == 2:
        grams = Grams(row)
        marked = _answered(row, "triples", len(grams.keys3))[2]
        return grams.keys2, None, grams.counts(2), np.bincount(grams.head, weights=marked, minlength=len(grams.keys2)).astype(np.int64)
    grams, words = Grams(row, triples=False), row.column("words").flatten()
    at = _word_order(grams.words, words)
    marked = _answered(row, "pairs", len(grams.keys2))[2]
    arcs = np.bincount(grams.left, weights=marked, minlength=len(words)).astype(np.int64)
    return grams.words[at], word_hashes(words, 1)[at], row.column("counts").flatten().to_numpy()[at], arcs[at]


def _same(keys: np.ndarray, checks: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(the number of each n-gram, the first place of each number)."""
    order = _ordered(keys)[0] if checks is None else np.lexsort((checks, keys))
    new = np.ones(len(keys), dtype=bool)
    new[1:] = np.diff(keys[order]) != 0
    if checks is not None:
        new[1:] |= np.diff(checks[order]) != 0
    number = np.empty(len(keys), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


def _totals(blocks: DataFrame, order: int, parts: int) -> DataFrame:
    """Rows of ANSWER: corpus counts of the n-grams of every block and, of words and pairs, how many arcs leave them."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each_row(batches):
            keys, checks, n, t = _asked(row, order)
            if not len(keys):
                continue
            part = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(keys)]
            spans = [slice(a, b) for a, b in zip(cuts, cuts[1:])]
            block = row.column("block")[0].as_py()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part[cuts[:-1]]),
                    pa.array([block] * len(spans), pa.int64()),
                    pa.array([_gaps(keys[x]) for x in spans]),
                    pa.array([None if checks is None else checks[x].tobytes() for x in spans], pa.binary()),
                    pa.array([_narrow(n[x]) for x in spans]),
                    pa.array([_narrow(t[x]) for x in spans]),
                ],
                names=["part", "block", "keys", "checks", "n", "t"],
            )

    def answer(table: pa.Table) -> pa.Table:
        keys = [_from_gaps(x) for x in table.column("keys").to_pylist()]
        bounds = starts_of(np.array([len(x) for x in keys]))
        checks = np.frombuffer(b"".join(table.column("checks").to_pylist()), dtype=np.uint64) if order == 1 else None
        number, begin = _same(np.concatenate(keys), checks)
        summed = lambda c: np.bincount(number, weights=np.concatenate([_wide(x) for x in table.column(c).to_pylist()])).astype(np.int64)
        n, t = summed("n"), summed("t")
        first = np.zeros(len(number), dtype=np.uint8)
        first[begin[n > 0]] = 1
        n, t = n[number], t[number]
        spans = [slice(a, b) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        arrays = [
            table.column("block").combine_chunks(),
            table.column("part").combine_chunks(),
            pa.array([_narrow(n[x]) for x in spans]),
            pa.array([_narrow(t[x]) for x in spans]),
            pa.array([np.packbits(first[x]).tobytes() for x in spans]),
        ]
        give_back()
        return pa.Table.from_arrays(arrays, names=["block", "part", "n", "t", "first"])

    needed = {3: [], 2: ["triples"], 1: ["counts", "pairs"]}[order]
    chosen = blocks.select("block", "sizes", "ids", "words", "train", *needed)
    asked = chosen.mapInArrow(ask, "part long, block long, keys binary, checks binary, n binary, t binary")
    return asked.groupBy("part").applyInArrow(answer, ANSWER)


def _known_words(totals: DataFrame) -> int:
    """How many different words the training texts have: each is marked once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sum(int(np.bitwise_count(np.frombuffer(x["first"], dtype=np.uint8)).sum()) for own in batch.column("words").to_pylist() for x in own)
            yield pa.RecordBatch.from_arrays([pa.array([found], pa.int64())], names=["n"])

    return int(totals.select(F.col("totals").alias("words")).mapInArrow(count, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])


class Automaton:
    """The weighted back-off automaton of the n-grams of one block.

    States: 0 is the root, 1 + w the history of the block's word w, 1 + words + p that of its pair p. Pairs are
    arcs of word states, triples arcs of pair states, each under its local number; NaN stands for no arc.
    """

    def __init__(self, grams: Grams, base: np.ndarray, words: tuple, pairs: tuple, triples: np.ndarray):
        """`base` are the words' probabilities; `words` and `pairs` are (corpus counts, arcs), `triples` corpus counts, by local number."""
        self.words = len(base)
        (c, arcs1), (n2, arcs2) = words, pairs
        with np.errstate(divide="ignore", invalid="ignore"):
            left1, left2 = DISCOUNT * arcs1 / c, DISCOUNT * arcs2 / n2
            p2 = np.where(n2 > 0, (n2 - DISCOUNT) / c[grams.left] + left1[grams.left] * base[grams.right], np.nan)
            # One order down from a triple: the arc of its last two words, or that word's failure arc.
            right = grams.right[grams.head]
            known = arcs1[right] > 0
            lower = np.where(n2[grams.under] > 0, p2[grams.under], np.where(known, left1[right], 1.0) * base[grams.tail])
            p3 = np.where(triples > 0, (triples - DISCOUNT) / n2[grams.head] + left2[grams.head] * lower, np.nan)
            self.log_base, self.log2, self.log3 = np.log10(base), np.log10(p2, out=p2), np.log10(p3, out=p3)
            self.weight = np.log10(np.concatenate([[1.0], left1, left2]))
        word_state = np.where(arcs1 > 0, 1 + np.arange(self.words), 0)
        pair_state = np.where(arcs2 > 0, 1 + self.words + np.arange(len(n2)), word_state[grams.right])
        #: Where a failure arc leads, and where arcs do: from the root after a word, from other states after a pair.
        self.failure = np.concatenate([[0], np.zeros(self.words, dtype=np.int64), word_state[grams.right]])
        self.after_word, self.after_pair = word_state, pair_state

    def traverse(self, grams: Grams) -> np.ndarray:
        """Log10 probability of every token.

        A state is the longest history that has arcs, whichever way it was reached, so the states along all
        texts follow from the arcs' ends; the walk then takes every token's arc, or failure arcs until there is one.
        """
        state = np.zeros(len(grams.ids), dtype=np.int64)
        state[1:] = self.after_word[grams.ids[:-1]]
        after = np.full(len(grams.ids), -1, dtype=np.int64)
        after[grams.at2] = self.after_pair[grams.pair]
        state[1:] = np.where(after[:-1] >= 0, after[:-1], state[1:])
        state[np.cumsum(grams.sizes)[:-1]] = 0
        two, three = (np.full(len(grams.ids), np.nan) for _ in range(2))
        two[grams.at2], three[grams.at3] = self.log2[grams.pair], self.log3[grams.triple]
        out = np.zeros(len(grams.ids))
        for arcs, first in ((three, 1 + self.words), (two, 1)):
            here = np.flatnonzero(state >= first)
            found = ~np.isnan(arcs[here])
            out[here[found]] += arcs[here[found]]
            failed = here[~found]
            out[failed] += self.weight[state[failed]]
            state[failed] = self.failure[state[failed]]
            state[here[found]] = -1
        at_root = state == 0
        out[at_root] += self.log_base[grams.ids[at_root]]
        return out


def score(blocks: DataFrame, total: int, distinct: int) -> DataFrame:
    """The rows of every block with SCORES; `blocks` have the answers for `pairs`, `triples` and `totals`."""
    row = blocks.schema["rows"].dataType.elementType
    schema = StructType([StructField("row", row), *StructType.fromDDL(SCORES).fields])
    denominator = total + ADDED * (distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What a block takes is given back before the next one is read.
        yield from map(scored, _each_row(batches))

    def scored(one: pa.RecordBatch) -> pa.RecordBatch:
        grams = Grams(one)
        at = _word_order(grams.words, one.column("words").flatten())
        c, arcs = (np.zeros(len(at), dtype=np.int64) for _ in range(2))
        c[at], arcs[at], _ = _answered(one, "totals", len(at))
        n2, arcs2, _ = _answered(one, "pairs", len(grams.keys2))
        n3, _, _ = _answered(one, "triples", len(grams.keys3))
        bounds = starts_of(grams.sizes)
        low = (c + ADDED) / denominator
        model = Automaton(grams, low, (c, arcs), (n2, arcs2), n3)
        known = np.add.reduceat((c > 0)[grams.ids].astype(np.int64), bounds[:-1])
        sums = lambda x: np.array([x[a:b].sum() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())])
        arrays = [
            one.column("rows").flatten(),
            pa.array(grams.sizes, pa.int64()),
            pa.array(known),
            pa.array(np.full(len(grams.sizes), total, dtype=np.int64)),
            pa.array(sums(model.log_base[grams.ids])),
            pa.array(sums(model.traverse(grams))),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=["row", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return blocks.select("sizes", "ids", "words", "rows", "train", "pairs", "triples", "totals").mapInArrow(run, schema)


def score_texts(docs: DataFrame, columns: list[str], train: Column, text: str = "text") -> DataFrame:
    """`columns` of every row as the struct `row`, with SCORES; learns from rows for which `train` holds."""
    spark = docs.sparkSession
    buckets = min(MOST_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = stored_by(encode_blocks(docs, columns, train, text), "block", buckets, "lm-blocks")
    parts = (blocks.agg(F.sum("tokens")).first()[0] or 0) // PART_TOKENS + 1
    answer = ["part", "n", "t", "first"]
    triples = _by_block(_totals(blocks, 3, parts), answer, "triples", buckets)
    drop_shuffles(spark)
    pairs = _by_block(_totals(_with(blocks, triples), 2, parts), answer, "pairs", buckets)
    drop_shuffles(spark)
    totals = _by_block(_totals(_with(blocks, pairs), 1, parts), answer, "totals", buckets)
    drop_shuffles(spark)
    counts = F.aggregate("counts", F.lit(0).cast("bigint"), lambda x, y: x + y)
    total = blocks.agg(F.coalesce(F.sum(counts), F.lit(0))).first()[0]
    found = materialize(score(_with(blocks, triples, pairs, totals), int(total), _known_words(totals)), "lm-scores")
    drop_stored(blocks, triples, pairs, totals)
    return found
