"""Near-duplicate groups by SimHash fingerprints, found through Golay codes.

Fingerprint. Words are cut at ASCII white space after A-Z is lowered; every run of
SHINGLE words is hashed; a bit of the fingerprint is 1 if it is set in over half of
the hashes. Two fingerprints are linked if at most MAX_BITS of 64 bits differ.

Candidates. The 64 bits are cut into segments of 22, 21 and 21 bits. Two differing
bits leave at least one segment equal, and of the other two at least one with at
most one differing bit (pigeonhole). A segment is decoded as a word of the perfect
(23, 12) Golay code: the 12-bit index of its nearest codeword, and if that is three
bits away also those of the five codewords at four bits. Two words that differ in at
most one bit always share such an index. So a fingerprint has, for each ordered pair
of an equal segment and a decoded one, keys (pair, equal bits, index); linked
fingerprints share a key, which is about 33 bits selective.

Verification. Fingerprints, not documents, are joined: copies collapse first. In a
bucket of at most SMALL fingerprints pairs are compared in place and only links leave
it. Larger buckets are resolved exactly in linear work: two words at distance two or
less have a common word at distance one or less, so every fingerprint of such a
bucket is written with itself and its 64 neighbours, and all that share one are
linked to the smallest. (Those are at most two bits apart by construction.)

Components come from rounds of linking every fingerprint to the smallest it can see.

`keep_first` removes near duplicates: it uses the same keys and links on fingerprints of
words in several views, and verifies what they find by the shingles themselves. That joins
most copies; `all_links` finds the rest, so that groups are those of comparing every pair. Shingles
have one order for all texts, and two texts of Jaccard similarity s share one of the first
n - ceil(s n) + 1 of each (prefix filter). Texts that share such a shingle and are not in one
group yet are compared: with one of them for each shingle while there are many pairs, then each with
each. The order puts common shingles last; what is common is judged by a sample, which
decides about the work only, as any order gives the same pairs.
Pairs are left out that cannot be similar by the places of a shared shingle in both orders, or by
the bits in which the parities of their classes of shingles differ; only then are texts read.

Defined cases: texts that are null, empty or without a word have fingerprint zero and
are linked like any other; texts shorter than a shingle are one shingle; a null id
never is a component's smallest, unless it has nobody else; repeated rows each get a
row; only the id and text columns named are read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from passagework.llm.common import as_bytes, carried, drop_shuffles, numbering, slices, text_slices
from passagework.llm.components import smallest_reachable
from passagework.operators.sizing import fits_broadcast, keep_matching
from passagework.session import discard, materialize

SHINGLE = 3
SEED = 42
MAX_BITS = 2
SMALL = 64
#: Of near duplicates that are removed: words in a shingle, least Jaccard similarity, fingerprints a text.
NEAR_SHINGLE = 5
SIMILARITY = 0.8
VIEWS = 5
#: Texts by which common shingles are judged: all, if these are few, else a share that does not fall below 1 / SAMPLE_STEP,
#: so that a shingle too rare to be common has no more texts in a larger table; the number of them that makes a shingle
#: common, and the number of common shingles, the most frequent ones, that are sent to the tasks.
SAMPLE_TEXTS = 8_000
SAMPLE_STEP = 6
COMMON = 8
COMMON_SHINGLES = 4_000_000
#: Pairs for each row of a shared shingle up to which all are compared; rounds with one centre before that.
PAIRS_A_ROW = 4
#: Pairs for each text up to which all are compared.
PAIRS_A_TEXT = 8
STARS = 4
#: Texts that one copy of a head is compared with, and bytes of texts that a task of comparisons is sent.
MEMBERS = 256
TASK_BYTES = 16 << 20
#: Most classes of shingles of a text whose parities are kept, and bytes of shared shingles that are sent to all tasks.
PARITY_BITS = 1 << 15
SENT_BYTES = 16 << 20
#: Hashes whose bits are counted at a time.
BLOCK = 1 << 17
#: (shift, bits) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fixed value: a generator polynomial of the (23, 12) Golay code.
GENERATOR = 0xC75


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one whole text."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        begins = np.concatenate(([0], ends[:-1] + 1))
        spans = zip(begins[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
        parts = [joined[a:b] for a, b in spans]
    set_bits = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(parts), BLOCK):
        hashes = np.array([digest(p, SEED) for p in parts[at : at + BLOCK]], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(parts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, columns: list[str], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """`columns` of each row as the struct `row`, and its fingerprint `fp` as a long."""
    chosen = docs.select(*carried(docs, columns, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, columns, text):
            found = np.array([fingerprint(x, shingle) for x in as_bytes(part.column("_text"))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], names=["row", "fp"])

    return chosen.mapInArrow(run, StructType([chosen.schema[0], StructField("fp", LongType())]))


_tables: list[tuple[np.ndarray, np.ndarray]] = []


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words modulo the generator."""
    out = words.astype(np.int64)
    for bit in range(22, 10, -1):
        out = np.where(out >> bit & 1, out ^ (GENERATOR << (bit - 11)), out)
    return out


def decoding() -> tuple[np.ndarray, np.ndarray]:
    """Per syndrome: its weight-3-or-less error, and the weight-4 errors (0 where there are none)."""
    if not _tables:
        single = 1 << np.arange(23, dtype=np.int64)
        pairs = np.array([a | b for i, a in enumerate(single) for b in single[i + 1 :]])
        triples = np.array([p | s for p in pairs for s in single if s > p])
        fours = np.array([t | s for t in triples for s in single if s > t])
        near = np.zeros(2048, dtype=np.int64)
        for errors in (single, pairs, triples):
            near[_syndromes(errors)] = errors
        far = np.zeros((2048, 5), dtype=np.int64)
        used = np.zeros(2048, dtype=np.int64)
        for error, s in zip(fours.tolist(), _syndromes(fours).tolist()):
            if near[s].bit_count() == 3:
                far[s, used[s]] = error
                used[s] += 1
        _tables.append((near, far))
    return _tables[0]


def codeword_indices(words: np.ndarray) -> np.ndarray:
    """For each word six 12-bit indices of nearby codewords; -1 where there are fewer."""
    near, far = decoding()
    s = _syndromes(words)
    # The code is systematic: the upper 12 bits of a codeword are its index.
    out = np.full((len(words), 6), -1, dtype=np.int64)
    out[:, 0] = (words ^ near[s]) >> 11
    more = far[s]
    out[:, 1:] = np.where(more != 0, (words[:, None] ^ more) >> 11, -1)
    return out


def golay_keys(distinct: DataFrame) -> DataFrame:
    """(view, fp, key) for the distinct fingerprints of each view."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            view = batch.column(0).to_numpy().astype(np.int64)
            words = batch.column(1).to_numpy().view(np.uint64)
            parts = [((words >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64) for shift, bits in SEGMENTS]
            decoded = [codeword_indices(p) for p in parts]
            for i in range(3):
                for j in range(3):
                    if i != j:
                        start = (view << 40) | (np.int64(3 * i + j) << 34) | (parts[i] << 12)
                        valid = decoded[j] >= 0
                        keys = (start[:, None] | np.maximum(decoded[j], 0))[valid]
                        owner = np.broadcast_to(np.arange(len(words))[:, None], valid.shape)[valid]
                        arrays = [pa.array(view[owner], pa.int32()), pa.array(words.view(np.int64)[owner]), pa.array(keys)]
                        yield pa.RecordBatch.from_arrays(arrays, names=["view", "fp", "key"])

    return distinct.select("view", "fp").mapInArrow(run, "view int, fp long, key long")


def _neighbours(fp: Column) -> Column:
    """The word itself and the 64 that differ from it in one bit."""
    return F.concat(F.array(fp), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: fp.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))


def links(distinct: DataFrame, small: int = SMALL) -> DataFrame:
    """A stored table (view, a, b): links that connect all fingerprints of a view at most MAX_BITS apart, a < b."""
    keys = materialize(golay_keys(distinct), "golay-keys")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = materialize(keys.join(sizes, "key"), "golay-buckets")
    discard(keys)
    drop_shuffles(shared.sparkSession)
    buckets = shared.filter(F.col("n") <= small).groupBy("key", "view").agg(F.collect_set("fp").alias("fps"))
    within = buckets.select("view", F.explode("fps").alias("a"), "fps").select(
        "view", "a", F.explode(F.expr(f"filter(fps, b -> b > a AND bit_count(a ^ b) <= {MAX_BITS})")).alias("b")
    )
    crowded = shared.filter(F.col("n") > small).select("view", "fp").distinct()
    around = crowded.select("view", "fp", F.explode(_neighbours(F.col("fp"))).alias("word"))
    least = around.groupBy("view", "word").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1")
    star = around.join(least.drop("n"), ["view", "word"]).filter(F.col("fp") != F.col("a"))
    found = materialize(within.union(star.select("view", "a", F.col("fp").alias("b"))).distinct(), "simhash-links")
    discard(shared)
    drop_shuffles(found.sparkSession)
    return found


def roots(prints: DataFrame) -> DataFrame:
    """(fp, root): fingerprints of one connected group have the same root.

    `prints` is a stored table with the fields of `fingerprints`.
    """
    distinct = materialize(prints.select(F.lit(0).alias("view"), "fp").distinct(), "simhash-distinct")
    reached = smallest_reachable(links(distinct), "a", "b")
    named = distinct.join(reached, distinct["fp"] == reached["node"], "left")
    return materialize(named.select("fp", F.coalesce("root", "fp").alias("root")), "simhash-roots")


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(key, fingerprint, component_id) of every row."""
    prints = materialize(fingerprints(docs, [key], text, shingle), "simhash-prints")
    named = roots(prints)
    least = prints.groupBy("fp").agg(F.min(f"row.{key}").alias("least")).join(named, "fp").groupBy("root")
    found = named.join(least.agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    found = materialize(found, "simhash-groups")
    if fits_broadcast(found):
        found = F.broadcast(found)
    own = F.col(f"row.{key}")
    return prints.join(found, "fp").select(
        own.alias(key),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.coalesce("component_id", own).alias("component_id"),
    )


def word_prints(texts: list[bytes], views: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint of the words of each text in each view, hash of each text's words in order).

    A word weighs 1 plus the logarithm of its count, so that no frequent word decides alone.
    """
    known = numbering()
    parts, whole = [], []
    for words in (x.lower().split() for x in texts):
        parts.append(np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words)))
        whole.append(xxhash.xxh64_intdigest(b" ".join(words), SEED))
    # A word is hashed once; each view spreads that hash by another constant.
    once = np.fromiter(map(xxhash.xxh64_intdigest, known, repeat(SEED + 1)), dtype=np.uint64, count=len(known))
    hashes = _mix(once[:, None] + np.arange(1, views + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype("<u8")
    found = np.zeros((len(texts), views), dtype=np.uint64)
    for i, ids in enumerate(parts):
        own, n = np.unique(ids, return_counts=True)
        weight = np.floor(np.log2(n)) + 1
        total = np.zeros(64 * views)
        # The sums of a block are whole numbers far below 2^24, which single precision holds.
        for at in range(0, len(own), 1 << 13):
            bits = np.unpackbits(hashes[own[at : at + (1 << 13)]].view(np.uint8), axis=1, bitorder="little")
            total += weight[at : at + (1 << 13)].astype(np.float32) @ bits.astype(np.float32)
        found[i] = np.packbits(2 * total > weight.sum(), bitorder="little").view("<u8")
    return found.view(np.int64), np.array(whole, dtype=np.uint64).view(np.int64)


def _with_word_prints(docs: DataFrame, text: str, views: int) -> DataFrame:
    """The rows as the struct `row`, `whole` and `fps`."""
    columns = docs.columns
    chosen = docs.select(*carried(docs, columns, text))
    schema = StructType([chosen.schema[0]]).add("whole", "long").add("fps", ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, columns, text, 2 << 20):
            found, whole = word_prints(as_bytes(part.column("_text")), views)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * views, pa.int32()), pa.array(found.reshape(-1)))
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(whole), lists], names=["row", "whole", "fps"])

    return chosen.mapInArrow(run, schema)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """Sorted hashes of the different shingles of each text; a text without a word has none."""
    known = numbering()
    parts = [np.fromiter(map(known.__getitem__, x.lower().split()), dtype=np.int64) for x in texts]
    hashes = np.array([xxhash.xxh64_intdigest(w, SEED) for w in known], dtype=np.uint64)
    out = []
    for ids in parts:
        width = min(shingle, len(ids))
        found = np.full(len(ids) - width + 1 if width else 0, width, dtype=np.uint64)
        for j in range(width):
            found = _mix(found * np.uint64(0x9E3779B97F4A7C15) + hashes[ids[j : j + len(found)]])
        out.append(np.unique(found).view(np.int64))
    return out


def _shingle_sets(rows: DataFrame, text: str, shingle: int) -> DataFrame:
    """(whole, shingles): hashes of the different shingles of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text", 2 << 20):
            sets = shingle_sets(as_bytes(part.column("_text")), shingle)
            yield pa.RecordBatch.from_arrays([part.column("whole"), pa.array(sets, pa.list_(pa.int64()))], names=["whole", "shingles"])

    return rows.select("whole", F.col(f"row.`{text}`").alias("_text")).mapInArrow(run, "whole long, shingles array<long>")


def similar_texts(rows: DataFrame, text: str, shingle: int, similarity: float) -> DataFrame:
    """(a, b): links that connect different texts, by the hash of their words, that agree in some view and are similar enough."""
    prints = rows.select("whole", F.posexplode("fps").alias("view", "fp"))
    least = materialize(prints.groupBy("view", "fp").agg(F.min("whole").alias("whole"), F.max("whole").alias("other")), "view-prints")
    same = prints.join(least.filter("whole < other").select("view", "fp", F.col("whole").alias("head")), ["view", "fp"])
    same = same.filter("head <> whole").select(F.col("head").alias("a"), F.col("whole").alias("b"))
    # View by view: the keys of one are deleted before those of the next are written.
    views = rows.agg(F.max(F.size("fps"))).first()[0] or 0
    each = [links(least.filter(F.col("view") == v).select("view", "fp")) for v in range(max(views, 1))]
    apart = reduce(DataFrame.union, each)
    one = least.select("view", F.col("fp").alias("a"), F.col("whole").alias("left"))
    two = least.select("view", F.col("fp").alias("b"), F.col("whole").alias("right"))
    linked = apart.join(one, ["view", "a"]).join(two, ["view", "b"]).filter("left <> right")
    pairs = same.union(linked.select(F.least("left", "right").alias("a"), F.greatest("left", "right").alias("b")))
    found = connecting(rows, pairs, text, shingle, similarity)
    discard(least, *each)
    return found


def _alike(met: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b): texts `b` whose shingles are similar enough to those of the head before them.

    `met(a, b, _text)` has in every partition each head, with a null `b`, right before its members.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.empty(0, dtype=np.int64)
        for part in slices(batches, "_text", 2 << 20):
            rows = zip(part.column("a").to_pylist(), part.column("b").to_pylist(), shingle_sets(as_bytes(part.column("_text")), shingle))
            found = []
            for a, b, own in rows:
                if b is None:
                    head = own
                    continue
                shared = len(np.intersect1d(head, own, assume_unique=True))
                if shared >= similarity * (len(head) + len(own) - shared):
                    found.append((a, b))
            columns = [pa.array([pair[i] for pair in found], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b"])

    return met.select("a", "b", "_text").mapInArrow(run, "a long, b long")


def verified(rows: DataFrame, pairs: DataFrame, text: str, shingle: int, similarity: float) -> DataFrame:
    """A stored table of those of the pairs (a, b) whose texts are similar enough.

    Texts travel, not their sets, which are larger and cannot be compressed: each `b` to its `a`, MEMBERS
    of them for a copy of `a`. Pairs go in slices for which no more is sent than all texts take.
    """
    pairs = materialize(pairs.distinct(), "candidates")
    # Of rows with the same words one is read.
    first = rows.groupBy(F.col("whole").alias("own")).agg(F.min(F.struct("at", "bytes")).alias("first"))
    heads = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).alias("parts"))
    dealt = pairs.join(heads, "a").select("a", F.pmod(F.xxhash64("b"), "parts").alias("part"), "b")
    sent = dealt.union(dealt.select("a", "part", F.lit(None).cast("long")).distinct())
    sent = sent.join(first, F.coalesce("b", "a") == F.col("own")).select("a", "part", "b", "first.at", "first.bytes")
    sent = materialize(sent, "candidate-texts")
    total = sent.agg(F.sum("bytes")).first()[0] or 0
    whole = rows.agg(F.sum("bytes")).first()[0] or 0
    parts = int(-(-total // (whole or 1))) or 1
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // parts // TASK_BYTES))
    texts = rows.select("at", F.col(f"row.`{text}`").alias("_text"))
    drop_shuffles(rows.sparkSession)
    found = []
    for part in range(parts):
        own = sent.filter(F.pmod(F.xxhash64("a"), F.lit(parts)) == part).drop("bytes")
        met = texts.join(F.broadcast(own) if fits_broadcast(own) else own, "at")
        met = met.repartition(tasks, "a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
        found.append(materialize(_alike(met, shingle, similarity), "verified"))
        drop_shuffles(rows.sparkSession)
    alike = materialize(reduce(DataFrame.union, found), "verified")
    discard(pairs, sent, *found)
    return alike


def connecting(rows: DataFrame, pairs: DataFrame, text: str, shingle: int, similarity: float, edges: DataFrame | None = None) -> DataFrame:
    """A stored table of links that, with `edges`, connect the texts of all pairs (a, b), a < b, that are similar enough.

    While there are many pairs a text, every text is compared with one smaller candidate, which is the same
    for a whole crowd; pairs that are in one group by then need no comparison. What is left is compared in full.
    """
    left, found = materialize(pairs.distinct(), "pairs"), []
    for turn in range(STARS + 1):
        count, texts = left.agg(F.count("*"), F.count_distinct("b")).first()
        last = turn == STARS or count <= PAIRS_A_TEXT * texts
        own = left
        if not last:
            own = materialize(left.groupBy("b").agg(F.min_by("a", F.xxhash64("a", F.lit(turn))).alias("a")).select("a", "b"), "pairs")
        found.append(verified(rows, own, text, shingle, similarity))
        if last:
            break
        known = reduce(DataFrame.union, found if edges is None else [edges, *found])
        named = materialize(smallest_reachable(known, "a", "b"), "pair-roots")
        roots_of = [named.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in ("a", "b")]
        open_pairs = left.join(own, ["a", "b"], "left_anti").join(roots_of[0], "a", "left").join(roots_of[1], "b", "left")
        open_pairs = open_pairs.filter(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")
        before, left = left, materialize(open_pairs, "pairs")
        discard(before, own, named)
        drop_shuffles(rows.sparkSession)
    whole = materialize(reduce(DataFrame.union, found), "verified")
    discard(left, *found)
    return whole


def one_each(rows: DataFrame) -> DataFrame:
    """The first row of each text, by the hash of its words; which those are goes to the rows as one bit for each."""
    word, bit = F.floor(F.col("at") / 64).alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))")
    first = rows.groupBy("whole").agg(F.min("at").alias("at")).groupBy(word).agg(F.bit_or(bit).alias("bits"))
    marked = rows.withColumn("word", word).join(F.broadcast(materialize(first, "first-rows")), "word")
    return marked.filter(F.getbit("bits", (F.col("at") % 64).cast("int")) == 1).select(rows.columns)


def parities(own: np.ndarray) -> bytes:
    """A bit for each of as many classes of shingles as a text has, by a power of two: whether it has an odd number of them.

    A shingle that only one of two texts has turns over one bit, so that no more bits differ than such shingles.
    """
    bits = min(max(64, 1 << (max(len(own), 1) - 1).bit_length()), PARITY_BITS)
    odd = np.bincount((own.view(np.uint64) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def odd_bits(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """How many bits of each two `parities` differ; the longer one is folded, which gives that of fewer classes."""
    out = np.zeros(len(left), dtype=np.int64)
    sizes = np.array([[len(x), len(y)] for x, y in zip(left, right)], dtype=np.int64).reshape(-1, 2)
    for pair in np.unique(sizes, axis=0).tolist():
        which = np.flatnonzero((sizes == pair).all(axis=1))
        both = [np.frombuffer(b"".join(side[i] for i in which.tolist()), dtype="<u8").reshape(len(which), -1) for side in (left, right)]
        while both[0].shape[1] != both[1].shape[1]:
            k = int(both[1].shape[1] > both[0].shape[1])
            half = both[k].shape[1] // 2
            both[k] = both[k][:, :half] ^ both[k][:, half:]
        out[which] = np.bitwise_count(both[0] ^ both[1]).sum(axis=1, dtype=np.int64)
    return out


def plausible(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) without those whose `sketches(whole, size, odd)` say that too many shingles differ."""
    sides = [sketches.select(F.col("whole").alias(c), F.col("size").alias(f"size_{c}"), F.col("odd").alias(f"odd_{c}")) for c in ("a", "b")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            differ = odd_bits(batch.column("odd_a").to_pylist(), batch.column("odd_b").to_pylist())
            total = batch.column("size_a").to_numpy() + batch.column("size_b").to_numpy()
            # Of n and m shingles of which s are shared, n + m - 2 s differ, and s is at least (n + m) t / (1 + t).
            near = pa.array(differ <= total * (1 - similarity) / (1 + similarity) + 1e-6)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(near) for c in ("a", "b")], names=["a", "b"])

    met = pairs.distinct().join(sides[0], "a").join(sides[1], "b")
    return met.select("a", "b", "size_a", "size_b", "odd_a", "odd_b").mapInArrow(run, "a long, b long")


def _common(rows: DataFrame, text: str, shingle: int) -> np.ndarray:
    """Sorted shingles that many texts of a sample hold; at most COMMON_SHINGLES."""
    step = min(rows.count() // SAMPLE_TEXTS + 1, SAMPLE_STEP)
    sample = rows.filter(F.pmod("whole", F.lit(step)) == 0)
    each = _shingle_sets(sample, text, shingle).select(F.explode("shingles").alias("key"))
    often = each.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON)
    found = often.orderBy(F.desc("n")).limit(COMMON_SHINGLES).select("key").toPandas()
    return np.sort(found["key"].to_numpy(np.int64))


def _prefixes(rows: DataFrame, text: str, shingle: int, similarity: float) -> DataFrame:
    """(whole, size, keys, odd): the first shingles of each text in order, one of which any similar text has among its own."""
    shared = rows.sparkSession.sparkContext.broadcast(_common(rows, text, shingle))
    drop_shuffles(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for part in slices(batches, "_text", 2 << 20):
            sets = shingle_sets(as_bytes(part.column("_text")), shingle)
            firsts = []
            for own in sets:
                # Each is looked up among the common ones, whose number grows with the table.
                at = np.searchsorted(common, own)
                late = at < len(common)
                late[late] = common[at[late]] == own[late]
                ordered = np.concatenate([own[~late], own[late]])
                firsts.append(ordered[: len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1])
            sizes = pa.array([len(x) for x in sets], pa.int64())
            arrays = [part.column("whole"), sizes, pa.array(firsts, pa.list_(pa.int64())), pa.array([parities(x) for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["whole", "size", "keys", "odd"])

    chosen = rows.select("whole", F.col(f"row.`{text}`").alias("_text"))
    return chosen.mapInArrow(run, "whole long, size long, keys array<long>, odd binary")


def all_links(rows: DataFrame, text: str, shingle: int, similarity: float, edges: DataFrame) -> DataFrame:
    """`edges`, and links that connect with them all texts that are similar enough. `rows` has each text once."""
    found = materialize(_prefixes(rows, text, shingle, similarity), "prefixes")
    each = found.select("whole", "size", F.posexplode("keys").alias("pos", "key"))
    several = materialize(each.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "several")
    drop_shuffles(rows.sparkSession)
    shared = materialize(keep_matching(each, several, "key", SENT_BYTES).select("key", "whole", "size", "pos"), "shared-prefixes")
    sketches = materialize(found.select("whole", "size", "odd"), "sketches")
    discard(found, several)
    drop_shuffles(rows.sparkSession)
    for turn in range(STARS + 1):
        named = materialize(smallest_reachable(edges, "a", "b"), "simhash-roots")
        labelled = shared.select("key", "whole", "size", "pos").join(named, F.col("whole") == F.col("node"), "left")
        labelled = labelled.select("key", "whole", "size", "pos", F.coalesce("root", "whole").alias("root"))
        apart = labelled.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("key")
        before, shared = shared, materialize(labelled.join(apart, "key"), "open-prefixes")
        discard(before, named)
        drop_shuffles(rows.sparkSession)
        by_root = shared.groupBy("key", "root").agg(F.count("*").cast("double").alias("n"))
        by_key = by_root.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"))
        held, pairs = by_key.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("same")) / 2)).first()
        if not held:
            discard(shared, sketches)
            return edges
        last = turn == STARS or pairs <= PAIRS_A_ROW * held
        other = shared.select("key", *[F.col(c).alias(f"other_{c}") for c in ("whole", "size", "pos", "root")])
        if not last:
            best = F.min(F.struct(F.xxhash64("other_whole", F.lit(turn)), "other_whole", "other_size", "other_pos", "other_root")).alias("s")
            other = other.groupBy("key").agg(best).select("key", "s.other_whole", "s.other_size", "s.other_pos", "s.other_root")
        met = shared.join(other, "key").filter("root <> other_root")
        if last:
            met = met.filter("whole < other_whole")
        # A similarity is at most that of the sizes. The order is the same for all texts: from the first shingle on that
        # two of them share, neither can have fewer left than a similar pair shares.
        met = met.filter(F.least("size", "other_size") >= similarity * F.greatest("size", "other_size"))
        rest = F.least(F.col("size") - F.col("pos"), F.col("other_size") - F.col("other_pos"))
        met = met.filter(rest * (1 + similarity) + 1e-6 >= similarity * (F.col("size") + F.col("other_size")))
        pairs = met.select(F.least("whole", "other_whole").alias("a"), F.greatest("whole", "other_whole").alias("b"))
        near = materialize(plausible(pairs, sketches, similarity), "plausible")
        drop_shuffles(rows.sparkSession)
        more = connecting(rows, near, text, shingle, similarity, edges)
        before, edges = edges, materialize(edges.union(more), "simhash-links")
        discard(before, more, near)
        if last:
            discard(shared, sketches)
            return edges


def keep_first(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle: int = NEAR_SHINGLE,
    similarity: float = SIMILARITY,
    views: int = VIEWS,
) -> DataFrame:
    """One row of each group of near duplicates, with its own columns: that of the smallest id.

    Texts with the same words in the same order are one. Others are near duplicates if their
    sets of shingles have a Jaccard similarity of `similarity` or more, or if such texts connect
    them. First those are found whose fingerprints are linked in one of several views, in each of
    which words are hashed with another seed; fingerprints of words, not of shingles, because a
    changed word moves few of their bits. `all_links` adds the others. Rows without an id come last; if the smallest id occurs several times
    with one text, any one of these rows stays.
    """
    size = F.coalesce(F.octet_length(f"row.`{text}`"), F.lit(0)).cast("long")
    marked = _with_word_prints(docs, text, views).withColumns({"at": F.monotonically_increasing_id(), "bytes": size})
    rows = materialize(marked, "simhash-rows")
    own = F.col(f"row.`{key}`")
    edges = similar_texts(rows, text, shingle, similarity)
    drop_shuffles(rows.sparkSession)
    edges = all_links(one_each(rows), text, shingle, similarity, edges)
    named = materialize(smallest_reachable(edges, "a", "b"), "simhash-roots")
    held = rows.groupBy("whole", own.alias("id")).agg(F.count("*").alias("n"))
    held = held.join(named, held["whole"] == named["node"], "left").withColumn("root", F.coalesce("root", "whole"))
    best = F.min(F.struct(F.isnull("id").alias("none"), "id", "whole", "n")).alias("best")
    chosen = materialize(held.groupBy("root").agg(best).select("best.whole", "best.id", "best.n"), "simhash-chosen")
    chosen = chosen.withColumnsRenamed({"whole": "chosen_whole", "id": "chosen_id"})
    if fits_broadcast(chosen):
        chosen = F.broadcast(chosen)
    kept = rows.join(chosen, (F.col("whole") == F.col("chosen_whole")) & own.eqNullSafe(F.col("chosen_id")))
    several = kept.filter("n > 1").dropDuplicates(["whole"])
    return kept.filter("n = 1").union(several).select("row.*")
