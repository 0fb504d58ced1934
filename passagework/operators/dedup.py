"""Exact and near duplicates, decided as if documents arrived one by one.

A document is dropped when an earlier *kept* document has the same content hash
or a signature agreeing on at least the threshold. The work per document does
not grow with the size of its group of copies:

* equal hashes and equal signatures collapse to their first document by a plain
  aggregate, before any comparison;
* the rest meet in band buckets. In a few rounds every member is compared with at
  most one document per bucket, the earliest undecided one, once it is known to be
  kept, so that dense groups shrink without forming their pairs;
* what is still undecided is compared in bounded blocks, and decided on the pairs found.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.defaults import NEAR_THRESHOLD, PERMUTATIONS
from passagework.operators.signatures import agreement, bands
from passagework.operators.sizing import ROWS_PER_TASK, drop_matching, hot_keys, keep_matching, salted_join
from passagework.session import discard, materialize

# Earlier records that count as kept. Superseded ones do, as they do within one
# batch, so the outcome does not depend on where a stream is cut into batches.
MATCHED = ("pending", "processing", "indexed", "superseded")
# Rounds in which each bucket's earliest document is compared with the others. They
# thin out groups of copies, whose pairs would be many; what is left is compared in pairs.
LEADER_ROUNDS = 3
# Members of a bucket whose pairs are formed as rows, and of a block beyond that.
FEW = 64
BLOCK = 2_000


def first_by(df: DataFrame, key: str, order: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Every row with `first`, the smallest `order` under the same `key`."""
    groups = df.groupBy(key).agg(F.min(order).alias("first"), F.count("*").alias("n"))
    hot = hot_keys(groups.select(key, "n"), "n", rows_per_task)
    return salted_join(df, groups.drop("n"), [key], hot, order)


def exact_duplicates(docs: DataFrame, order: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(order, content_hash, first, is_duplicate) for documents with a `content_hash`."""
    found = first_by(docs.select(order, "content_hash"), "content_hash", order, rows_per_task)
    return found.withColumn("is_duplicate", F.col(order) > F.col("first"))


def _verified(pairs: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """Pairs (id, other) whose signatures agree enough, with the `similarity`.

    Signatures are wide, and most documents are in no pair: only those that are leave the table.
    """
    pairs = materialize(pairs, "pairs")
    near = keep_matching(signed, pairs.select("id").union(pairs.select("other")), "id")
    mine = near.select("id", F.col("signature").alias("sig_id"))
    theirs = near.select(F.col("id").alias("other"), F.col("signature").alias("sig_other"))
    return (
        pairs.join(mine, "id")
        .join(theirs, "other")
        .select("id", "other", agreement(F.col("sig_id"), F.col("sig_other")).alias("similarity"))
        .filter(F.col("similarity") >= threshold)
    )


def _meet(members: DataFrame, heads: DataFrame, rows_per_task: int) -> DataFrame:
    """Distinct (id, other): members paired with the earlier heads of their buckets."""
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n"))
    hot = hot_keys(sizes, "n", rows_per_task)
    met = salted_join(members, heads, ["bucket"], hot, "id")
    return met.filter(F.col("other") < F.col("id")).select("id", "other").distinct()


def _similar(live: DataFrame, pool: DataFrame, threshold: float, rows_per_task: int) -> DataFrame:
    """(id, other), other < id: all pairs of `live(id, bucket)` that share a bucket and agree enough.

    Pairs of small buckets become rows and are verified by a join. Large buckets
    are cut into blocks; every two blocks meet in one task, which compares the signatures
    and lets only pairs above the threshold out.
    """
    sizes = live.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    counted = salted_join(live, sizes, ["bucket"], hot_keys(sizes, "n", rows_per_task), "id")
    counted = materialize(counted, "counted")
    listed = counted.filter(F.col("n") <= FEW).groupBy("bucket").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    pairs = listed.select(F.explode("ids").alias("id"), "ids").select(
        "id", F.explode(F.expr("filter(ids, o -> o < id)")).alias("other")
    )
    few = _verified(pairs.distinct(), pool, threshold).select("id", "other")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = counted.filter(F.col("n") > FEW).withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    met = own.select("id", "bucket", "own", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("with"))
    met = met.join(keep_matching(pool, own, "id"), "id")
    met = met.select("id", "signature", "bucket", "own", F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high"))
    kind = live.schema["id"].dataType.simpleString()

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        ids, own = part["id"].to_numpy(), part["own"].to_numpy()
        signatures = np.array(part["signature"].tolist(), dtype=np.int64)
        across = part["low"].iloc[0] != part["high"].iloc[0]
        later, earlier = [], []
        for at in range(1, len(ids)):
            near = (signatures[:at] == signatures[at]).mean(axis=1) >= threshold
            if across:
                near &= own[:at] != own[at]
            found = ids[:at][near]
            earlier.append(found)
            later.append(np.full(len(found), ids[at]))
        none = np.empty(0, dtype=ids.dtype)
        return pd.DataFrame({"id": np.concatenate(later or [none]), "other": np.concatenate(earlier or [none])})

    many = met.groupBy("bucket", "low", "high").applyInPandas(compare, f"id {kind}, other {kind}")
    return few.unionByName(many).distinct()


def _resolve(edges: DataFrame) -> list[DataFrame]:
    """Ids to drop, given similar pairs: one by one in order, each dropped if an earlier kept one is similar.

    A round keeps every document without an undecided earlier neighbour and drops its
    neighbours. From the second round on, documents that wait for a single other one are
    decided along whole chains (`_chains`), so a chain takes rounds by the logarithm of its
    length; only documents that wait for several undecided ones each wait for a round.
    """
    lost = []
    first = True
    while not edges.isEmpty():
        waiting = edges.select("id").distinct()
        kept = edges.select(F.col("other").alias("id")).distinct().join(waiting, "id", "left_anti")
        dropped = None
        if not first:
            kept = materialize(kept, "free")
            ends = _chains(edges).join(kept.withColumnRenamed("id", "to"), "to", "left_semi")
            kept = kept.unionByName(ends.filter("not odd").select("id"))
            dropped = ends.filter("odd").select("id")
        gone = edges.join(kept.withColumnRenamed("id", "other"), "other", "left_semi").select("id")
        gone = materialize((gone if dropped is None else gone.unionByName(dropped)).distinct(), "dropped")
        lost.append(gone)
        rest = edges.join(gone, "id", "left_anti").join(gone.withColumnRenamed("id", "other"), "other", "left_anti")
        edges = materialize(rest, "undecided")
        first = False
    return lost


def _chains(edges: DataFrame) -> DataFrame:
    """(id, to, odd) of documents that wait for one other: kept if and only if `to` is, or is not where `odd`.

    Pointers skip to where their targets point, which halves a chain each time.
    """
    waits = edges.groupBy("id").agg(F.count_distinct("other").alias("n"), F.min("other").alias("to"))
    now = materialize(waits.filter("n = 1").select("id", "to", F.lit(True).alias("odd")), "pointers")
    while True:
        further = now.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("odd").alias("turned"))
        met = materialize(now.join(further, "to", "left"), "pointers")
        discard(now)
        if met.filter("next is not null").isEmpty():
            return met.select("id", "to", "odd")
        odd = F.when(F.col("next").isNull(), F.col("odd")).otherwise(F.col("odd") != F.col("turned"))
        now = materialize(met.select("id", F.coalesce("next", "to").alias("to"), odd.alias("odd")), "pointers")
        discard(met)


def keep_first(
    signed: DataFrame,
    threshold: float = NEAR_THRESHOLD,
    permutations: int = PERMUTATIONS,
    seeds: DataFrame | None = None,
    copies: DataFrame | None = None,
    rows_per_task: int = ROWS_PER_TASK,
    stored: DataFrame | None = None,
) -> DataFrame:
    """Near-duplicate decision for `signed(id, signature)`, ids in arrival order.

    Returns (id, match, similarity): match is NULL for kept documents, else the
    most similar earlier kept one, the later of equals. `seeds(id, signature)`
    are earlier documents that are kept already. `copies(id, head)` are later
    documents equal to one of `signed`; they are matched, too, without having been
    signed. A NULL signature never matches. `stored(id, signature)` is a stored table that
    holds the rows of `signed`, if that is none; without it they are written once more.
    """
    spark = signed.sparkSession
    usable = signed.filter("signature is not null").select("id", "signature")
    pool = materialize(usable, "signed") if stored is None else stored
    if stored is None:
        usable = pool
    keyed = usable.select("id", F.sha2(F.array_join("signature", ","), 256).alias("sig_key"))
    members = first_by(materialize(keyed, "signature-keys"), "sig_key", "id", rows_per_task)
    members = materialize(members.select("id", F.col("first").alias("rep")), "members")
    reps = drop_matching(usable, members.filter("id > rep"), "id")
    buckets = materialize(bands(reps, "id", permutations, threshold), "buckets")
    seed_heads = None
    if seeds is not None:
        # Of the earlier documents only those sharing a bucket with a new one matter.
        seeds = seeds.filter("signature is not null").select("id", "signature")
        touched = keep_matching(bands(seeds, "id", permutations, threshold), buckets, "bucket")
        seed_heads = materialize(touched.withColumnRenamed("id", "other"), "seed-buckets")
        near_seeds = keep_matching(seeds, seed_heads.select(F.col("other").alias("id")), "id")
        pool = pool.unionByName(materialize(near_seeds, "seeds"))

    # Only buckets with company can hold a candidate.
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    sizes = materialize(sizes, "shared-buckets")
    live = salted_join(
        buckets, sizes.select("bucket"), ["bucket"], hot_keys(sizes, "n", rows_per_task), "id"
    )
    dropped: list[DataFrame] = []
    if seed_heads is not None:
        gone = _verified(_meet(buckets, seed_heads, rows_per_task), pool, threshold)
        gone = materialize(gone.select("id").distinct(), "dropped")
        dropped.append(gone)
        live = live.join(gone, "id", "left_anti")
    live = materialize(live, "live")
    for _ in range(LEADER_ROUNDS):
        if live.isEmpty():
            break
        leaders = materialize(live.groupBy("bucket").agg(F.min("id").alias("other")), "leaders")
        leads = leaders.groupBy(F.col("other").alias("id")).agg(F.count("*").alias("leads"))
        free = (
            live.groupBy("id")
            .agg(F.count("*").alias("has"))
            .join(leads, "id")
            .filter("leads = has")
            .select("id")
        )
        free = materialize(free, "kept")
        heads = leaders.join(free.withColumnRenamed("id", "other"), "other")
        gone = _verified(_meet(live, heads, rows_per_task), pool, threshold)
        gone = materialize(gone.select("id").distinct(), "dropped")
        dropped.append(gone)
        decided = free.unionByName(gone)
        live = materialize(live.join(decided, "id", "left_anti"), "live")

    dropped += _resolve(materialize(_similar(live, pool, threshold, rows_per_task), "similar"))

    lost = spark.createDataFrame([], usable.select("id").schema)
    for part in dropped:
        lost = lost.unionByName(part)
    lost = materialize(lost, "lost")
    # A signature first seen on a dropped document may recur after further
    # documents were kept, so candidates are not limited to those before the first.
    lost_buckets = materialize(keep_matching(buckets, lost, "id"), "lost-buckets")
    heads = keep_matching(drop_matching(buckets, lost, "id"), lost_buckets, "bucket").withColumnRenamed("id", "other")
    if seed_heads is not None:
        heads = heads.unionByName(seed_heads)
    sizes = lost_buckets.groupBy("bucket").agg(F.count("*").alias("n"))
    met = salted_join(
        lost_buckets, heads, ["bucket"], hot_keys(sizes, "n", rows_per_task), "id"
    ).select("id", "other").distinct()
    options = _verified(met, pool, threshold).withColumnRenamed("id", "rep")
    asked = signed.select("id")
    if copies is not None:
        counts = copies.groupBy("head").agg(F.count("*").alias("n"))
        hot = hot_keys(counts, "n", rows_per_task)
        like_head = members.withColumnRenamed("id", "head")
        copied = salted_join(copies, like_head, ["head"], hot, "id").select("id", "rep")
        members = materialize(members.unionByName(copied), "members")
        asked = asked.unionByName(copies.select("id"))
    # Copies of a kept signature match it exactly; copies of a dropped one choose
    # among the few kept documents its first occurrence may match.
    own = members.join(lost.withColumnRenamed("id", "rep"), "rep", "left_anti").filter("id > rep")
    own = own.select("id", F.col("rep").alias("match"), F.lit(1.0).alias("similarity"))
    rest = members.join(lost.withColumnRenamed("id", "rep"), "rep", "left_semi")
    counts = rest.groupBy("rep").agg(F.count("*").alias("n"))
    chosen = (
        salted_join(rest, options, ["rep"], hot_keys(counts, "n", rows_per_task), "id")
        .filter(F.col("other") < F.col("id"))
        .groupBy("id")
        .agg(F.max(F.struct("similarity", "other")).alias("best"))
        .select("id", F.col("best.other").alias("match"), F.col("best.similarity").alias("similarity"))
    )
    return asked.join(own.unionByName(chosen), "id", "left")


def match_earlier(
    docs: DataFrame,
    kept: DataFrame,
    threshold: float = NEAR_THRESHOLD,
    permutations: int = PERMUTATIONS,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """(id, outcome, match, similarity) of those `docs` that an earlier one of `kept` matches.

    Both are stored tables of (id, content_hash, signature); no two of `kept` match each other.
    """
    hashes = docs.groupBy("content_hash").agg(F.count("*").alias("n"))
    same = kept.select("content_hash", F.col("id").alias("match"))
    exact = salted_join(docs.select("id", "content_hash"), same, ["content_hash"], hot_keys(hashes, "n", rows_per_task), "id")
    exact = exact.filter("match < id").select("id", F.lit("duplicate").alias("outcome"), "match", F.lit(1.0).alias("similarity"))
    exact = materialize(exact, "exact-matches")
    key = F.sha2(F.array_join("signature", ","), 256)
    members = docs.filter("signature is not null").join(exact, "id", "left_anti").withColumn("sig_key", key)
    reps = members.groupBy("sig_key").agg(F.any_value("signature").alias("signature"))
    reps = materialize(reps.withColumnRenamed("sig_key", "id"), "barred-signatures")
    near = kept.filter("signature is not null")
    mine, theirs = bands(reps, "id", permutations, threshold), bands(near, "id", permutations, threshold)
    sizes = mine.groupBy("bucket").agg(F.count("*").alias("n"))
    met = salted_join(mine, theirs.withColumnRenamed("id", "other"), ["bucket"], hot_keys(sizes, "n", rows_per_task), "id")
    met = met.select("id", "other").distinct().join(reps.withColumnRenamed("signature", "sig_id"), "id")
    met = met.join(near.select(F.col("id").alias("other"), F.col("signature").alias("sig_other")), "other")
    alike = met.withColumn("similarity", agreement(F.col("sig_id"), F.col("sig_other"))).filter(F.col("similarity") >= threshold)
    counts = members.groupBy("sig_key").agg(F.count("*").alias("n"))
    options = alike.select(F.col("id").alias("sig_key"), "other", "similarity")
    chosen = salted_join(members.select("id", "sig_key"), options, ["sig_key"], hot_keys(counts, "n", rows_per_task), "id")
    best = chosen.filter("other < id").groupBy("id").agg(F.max(F.struct("similarity", "other")).alias("best"))
    return exact.unionByName(
        best.select("id", F.lit("near_duplicate").alias("outcome"), F.col("best.other").alias("match"), F.col("best.similarity").alias("similarity"))
    )


def deduplicate(
    docs: DataFrame,
    order: str,
    threshold: float = NEAR_THRESHOLD,
    permutations: int = PERMUTATIONS,
    registry: DataFrame | None = None,
    match_statuses: tuple[str, ...] = MATCHED,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Outcome of every document: new, duplicate or near_duplicate, and of which one.

    `docs` has `order` (unique, ascending in arrival), `content_hash` and
    `signature`. `registry(order, content_hash, signature, status)` holds earlier
    documents. Returns (order, outcome, match, similarity). Both inputs are read
    several times, so they should be stored.
    """
    docs = docs.select(F.col(order).alias("id"), "content_hash", "signature")
    if registry is not None:
        known = registry.filter(F.col("status").isin(*match_statuses)).select(
            F.col(order).alias("id"), "content_hash", "signature"
        )
        known_hash = keep_matching(known.select("id", "content_hash"), docs, "content_hash")
        known_hash = known_hash.groupBy("content_hash").agg(F.min("id").alias("known"))
        exact = salted_join(
            docs.select("id", "content_hash"),
            known_hash,
            ["content_hash"],
            hot_keys(docs.groupBy("content_hash").agg(F.count("*").alias("n")), "n", rows_per_task),
            "id",
        ).select("id", F.col("known").alias("match"))
        docs = materialize(docs.join(exact, "id", "left_anti"), "hashed")
    firsts = materialize(first_by(docs.select("id", "content_hash"), "content_hash", "id", rows_per_task), "firsts")
    copies = firsts.filter("id > first").select("id", F.col("first").alias("head"))
    seeds = known.select("id", "signature") if registry is not None else None
    signed = drop_matching(docs.select("id", "signature"), copies, "id")
    near = keep_first(signed, threshold, permutations, seeds, copies, rows_per_task, docs.select("id", "signature"))
    # The head of a group of copies is kept exactly when the copies match it. Copies
    # of a dropped head find no record with their hash and are near duplicates, too.
    is_new = (F.col("id") == F.col("first")) & F.col("match").isNull()
    is_copy = F.col("match").isNull() | (F.col("match") == F.col("first"))
    out = firsts.join(near, "id").select(
        "id",
        F.when(is_new, "new").when(is_copy, "duplicate").otherwise("near_duplicate").alias("outcome"),
        F.when(~is_new, F.coalesce("match", "first")).alias("match"),
        F.when(~is_new, F.coalesce("similarity", F.lit(1.0))).alias("similarity"),
    )
    if registry is not None:
        out = out.unionByName(
            exact.select("id", F.lit("duplicate").alias("outcome"), "match", F.lit(1.0).alias("similarity"))
        )
    return out.withColumnRenamed("id", order)
