"""The registered queries of these operators, and SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm import (
    bpe,
    clustering,
    exact_search,
    language_id,
    language_model,
    lexical_search,
    license_scan,
    packing,
    personal_data,
    quality_rules,
    simhash,
    suffix_dedup,
    token_counts,
)
from passagework.llm.common import fold, table
from passagework.session import materialize

TOKEN_LIMIT = 1024


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    models = language_id.train(docs, where=fold("doc_id", 3) != 1)
    found = language_id.predict(docs.withColumn("held_out", fold("doc_id", 3) == 1), models, ["doc_id", "held_out"])
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score", "rejected")


def op2_language_model(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("held_out", fold("doc_id", 10) == 0)
    found = language_model.score_texts(docs, ["doc_id", "held_out"], ~F.col("held_out"))
    return found.select("row.*", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    stats = materialize(quality_rules.with_stats(docs, ["doc_id"], "lang", "source"), "stats")
    return quality_rules.judge(stats).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op4_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.components(table(spark, folder, "documents"))


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    counted = token_counts.count_tokens(table(spark, folder, "documents"), path)
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(table(spark, folder, "documents"))


def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    found = packing.best_fit(table(spark, folder, "documents"), ["doc_id"])
    return found.select("row.doc_id", "piece", "first_word", "size", "bin_id", "capacity")


def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, folder, "documents"), ["doc_id"]).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_exact_search(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return exact_search.top_k(vectors, F.col("vec_id") % 20 == 0)


def op10_bpe_codec(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode_texts(table(spark, folder, "documents"), path, digest=True)


def op11_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return clustering.cluster(table(spark, folder, "embeddings"))


def op12_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    model = personal_data.train(personal_data.labelled_table(spark))
    found = personal_data.find(table(spark, folder, "documents"), ["doc_id"], model)
    return found.select("row.doc_id", *personal_data.digests())


def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.rank(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def _clusters_sql(k: int = 8, rounds: int = 10) -> str:
    """The rounds written out one after the other; all numbers stay far below 2^53, where doubles are exact."""
    steps = []
    for turn in range(rounds + 1):
        steps.append(
            f"""a{turn} as materialized (
  select r, arg_min(cluster, {{'d': d, 'c': cluster}}) as cluster, min(d) as distance from (
    select p.r, c.cluster, cast(list_inner_product(p.w, p.w) - 2 * list_inner_product(p.w, c.w) + list_inner_product(c.w, c.w) as bigint) as d
    from points p cross join c{turn} c) group by r)"""
        )
        if turn < rounds:
            steps.append(
                f"""c{turn + 1} as materialized (
  select c.cluster, coalesce(m.w, c.w) as w from c{turn} c left join (
    select cluster, list(cast(case when s % n < 0 then (s - s % n) // n - 1 else s // n end as double) order by axis) as w
    from (select cluster, axis, sum(x) as s, count(*) as n
          from (select a.cluster, cast(unnest(p.w) as bigint) as x, unnest(range(64)) as axis from a{turn} a join points p using (r))
          group by cluster, axis) group by cluster) m using (cluster))"""
            )
    return f"""with points as materialized (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as w
  from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as materialized (
  select row_number() over (order by h, w) - 1 as cluster, w
  from (select sha256('3:' || vec_id) as h, w from points where vec_id is not null order by h, w limit {k})),
{", ".join(steps)},
totals as (select cluster, cast(sum(distance) as bigint) as cluster_inertia from a{rounds} group by cluster)
select p.vec_id, cast(a.cluster as integer) as cluster, a.distance, t.cluster_inertia,
  (select cast(sum(cluster_inertia) as bigint) from totals) as inertia,
  sha256(array_to_string(list_transform(c.w, lambda x: cast(x as bigint)), ',')) as centroid_sha256
from a{rounds} a join points p using (r) join totals t using (cluster) join c{rounds} c using (cluster)"""


_TERMS = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)

LEXICAL_SEARCH = f"""with words as materialized (select row_number() over () as r, doc_id, {_TERMS} as w from documents),
sized as materialized (select r, doc_id, len(w) as n from words where len(w) > 0),
corpus as (select count(*) as docs, cast(sum(n) as bigint) as total from sized),
tf as materialized (select r, term, count(*) as tf from (select r, unnest(w) as term from words) group by r, term),
items as (
  select i, item_id, term, count(*) as times
  from (select i, item_id, unnest(w) as term from (select row_number() over () as i, item_id, {_TERMS} as w from benchmark))
  group by i, item_id, term),
weights as (
  select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) as bigint) as w from tf cross join corpus group by term, docs),
lengths as (select r, doc_id, 75 + (25 * n * docs) // total as m from sized cross join corpus),
scored as (
  select i, item_id, r, doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) as bigint) as score
  from items join weights using (term) join tf using (term) join lengths using (r) group by i, item_id, r, doc_id)
select item_id, cast(rank as integer) as rank, doc_id, score
from (select *, row_number() over (partition by i order by score desc, doc_id) as rank from scored where score > 0) where rank <= 20"""


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("op") and name[2].isdigit()}
SQL: dict[str, str] = {"op11_centroid_clusters": _clusters_sql(), "op13_lexical_search": LEXICAL_SEARCH}
