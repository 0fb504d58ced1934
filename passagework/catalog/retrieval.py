"""Queries on sparse, dense and hybrid retrieval; the benchmark texts are the queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagework.catalog import fragments as sql
from passagework.catalog import table, texts
from passagework.functions.text import split_sentences, tokenize
from passagework.operators import cells, dense, fusion, sparse
from passagework.operators.answering import citations as cite
from passagework.operators.answering import contexts, draft_messages, Templates
from passagework.operators.chunking import chunk_fixed
from passagework.operators.evaluation import retrieval_eval as evaluate
from passagework.operators.sizing import keep_matching
from passagework.session import materialize


def chunks(spark, folder):
    return chunk_fixed(texts(spark, folder, "documents"))


def asked(spark, folder):
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("qid"), "text")


def query_vectors(rows):
    embedded = rows.select("qid", fusion.embed_text(F.col("text")).alias("vector"))
    return embedded.filter(fusion.has_length(F.col("vector")))


def bm25_stats(spark, folder):
    index = sparse.build_index(chunks(spark, folder))
    count = index.stats.select("n_chunks").scalar()
    average = index.stats.select(F.round("avg_len", 6)).scalar()
    return index.terms.select("term", "df", F.round("idf", 6).alias("idf"), count.alias("n_chunks"), average.alias("avg_len"))


def postings(spark, folder):
    return sparse.postings(sparse.bags(chunks(spark, folder)))


def postings_append(spark, folder):
    """Frequencies after English documents join an index and German ones leave it."""
    docs = texts(spark, folder, "documents").withColumnRenamed("doc_id", "chunk_id")

    def frequency(rows):
        return sparse.document_frequency(sparse.bags(rows))

    return sparse.merge_frequency(
        frequency(docs.filter("lang <> 'en'")),
        frequency(docs.filter("lang = 'en'")),
        frequency(docs.filter("lang = 'de'")),
    )


def _shown(ranked):
    return ranked.select("qid", "chunk_id", F.round("score", 6).alias("score"), "rank")


def bm25_topk(spark, folder):
    index = sparse.build_index(chunks(spark, folder))
    return _shown(sparse.bm25_topk(index, asked(spark, folder)))


def dense_topk(spark, folder):
    """Every stored vector as a query against all stored vectors."""
    rows = table(spark, folder, "embeddings")
    vectors = rows.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return _shown(dense.dense_topk(vectors, vectors.withColumnRenamed("chunk_id", "qid")))


def dense_cells(spark, folder):
    """Recall of the approximate search against the exact lists for every vector as a query, and the share of vectors it reads."""
    rows = table(spark, folder, "embeddings")
    vectors = rows.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    queries = vectors.withColumnRenamed("chunk_id", "qid")
    index = cells.build(vectors, k=10)
    found = cells.search(index, queries, 10).select("qid", "chunk_id", F.lit(1).alias("hit"))
    exact = dense.dense_topk(vectors, queries, 10).select("qid", "chunk_id")
    met = exact.join(found, ["qid", "chunk_id"], "left")
    recall = met.groupBy("qid").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall_at_10"))
    return recall.join(cells.share_read(index, queries), "qid").withColumn("share", F.round("share", 6))


def _index(spark, folder):
    return fusion.build_hybrid_index(chunks(spark, folder))


def _fused(spark, folder):
    return fusion.hybrid_candidates(_index(spark, folder), asked(spark, folder))


def rrf_fuse(spark, folder):
    return _fused(spark, folder).select("qid", "chunk_id", F.round("score", 9).alias("score"), "rank")


def hybrid_topk(spark, folder):
    return fusion.first_ranks(_fused(spark, folder)).select(
        "qid", "chunk_id", F.round("score", 9).alias("score"), "rank"
    )


def hybrid_rerank(spark, folder):
    index, queries = _index(spark, folder), asked(spark, folder)
    fused = fusion.hybrid_candidates(index, queries)
    return _shown(fusion.rerank(fused, queries, index.chunks))


def vector_upsert(spark, folder):
    """Stored vectors, then a second batch that renews some and has some of the wrong length."""
    rows = table(spark, folder, "embeddings")
    old = rows.select(F.col("vec_id").alias("chunk_id"), "label", F.col("embedding").alias("vector"), F.lit(0).alias("batch"))
    doubled = F.transform("vector", lambda x: x * 2)
    cut = F.slice("vector", 1, 32)
    new = old.filter("label >= 5").withColumn("vector", F.when(F.col("label") == 9, cut).otherwise(doubled))
    store, _ = dense.upsert(old, new.withColumn("batch", F.lit(1)), 64)
    return store.select("chunk_id", "batch", F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("first_value"))


def _contexts(spark, folder):
    index = _index(spark, folder)
    return contexts(fusion.hybrid_topk(index, asked(spark, folder)), index.chunks)


def context_block(spark, folder):
    return _contexts(spark, folder).select("qid", "context_text")


def prompt_table(spark, folder):
    """The messages of the first draft for every query."""
    none = F.lit(None).cast("struct<verdict:string,issues:array<string>>")
    rows = _contexts(spark, folder).join(asked(spark, folder), "qid")
    rows = rows.withColumn("critique", none).withColumn("draft", F.lit(None).cast("string"))
    talk = draft_messages(Templates())
    return rows.select(
        "qid", F.get(talk, F.lit(0))["content"].alias("system"), F.get(talk, F.lit(1))["content"].alias("user")
    )


def citations(spark, folder):
    """Marks in a made-up draft per query: one that depends on the text, two equal, one out of range."""
    rows = _contexts(spark, folder).join(asked(spark, folder), "qid")
    mark = (F.length("text") % 7 + 1).cast("string")
    draft = F.concat(F.col("text"), F.lit(" ["), mark, F.lit("] [2] [2] [9]"))
    found = rows.select("qid", F.posexplode(cite(draft, F.col("context"))).alias("pos", "c"))
    return found.select("qid", "pos", "c.chunk_id", "c.document_id", "c.source", "c.quote")


def golden(spark, folder):
    """(qid, source): sources of documents that share a whole sentence with the query."""
    mine = asked(spark, folder).select("qid", F.explode(split_sentences(F.col("text"))).alias("sentence"))
    theirs = texts(spark, folder, "documents").select(
        "source", F.explode(split_sentences(F.col("text"))).alias("sentence")
    )
    # Query sentences first, once each: the document side is cut to matches where it is read.
    mine = materialize(mine.filter(F.size(tokenize(F.col("sentence"))) >= 5).distinct(), "asked-sentences")
    found = keep_matching(theirs, mine, "sentence").distinct()
    return found.join(mine, "sentence").select("qid", "source").distinct()


def retrieval_eval(spark, folder):
    index, queries = _index(spark, folder), asked(spark, folder)
    rows = index.chunks
    # Four modes read the two lists, so they are computed once and written down.
    lexical = materialize(sparse.bm25_topk(index.sparse, queries), "sparse")
    near = materialize(dense.dense_topk(index.vectors, query_vectors(queries)), "dense")
    fused = materialize(fusion.rrf_fuse(near, lexical), "fused")
    modes = {"bm25": lexical, "dense": near, "hybrid_rrf": fused, "hybrid_rerank": fusion.rerank(fused, queries, rows)}
    results = None
    for mode, ranked in modes.items():
        part = ranked.filter("rank <= 5").select(F.lit(mode).alias("mode"), "qid", "chunk_id", "rank")
        results = part if results is None else results.unionByName(part)
    sources = rows.select("chunk_id", F.col("metadata")["source"].alias("source"))
    found = fusion.with_text(materialize(results, "results"), sources)
    # Asked for twice: by the hits and by the questions without any.
    scores = evaluate(found, materialize(golden(spark, folder), "golden"))
    return scores.select("mode", "questions", *[F.round(c, 6).alias(c) for c in ("hit_at_1", "hit_at_3", "mrr")])


QUERIES = {
    "bm25_stats": bm25_stats,
    "postings": postings,
    "postings_append": postings_append,
    "bm25_topk": bm25_topk,
    "dense_topk": dense_topk,
    "dense_cells": dense_cells,
    "rrf_fuse": rrf_fuse,
    "hybrid_topk": hybrid_topk,
    "hybrid_rerank": hybrid_rerank,
    "vector_upsert": vector_upsert,
    "context_block": context_block,
    "prompt_table": prompt_table,
    "citations": citations,
    "retrieval_eval": retrieval_eval,
}

_CONTEXT = f"""{sql.HYBRID},
ctx as (
  select f.qid, f.rank, c.chunk_id, c.doc_id::varchar as document_id, c.source, c.text
  from fused f join chunks c using (chunk_id) where f.rank <= 5),
block as (
  select qid, string_agg('[' || rank || '] ' || text, chr(10) || chr(10) order by rank) as context_text
  from ctx group by qid)"""

_GOLDEN = f"""
bs as (select distinct item_id as qid, s from (
  select item_id, unnest({sql.sentences("text")}) as s from benchmark) where len({sql.tokens("s")}) >= 5),
ds as (select source, unnest({sql.sentences("text")}) as s from documents),
golden as (select distinct qid, source from bs join ds using (s))"""

SQL = {
    "bm25_stats": f"""with {sql.CHUNKS},
        words as materialized (select chunk_id, {sql.tokens("text")} as w from chunks),
        corpus as materialized (select count(*) as n, round(avg(len(w)), 6) as avg_len from words),
        df as materialized (select term, count(*) as df from (select unnest(list_distinct(w)) as term from words) group by term),
        raw as materialized (select term, df, ln(n - df + 0.5) - ln(df + 0.5) as raw, n, avg_len from df cross join corpus),
        floored as materialized (select 0.25 * avg(raw) as least from raw)
        select term, df, round(case when raw < 0 then least else raw end, 6) as idf, n as n_chunks, avg_len
        from raw cross join floored""",
    "postings": f"with {sql.CHUNKS}, {sql.SPARSE} select chunk_id, term, tf::int as tf from tf",
    "postings_append": f"""select term, count(distinct doc_id) as df
        from (select doc_id, unnest({sql.tokens("text")}) as term from documents where lang <> 'de') group by term""",
    "bm25_topk": f"with {sql.CHUNKS}, {sql.SPARSE} select qid, chunk_id, round(score, 6) as score, rank from sparse",
    "dense_topk": """with v as (
          select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
        n as (select vec_id, e, sqrt(list_dot_product(e, e)) as norm from v),
        s as (select q.vec_id as qid, c.vec_id as chunk_id,
                     round(list_dot_product(q.e, c.e) / (q.norm * c.norm), 9) as score from n q, n c)
        select qid, chunk_id, round(score, 6) as score, rank from (
          select *, (row_number() over (partition by qid order by score desc, chunk_id))::int as rank from s)
        where rank <= 20""",
    "rrf_fuse": f"with {sql.HYBRID} select qid, chunk_id, round(score, 9) as score, rank from fused",
    "hybrid_topk": f"with {sql.HYBRID} select qid, chunk_id, round(score, 9) as score, rank from fused where rank <= 5",
    "hybrid_rerank": f"with {sql.HYBRID}, {sql.RERANKED} select qid, chunk_id, round(score, 6) as score, rank from reranked",
    "vector_upsert": """select vec_id as chunk_id, case when label between 5 and 8 then 1 else 0 end as batch,
          round((embedding[1] * case when label between 5 and 8 then 2 else 1 end)::double, 6) as first_value
        from embeddings""",
    "context_block": f"with {_CONTEXT} select qid, context_text from block",
    "prompt_table": f"""with {_CONTEXT}
        select qid, 'Answer from the numbered passages only and cite them like [1].' || chr(10) || chr(10) || 'Passages:' || chr(10) || context_text as system, b.text as user
        from block join benchmark b on b.item_id = qid""",
    "citations": f"""with {_CONTEXT},
        marks as (
          select item_id as qid, unnest([length(text) % 7 + 1, 2, 9]) as n, unnest([1, 2, 4]) as at from benchmark),
        used as (select m.qid, m.n, min(m.at) as at from marks m join ctx on ctx.qid = m.qid and ctx.rank = m.n group by all)
        select u.qid, (row_number() over (partition by u.qid order by u.at) - 1)::int as pos,
               c.chunk_id, c.document_id, c.source, substring(c.text, 1, 200) as quote
        from used u join ctx c on c.qid = u.qid and c.rank = u.n""",
    "retrieval_eval": f"""with {sql.HYBRID}, {sql.RERANKED}, {_GOLDEN},
        results as (
          select 'bm25' as mode, qid, chunk_id, rank from sparse
          union all select 'dense', qid, chunk_id, rank from dense
          union all select 'hybrid_rrf', qid, chunk_id, rank from fused
          union all select 'hybrid_rerank', qid, chunk_id, rank from reranked),
        hits as (
          select r.mode, r.qid, min(r.rank) as rank
          from results r join chunks c using (chunk_id) join golden g on g.qid = r.qid and g.source = c.source
          where r.rank <= 5 group by all),
        asked as (select m.mode, q.qid from (select distinct qid from golden) q, (select distinct mode from results) m)
        select a.mode, count(*) as questions,
               round(avg(case when rank = 1 then 1.0 else 0.0 end), 6) as hit_at_1,
               round(avg(case when rank <= 3 then 1.0 else 0.0 end), 6) as hit_at_3,
               round(avg(coalesce(1.0 / rank, 0.0)), 6) as mrr
        from asked a left join hits h using (mode, qid) group by a.mode""",
}
