"""Queries on text cleaning, tokens, chunks and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagework.catalog import table, texts
from passagework.catalog import fragments as sql
from passagework.defaults import HASH_DIM
from passagework.functions import guard, ids, markup, text, vectors
from passagework.operators import chunking
from passagework.sources.files import detect_format, load_documents, upload_problem


def normalize_text(spark, folder):
    return texts(spark, folder, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("text"))


def content_hash(spark, folder):
    return texts(spark, folder, "documents").select(
        "doc_id", text.content_hash(F.col("text")).alias("content_hash")
    )


def tokenize(spark, folder):
    words = text.tokenize(F.col("text"))
    rows = texts(spark, folder, "documents").select("doc_id", words.alias("words"))
    return rows.select(
        "doc_id", F.size("words").alias("n_tokens"), F.array_join("words", " ").alias("tokens")
    )


def sentences(spark, folder):
    parts = F.posexplode(text.split_sentences(F.col("text"))).alias("pos", "sentence")
    return texts(spark, folder, "documents").select("doc_id", parts)


def chunk_fixed(spark, folder):
    rows = chunking.chunk_fixed(texts(spark, folder, "documents"))
    return rows.select("chunk_id", "doc_id", "chunk_index", "text", F.col("metadata")["source"].alias("source"))


def chunks_per_doc(spark, folder):
    rows = chunking.chunk_fixed(texts(spark, folder, "documents"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))


def chunk_recursive(spark, folder):
    rows = chunking.chunk_recursive(texts(spark, folder, "documents"))
    return rows.select("chunk_id", "doc_id", "chunk_index", "text", F.col("metadata")["source"].alias("source"))


def _distances(spark, folder):
    return chunking.semantic_groups(chunking.sentence_gaps(texts(spark, folder, "documents").drop("source")))


def semantic_breaks(spark, folder):
    rows = _distances(spark, folder)
    return rows.select(
        "doc_id",
        "pos",
        F.round("distance", 6).alias("distance"),
        F.round("threshold", 6).alias("threshold"),
        F.col("grp").cast("int").alias("grp"),
    )


def semantic_groups(spark, folder):
    rows = _distances(spark, folder).groupBy("doc_id", "grp").agg(
        F.array_sort(F.collect_list(F.struct("pos", "sentence"))).alias("items")
    )
    joined = F.array_join(F.transform("items", lambda i: i["sentence"]), " ")
    return rows.select("doc_id", F.col("grp").cast("int").alias("grp"), joined.alias("text"))


def semantic_chunks(spark, folder):
    rows = chunking.semantic_chunks(texts(spark, folder, "documents"))
    return rows.select("chunk_id", "doc_id", "chunk_index", "text", F.col("metadata")["source"].alias("source"))


def html_text(spark, folder):
    return texts(spark, folder, "pages").select("page_id", markup.html_to_text(F.col("html")).alias("text"))


def html_strip(spark, folder):
    return texts(spark, folder, "pages").select("page_id", markup.strip_html(F.col("html")).alias("text"))


def markdown_strip(spark, folder):
    return texts(spark, folder, "documents").select(
        "doc_id", markup.strip_markdown(F.col("text")).alias("text")
    )


def formats(spark, folder):
    return texts(spark, folder, "pages").select("page_id", detect_format(F.col("url")).alias("format"))


def ingest_guard(spark, folder):
    size = F.octet_length("html")
    rows = texts(spark, folder, "pages").select("page_id", upload_problem(F.col("url"), size).alias("reason"))
    return rows


def _files(spark, folder):
    return texts(spark, folder, "pages").select(
        "page_id", F.col("url").alias("filename"), F.col("html").cast("binary").alias("content")
    )


def load_html(spark, folder):
    good, _ = load_documents(_files(spark, folder))
    return good.select("page_id", "format", "text")


def quarantine(spark, folder):
    _, bad = load_documents(_files(spark, folder))
    return bad.select("page_id", "reason")


def load_text(spark, folder):
    name = F.concat(F.lit("doc-"), F.col("doc_id"), F.lit(".TXT"))
    files = texts(spark, folder, "documents").select(
        "doc_id", name.alias("filename"), F.col("text").cast("binary").alias("content")
    )
    good, _ = load_documents(files)
    return good.select("doc_id", "format", "text")


def point_id(spark, folder):
    rows = chunking.chunk_fixed(texts(spark, folder, "documents"))
    return rows.select("chunk_id", ids.uuid5(F.col("chunk_id")).alias("point_id"))


def luhn(spark, folder):
    number = F.concat(F.lpad(F.col("o_orderkey").cast("string"), 9, "4"), F.lpad(F.col("o_custkey").cast("string"), 7, "0"))
    return table(spark, folder, "orders").select("o_orderkey", guard.luhn(number).alias("valid"))


def l2_normalize(spark, folder):
    unit = vectors.l2_normalize(F.col("embedding"))
    rows = table(spark, folder, "embeddings").select("vec_id", F.posexplode(unit).alias("pos", "x"))
    return rows.select("vec_id", "pos", F.round("x", 6).alias("x"))


def embed_hash(spark, folder):
    vector = vectors.hash_embed(text.tokenize(F.col("text")), HASH_DIM)
    counts = F.array_join(F.transform(vector, lambda x: x.cast("int").cast("string")), ",")
    return texts(spark, folder, "documents").select("doc_id", counts.alias("counts"))


_SENTENCE_DISTANCES = f"""
sent as (
  select doc_id, (pos - 1)::int as pos, s[pos] as sentence
  from (select doc_id, s, unnest(range(1, len(s) + 1)) as pos
        from (select doc_id, {sql.sentences("text")} as s from documents))),
keyed as (select *, doc_id || ':' || pos as k from sent),
counts as (
  select doc_id, pos, {sql.bucket("term")} as bucket, count(*) as c
  from (select doc_id, pos, unnest({sql.tokens("sentence")}) as term from sent) group by all),
norms as (select doc_id, pos, sqrt(sum(c * c)) as norm from counts group by all),
dots as (
  select b.doc_id, b.pos, sum(a.c * b.c) as dot
  from counts a join counts b on a.doc_id = b.doc_id and a.pos + 1 = b.pos and a.bucket = b.bucket
  group by all),
gaps as (
  select s.doc_id, s.pos, s.sentence,
         case when s.pos > 0 then round(1 - coalesce(d.dot / (m.norm * n.norm), 0), 9) end as distance
  from sent s left join dots d on d.doc_id = s.doc_id and d.pos = s.pos
  left join norms n on n.doc_id = s.doc_id and n.pos = s.pos
  left join norms m on m.doc_id = s.doc_id and m.pos = s.pos - 1),
limits as (
  select doc_id, round(quantile_cont(distance, 0.9), 9) as threshold from gaps group by doc_id),
cuts as (
  select doc_id, pos, sentence, distance, threshold,
         (sum(case when distance > threshold then 1 else 0 end)
            over (partition by doc_id order by pos))::int as grp
  from gaps join limits using (doc_id))"""

_HTML = "html"
for _pattern, _to in markup.HTML_STEPS:
    _HTML = f"regexp_replace({_HTML}, '{_pattern}', chr(10), 'g')"
for _entity, _char in markup.ENTITIES:
    _quoted = _char.replace("'", "''")
    _HTML = f"replace({_HTML}, '{_entity}', '{_quoted}')"
# Text nodes: what lies between tags, without hidden elements, one per line.
_NODES = r"""list_filter(string_split_regex(
  regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<!doctype[^>]*>', '<i>', 'g'),
                 '(?is)<(script|style|noscript)\b.*?</(script|style|noscript)\s*>', '<i>', 'g'),
  '</?[A-Za-z][^>]*>'), lambda node: node <> '')"""
_VISIBLE = f"array_to_string({_NODES}, chr(10))"
for _entity, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
    _VISIBLE = f"replace({_VISIBLE}, '{_entity}', '{_char}')"
# Written by hand for texts without code. RE2 cannot look ahead, so a mark's neighbour is part of
# the match; the inner text of emphasis begins and ends with something that is not blank.
_MARKDOWN = "text"
for _pattern, _to in (
    (r"(?m)^ {0,3}((\*[ \t]*){3,}|(_[ \t]*){3,})$", ""),
    (r"(?m)^ {0,3}(=+|-+([ \t]*-)*)[ \t]*$", ""),
    (r"(?m)^ {0,3}#{1,6}([ \t]+|$)", ""),
    (r"(?m)[ \t]+#+[ \t]*$", ""),
    (r"(?m)^ {0,3}>[ \t]?", ""),
    (r"(?m)^[ \t]*([-*+]|[0-9]{1,9}[.)])[ \t]+", ""),
    (r"!\[[^\]\n]*\]\([^)\n]*\)", ""),
    (r"\[([^\]\n]*)\]\([^)\n]*\)", r"\1"),
    (r"\*\*([^\s*]|[^\s*][^*\n]*[^\s*])\*\*", r"\1"),
    (r"\*([^\s*]|[^\s*][^*\n]*[^\s*])\*", r"\1"),
):
    _MARKDOWN = f"regexp_replace({_MARKDOWN}, '{_pattern}', '{_to}', 'g')"

_FORMAT = (
    r"case when regexp_matches(url, '(?i)[^./\\][^/\\]*\.html?$') then 'html'"
    r" when regexp_matches(url, '(?i)[^./\\][^/\\]*\.(md|markdown)$') then 'markdown'"
    r" when regexp_matches(url, '(?i)[^./\\][^/\\]*\.txt$') then 'text'"
    r" when regexp_matches(url, '(?i)[^./\\][^/\\]*\.pdf$') then 'pdf'"
    r" when regexp_matches(url, '(?i)[^./\\][^/\\]*\.docx$') then 'docx' end"
)
_UUID = """substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
  substr('89ab', (concat('0x', substr(h, 17, 1))::int % 4) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"""

QUERIES = {
    "normalize_text": normalize_text,
    "content_hash": content_hash,
    "tokenize": tokenize,
    "sentences": sentences,
    "chunk_fixed": chunk_fixed,
    "chunks_per_doc": chunks_per_doc,
    "chunk_recursive": chunk_recursive,
    "semantic_breaks": semantic_breaks,
    "semantic_groups": semantic_groups,
    "semantic_chunks": semantic_chunks,
    "html_text": html_text,
    "html_strip": html_strip,
    "markdown_strip": markdown_strip,
    "detect_format": formats,
    "ingest_guard": ingest_guard,
    "load_html": load_html,
    "load_text": load_text,
    "quarantine": quarantine,
    "point_id": point_id,
    "luhn": luhn,
    "l2_normalize": l2_normalize,
    "embed_hash": embed_hash,
}

SQL = {
    "normalize_text": f"select doc_id, {sql.normalize('text')} as text from documents",
    "content_hash": f"select doc_id, sha256(lower({sql.collapse('text')})) as content_hash from documents",
    "tokenize": f"""select doc_id, len(w)::int as n_tokens, array_to_string(w, ' ') as tokens
        from (select doc_id, {sql.tokens("text")} as w from documents)""",
    "sentences": f"""select doc_id, (pos - 1)::int as pos, s[pos] as sentence
        from (select doc_id, s, unnest(range(1, len(s) + 1)) as pos
              from (select doc_id, {sql.sentences("text")} as s from documents))""",
    "chunk_fixed": f"with {sql.CHUNKS} select chunk_id, doc_id, chunk_index, text, source from chunks",
    "chunks_per_doc": f"with {sql.CHUNKS} select doc_id, count(*) as n_chunks from chunks group by doc_id",
    "semantic_breaks": f"""with {_SENTENCE_DISTANCES}
        select doc_id, pos, round(distance, 6) as distance, round(threshold, 6) as threshold, grp from cuts""",
    "semantic_groups": f"""with {_SENTENCE_DISTANCES}
        select doc_id, grp, string_agg(sentence, ' ' order by pos) as text from cuts group by doc_id, grp""",
    "html_text": f"select page_id, {sql.normalize(_VISIBLE)} as text from pages",
    "load_html": f"""select page_id, format, text from (
          select page_id, {_FORMAT} as format, {sql.normalize(_VISIBLE)} as text, html from pages)
        where format = 'html' and strlen(html) between 1 and 20971520 and text <> ''""",
    "html_strip": f"select page_id, {sql.normalize(_HTML)} as text from pages",
    "markdown_strip": f"select doc_id, {sql.normalize(_MARKDOWN)} as text from documents",
    "detect_format": f"select page_id, {_FORMAT} as format from pages",
    "ingest_guard": f"""select page_id, case when coalesce(url, '') = '' then 'no filename'
          when strlen(html) > 20971520 then 'too large' when strlen(html) = 0 then 'empty'
          when ({_FORMAT}) is null then 'unsupported format' end as reason from pages""",
    "load_text": f"""select doc_id, 'text' as format, t as text
        from (select doc_id, {sql.normalize("text")} as t from documents) where t <> ''""",
    "quarantine": f"""select page_id, case when coalesce(url, '') = '' then 'no filename'
          when strlen(html) > 20971520 then 'too large' when strlen(html) = 0 then 'empty'
          else 'unsupported format' end as reason
        from pages where ({_FORMAT}) is null or strlen(html) = 0 or strlen(html) > 20971520""",
    "point_id": f"""with {sql.CHUNKS}, hashed as (
          select chunk_id, sha1(unhex('{ids.URL_NAMESPACE}') || encode(chunk_id)) as h from chunks)
        select chunk_id, {_UUID} as point_id from hashed""",
    "luhn": """with digits as (
          select o_orderkey, string_split(reverse(lpad(o_orderkey::varchar, 9, '4') || lpad(o_custkey::varchar, 7, '0')), '') as d
          from orders)
        select o_orderkey, list_sum(list_transform(range(1, len(d) + 1), lambda i:
          case when i % 2 = 1 then d[i]::int when d[i]::int * 2 > 9 then d[i]::int * 2 - 9 else d[i]::int * 2 end)) % 10 = 0 as valid
        from digits""",
    "l2_normalize": """with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
        n as (select vec_id, e, greatest(sqrt(list_sum(list_transform(e, lambda x: x * x))), 1e-12) as norm from v)
        select vec_id, (pos - 1)::int as pos, round(e[pos] / norm, 6) as x
        from (select vec_id, e, norm, unnest(range(1, len(e) + 1)) as pos from n)""",
    "embed_hash": f"""with b as (
          select doc_id, list_transform({sql.tokens("text")}, lambda t: {sql.bucket("t")}) as b from documents)
        select doc_id, array_to_string(list_transform(range(0, 64), lambda d:
          len(list_filter(b, lambda x: x = d))), ',') as counts from b""",
}
