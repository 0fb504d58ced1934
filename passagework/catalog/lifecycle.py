"""Queries on duplicates, versions, the document registry and whole-batch ingestion.

`documents` has no time stamps: doc_id is the order of arrival. Signatures use the
MD5 shingle digest here because the checking SQL has no other one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from passagework.catalog import fragments as sql
from passagework.catalog import table, texts
from passagework.defaults import PERMUTATIONS, SIGNATURE_SEED
from passagework.functions.text import content_hash, tokenize
from passagework.operators import registry as reg
from passagework.operators.chunking import chunk_fixed
from passagework.operators.dedup import deduplicate, exact_duplicates
from passagework.operators.signatures import hash_family, jaccard, minhash_signature, shingle_set
from passagework.plans.ingest import ingest_batch as run_ingest
from passagework.plans.ingest import outcome_counts
from passagework.session import materialize


def signed(spark, folder):
    return _sign(texts(spark, folder, "documents"))


def _sign(rows):
    return rows.select(
        "doc_id",
        "source",
        content_hash(F.col("text")).alias("content_hash"),
        minhash_signature(tokenize(F.col("text")), digest="md5").alias("signature"),
    )


def signatures(spark, folder):
    rows = signed(spark, folder).filter("signature is not null")
    return rows.select("doc_id", F.md5(F.array_join("signature", ",")).alias("digest"))


def dedup_exact(spark, folder):
    rows = texts(spark, folder, "documents").select("doc_id", content_hash(F.col("text")).alias("content_hash"))
    return exact_duplicates(materialize(rows, "hashed"), "doc_id").select(
        "doc_id", F.col("first").alias("first_doc"), "is_duplicate"
    )


def _decided(spark, folder):
    rows = materialize(signed(spark, folder), "signed-documents")
    return rows, deduplicate(rows, "doc_id")


def dedup_corpus(spark, folder):
    _, decided = _decided(spark, folder)
    return decided.select("doc_id", "outcome", "match", F.round("similarity", 6).alias("similarity"))


def near_dup_pairs(spark, folder):
    """Every near duplicate with the kept document it matches: one pair per document.

    Every other document comes once more, later and with three words more.
    """
    docs = texts(spark, folder, "documents").select("doc_id", "source", "text")
    longer = docs.filter("doc_id % 2 = 0").select(
        (F.col("doc_id") + 1_000_000).alias("doc_id"), "source", F.concat("text", F.lit(" and so on")).alias("text")
    )
    decided = deduplicate(materialize(_sign(docs.unionByName(longer)), "signed-documents"), "doc_id")
    near = decided.filter("outcome = 'near_duplicate'")
    return near.select("doc_id", "match", F.round("similarity", 6).alias("similarity"))


def near_dup_jaccard(spark, folder):
    """The exact set similarity beside the estimate, for every near duplicate and its match."""
    _, decided = _decided(spark, folder)
    near = materialize(decided.filter("outcome = 'near_duplicate'").select("doc_id", "match", "similarity"), "near")
    docs = table(spark, folder, "documents")
    # The matched documents only: their ids filter the texts where they are read.
    ids = near.select("doc_id").union(near.select("match")).distinct()
    sets = docs.join(ids, "doc_id", "left_semi").select(
        "doc_id", shingle_set(tokenize(F.col("text"))).alias("shingles")
    )
    sets = materialize(sets, "shingles")
    mine = sets.withColumnRenamed("shingles", "a")
    theirs = sets.select(F.col("doc_id").alias("match"), F.col("shingles").alias("b"))
    rows = near.join(mine, "doc_id").join(theirs, "match")
    return rows.select(
        "doc_id",
        "match",
        F.round("similarity", 6).alias("similarity"),
        F.round(jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"),
    )


def ingest_outcomes(spark, folder):
    _, decided = _decided(spark, folder)
    named = F.when(F.col("outcome") == "new", "indexed").otherwise(F.col("outcome"))
    return outcome_counts(decided.withColumn("outcome", named))


def _first_copies(spark, folder):
    rows = texts(spark, folder, "documents").select(
        "doc_id", "source", content_hash(F.col("text")).alias("content_hash")
    )
    rows = materialize(rows, "hashed")
    heads = exact_duplicates(rows, "doc_id").filter("not is_duplicate").select("doc_id")
    return materialize(rows.join(heads, "doc_id", "left_semi"), "first-copies")


def _versions(spark, folder):
    return reg.versions(_first_copies(spark, folder), "doc_id")


def versions(spark, folder):
    return _versions(spark, folder).select("doc_id", "source", "version", "status", "superseded_by")


def registry(spark, folder):
    name = F.concat(F.lit("doc-"), F.col("doc_id"), F.lit(".txt"))
    rows = _versions(spark, folder).withColumn("filename", name).withColumn("format", F.lit("text"))
    # Creation goes against arrival within a week, so that the order of the list is its own.
    created = F.timestamp_seconds(1_704_067_200 + F.floor(F.col("doc_id") / 7) * 7 - F.col("doc_id") % 7)
    records = reg.document_records(rows, created)
    return reg.list_documents(records).select(
        "doc_id",
        "source",
        "format",
        "content_hash",
        "version",
        "status",
        F.col("extra")["filename"].alias("filename"),
        F.col("created_at").cast("timestamp_ntz").alias("created_at"),
    )


def active_signatures(spark, folder):
    rows = materialize(signed(spark, folder), "signed-documents").select("doc_id", "signature")
    live = reg.active(_versions(spark, folder))
    return live.join(rows, "doc_id").select("doc_id", "content_hash", F.md5(F.array_join("signature", ",")).alias("digest"))


def latest_version(spark, folder):
    return reg.latest_version(_versions(spark, folder)).select("source", "doc_id", "version")


def status_latest(spark, folder):
    """The last entry of a log in which every document was pending, processing, then its status."""
    rows = _versions(spark, folder)
    steps = F.array(F.lit("pending"), F.lit("processing"), F.lit("indexed"))
    full = F.when(F.col("status") == "superseded", F.concat(steps, F.array(F.lit("superseded")))).otherwise(steps)
    log = rows.select("doc_id", F.posexplode(full).alias("seq", "status"))
    return reg.latest_status(log)


def purge_superseded(spark, folder):
    gone = _versions(spark, folder).filter("status = 'superseded'")
    rows = chunk_fixed(texts(spark, folder, "documents"))
    return reg.purge(rows, gone).select("chunk_id", "doc_id")


def document_files(spark, folder):
    """Every document as an uploaded text file."""
    return texts(spark, folder, "documents").select(
        F.col("doc_id").alias("arrival"),
        F.concat(F.lit("doc-"), F.col("doc_id"), F.lit(".txt")).alias("filename"),
        "source",
        F.col("text").cast("binary").alias("content"),
    )


def ingest_batch(spark, folder):
    done = run_ingest(document_files(spark, folder), digest="md5")
    return done.outcomes.select("arrival", "outcome", "version", "deduplicated")


def failing_model():
    """Refuses texts with a capital letter, if their length says so."""

    def embed(batch):
        if any(len(t) % 4 == 1 and t != t.lower() for t in batch):
            raise ValueError("refused")
        return [[1.0, 0.0] for _ in batch]

    return embed


def ingest_failures(spark, folder):
    """Every document and, after it, its copy in small letters; some originals cannot be embedded."""

    def whole(docs):
        return chunk_fixed(docs, size=1 << 30, overlap=0)

    files = document_files(spark, folder)
    text = F.col("content").cast("string")
    first = files.withColumn("arrival", F.col("arrival") * 2)
    second = files.withColumn("arrival", F.col("arrival") * 2 + 1).withColumn("content", F.lower(text).cast("binary"))
    done = run_ingest(first.unionByName(second), digest="md5", chunk=whole, model=failing_model)
    return done.outcomes.select("arrival", "outcome", "version", "deduplicated")


def ingest_live_chunks(spark, folder):
    """Chunks of the documents that are live after the batch, by source; chunks without a vector do not count."""
    done = run_ingest(document_files(spark, folder), digest="md5", chunk=chunk_fixed)
    rows = done.chunks.join(done.vectors.select("chunk_id"), "chunk_id")
    return rows.groupBy(F.col("metadata")["source"].alias("source")).agg(F.count("*").alias("chunks"))


_FAMILY = ", ".join(
    f"({i}, {a}::hugeint, {b}::hugeint)" for i, (a, b) in enumerate(hash_family(PERMUTATIONS, SIGNATURE_SEED))
)
SIGNATURES = f"""
words as (select doc_id, {sql.tokens("text")} as w from documents),
shingles as (
  select distinct doc_id, concat('0x', substr(md5(s), 1, 8))::bigint as x from (
    select doc_id, array_to_string(w[i:i + 4], ' ') as s
    from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from words where len(w) > 0))),
family(i, a, b) as (values {_FAMILY}),
sig as (
  select doc_id, i, min(((a * x + b) % 18446744073709551616::hugeint) // 4294967296::hugeint)::bigint as v
  from shingles cross join family group by all)"""

DECIDED = f"""{SIGNATURES},
hashes as (select doc_id, source, sha256(lower({sql.collapse("text")})) as h from documents),
alike as (
  select b.doc_id, a.doc_id as other, count(*) / {PERMUTATIONS}.0 as similarity
  from sig a join sig b on a.i = b.i and a.v = b.v and a.doc_id < b.doc_id
  group by all having count(*) / {PERMUTATIONS}.0 >= 0.9),
same as (select b.doc_id, a.doc_id as other from hashes a join hashes b on a.h = b.h and a.doc_id < b.doc_id),
edges as (select doc_id, other from alike union select doc_id, other from same),
neighbours as (select doc_id, list(other) as nb from edges group by doc_id),
walked as (
  select row_number() over (order by doc_id) as pos, doc_id, nb
  from (select doc_id from edges union select other from edges) left join neighbours using (doc_id)),
walk as (
  select 0::bigint as pos, []::bigint[] as kept
  union all
  select w.pos + 1, case when list_has_any(w.kept, coalesce(o.nb, [])) then w.kept
                         else list_append(w.kept, o.doc_id) end
  from walk w join walked o on o.pos = w.pos + 1),
gone as (
  select doc_id from walked
  where not list_contains((select kept from walk order by pos desc limit 1), doc_id)),
best as (
  select a.doc_id, max_by(a.other, a.similarity * 1e9 + a.other / 1e9) as match, max(a.similarity) as similarity
  from alike a where a.other not in (select doc_id from gone) group by a.doc_id),
copies as (
  select s.doc_id, min(s.other) as match from same s
  where s.other not in (select doc_id from gone) group by s.doc_id),
decided as (
  select h.doc_id, h.source,
         case when g.doc_id is null then 'new' when c.match is not null then 'duplicate'
              else 'near_duplicate' end as outcome,
         case when g.doc_id is not null then coalesce(c.match, b.match) end as match,
         case when g.doc_id is not null then case when c.match is not null then 1.0 else b.similarity end end
           as similarity
  from hashes h left join gone g using (doc_id) left join copies c using (doc_id) left join best b using (doc_id))"""

_FIRSTS = f"""
hashes as (select doc_id, source, sha256(lower({sql.collapse("text")})) as h from documents),
firsts as (
  select doc_id, source, h from hashes
  qualify row_number() over (partition by h order by doc_id) = 1),
versions as (
  select doc_id, source, h, (row_number() over (partition by source order by doc_id))::int as version,
         lead(doc_id) over (partition by source order by doc_id) as superseded_by from firsts),
stated as (
  select *, case when superseded_by is null then 'indexed' else 'superseded' end as status from versions)"""

_KEPT_VERSIONS = """
numbered as (
  select doc_id, (row_number() over (partition by source order by doc_id))::int as version
  from decided where outcome = 'new')"""

INGESTED = f"""with recursive {DECIDED}, {_KEPT_VERSIONS}
        select d.doc_id as arrival, case when outcome = 'new' then 'indexed' else outcome end as outcome,
               n.version, outcome <> 'new' as deduplicated
        from decided d left join numbered n
          on n.doc_id = case when outcome = 'new' then d.doc_id else d.match end"""

_DOUBLED = f"""doubled as (
  select doc_id * 2 as doc_id, text, source, length({sql.normalize("text")}) % 4 = 1 and {sql.normalize("text")} <> lower({sql.normalize("text")}) as bad
  from documents
  union all select doc_id * 2 + 1, lower(text), source, false from documents)"""
_FAILING = f"""with recursive {_DOUBLED}, {DECIDED}, told as (
          select d.doc_id, d.source, d.match, case when outcome = 'near_duplicate' and match is null then 'failed' else outcome end as outcome
          from decided d),
        numbered as (
          select doc_id, (row_number() over (partition by source order by doc_id))::int as version
          from told where outcome in ('new', 'failed'))
        select d.doc_id as arrival, case when outcome = 'new' then 'indexed' else outcome end as outcome, n.version,
               outcome not in ('new', 'failed') as deduplicated
        from told d left join numbered n on n.doc_id = coalesce(d.match, d.doc_id)"""
_FAILING = _FAILING.replace("from documents)", "from doubled)").replace(f"union all select doc_id * 2 + 1, lower(text), source, false from doubled)", "union all select doc_id * 2 + 1, lower(text), source, false from documents)")
_FAILING = _FAILING.replace(
    "case when list_has_any(w.kept", "case when (select bad from doubled x where x.doc_id = o.doc_id) or list_has_any(w.kept"
)

QUERIES = {
    "minhash_signature": signatures,
    "dedup_exact": dedup_exact,
    "dedup_corpus": dedup_corpus,
    "near_dup_pairs": near_dup_pairs,
    "near_dup_jaccard": near_dup_jaccard,
    "ingest_outcomes": ingest_outcomes,
    "versions": versions,
    "registry": registry,
    "active_signatures": active_signatures,
    "latest_version": latest_version,
    "status_latest": status_latest,
    "purge_superseded": purge_superseded,
    "ingest_batch": ingest_batch,
    "ingest_failures": ingest_failures,
    "ingest_live_chunks": ingest_live_chunks,
}

SQL = {
    "minhash_signature": f"""with {SIGNATURES}
        select doc_id, md5(string_agg(v::varchar, ',' order by i)) as digest from sig group by doc_id""",
    "dedup_exact": f"""select doc_id, min(doc_id) over (partition by h) as first_doc,
          doc_id > min(doc_id) over (partition by h) as is_duplicate
        from (select doc_id, sha256(lower({sql.collapse("text")})) as h from documents)""",
    "dedup_corpus": f"""with recursive {DECIDED}
        select doc_id, outcome, match, round(similarity, 6)::double as similarity from decided""",
    "near_dup_pairs": f"""with recursive longer as (
          select doc_id, text, source from documents
          union all select doc_id + 1000000, text || ' and so on', source from documents where doc_id % 2 = 0),
        {DECIDED.replace("from documents)", "from longer)")}
        select doc_id, match, round(similarity, 6)::double as similarity from decided where outcome = 'near_duplicate'""",
    "near_dup_jaccard": f"""with recursive {DECIDED},
        sets as (
          select doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
                 lambda i: array_to_string(w[i:i + 4], ' '))) as s from words)
        select d.doc_id, d.match, round(d.similarity, 6)::double as similarity,
               round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) as jaccard
        from decided d join sets a on a.doc_id = d.doc_id join sets b on b.doc_id = d.match
        where d.outcome = 'near_duplicate'""",
    "ingest_outcomes": f"""with recursive {DECIDED}
        select case when outcome = 'new' then 'indexed' else outcome end as outcome, count(*) as documents
        from decided group by 1""",
    "versions": f"with {_FIRSTS} select doc_id, source, version, status, superseded_by from stated",
    "registry": f"""with {_FIRSTS} select doc_id, source, 'text' as format, h as content_hash, version, status,
          'doc-' || doc_id || '.txt' as filename,
          timestamp '2024-01-01' + to_seconds((doc_id // 7) * 7 - doc_id % 7) as created_at from stated order by created_at, doc_id""",
    "active_signatures": f"""with {_FIRSTS}, {SIGNATURES},
        listed as (select doc_id, md5(string_agg(v::varchar, ',' order by i)) as digest from sig group by doc_id)
        select s.doc_id, s.h as content_hash, l.digest from stated s left join listed l using (doc_id)
        where status <> 'superseded'""",
    "latest_version": f"""with {_FIRSTS}
        select source, doc_id, version from stated where status <> 'superseded'
        qualify row_number() over (partition by source order by version desc) = 1""",
    "status_latest": f"""with {_FIRSTS}
        select doc_id, status, case when status = 'superseded' then 3 else 2 end as seq from stated""",
    "purge_superseded": f"""with {_FIRSTS}, {sql.CHUNKS}
        select chunk_id, doc_id from chunks
        where doc_id not in (select doc_id from stated where status = 'superseded')""",
    "ingest_batch": INGESTED,
    "ingest_failures": _FAILING,
    "ingest_live_chunks": f"""with recursive {DECIDED},
        live as (
          select d.source, {sql.normalize("text")} as text from decided d join documents using (doc_id) where outcome = 'new'
          qualify row_number() over (partition by d.source order by d.doc_id desc) = 1)
        select source, sum(greatest(ceil((length(text) - 64) / 448.0)::int, 1))::bigint as chunks
        from live where length(text) > 0 group by source""",
}
