"""SQL building blocks shared by the checks."""

BLANKS = r"\s\x0B\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINE_ENDS = r"\r\n|[\n\x0B\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{BLANKS}]+|[{BLANKS}]+$', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{BLANKS}]+', ' ', 'g'), ' ')"


def normalize(x: str) -> str:
    lines = f"list_transform(string_split_regex({x}, '{LINE_ENDS}'), lambda l: {collapse('l')})"
    return strip(f"regexp_replace(array_to_string({lines}, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')")


def tokens(x: str) -> str:
    return rf"list_transform(regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+'), lambda t: lower(t))"


def sentences(x: str) -> str:
    marked = rf"regexp_replace({x}, '([.!?])[{BLANKS}]+', '\1' || chr(1), 'g')"
    parts = rf"string_split_regex({marked}, '\x01|\n{{2,}}')"
    return f"list_filter(list_transform({parts}, lambda p: {strip('p')}), lambda p: p <> '')"


def bucket(token: str, dim: int = 64) -> str:
    return f"(concat('0x', substr(md5({token}), 1, 8))::bigint % {dim})"


def uuid5(h: str) -> str:
    """The version-5 UUID of a SHA-1 digest in hex."""
    variant = f"substr('89ab', (concat('0x', substr({h}, 17, 1))::int % 4) + 1, 1)"
    return f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || {variant} || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))"


# Fixed windows of 512 characters with 64 shared; every document has at least one.
CHUNKS = """
chunks as (
  select doc_id, source, i::int as chunk_index, doc_id || ':' || i as chunk_id,
         substring(text, (i * 448 + 1)::int, 512) as text
  from (select doc_id, source, text,
               unnest(range(0, greatest(ceil((length(text) - 64) / 448.0)::int, 1))) as i
        from documents where length(text) > 0)
)"""

# BM25 (Okapi, k1 1.5, b 0.75, floor 0.25) of the benchmark texts over the chunks.
SPARSE = f"""
tok as (select chunk_id, unnest({tokens("text")}) as term from chunks),
tf as (select chunk_id, term, count(*) as tf from tok group by all),
len as (select chunk_id, len({tokens("text")}) as len from chunks),
corpus as (select count(*) as n, avg(len) as avg_len from len),
df as (select term, count(*) as df from tf group by term),
raw as (select term, df, ln(n - df + 0.5) - ln(df + 0.5) as raw from df, corpus),
idf as (select term, df, case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end as idf from raw),
qtf as (select item_id as qid, term, count(*) as qtf
        from (select item_id, unnest({tokens("text")}) as term from benchmark) group by all),
sparse_scores as (
  select qid, chunk_id,
         round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))), 9) as score
  from qtf join idf using (term) join tf using (term) join len using (chunk_id), corpus
  group by all),
sparse as (
  select * from (
    select qid, chunk_id, score,
           (row_number() over (partition by qid order by score desc, chunk_id))::int as rank
    from sparse_scores where score > 0) where rank <= 20)"""


def hashed_vectors(name: str, key: str, relation: str) -> str:
    """(key, bucket, w): the non-zero values of unit vectors of the hashing model."""
    return f"""
{name}_counts as (
  select {key}, {bucket("term")} as bucket, count(*) as c
  from (select {key}, unnest({tokens("text")}) as term from {relation}) group by all),
{name} as (
  select {key}, bucket, c / sqrt(sum(c * c) over (partition by {key})) as w from {name}_counts)"""


DENSE = f"""
{hashed_vectors("cvec", "chunk_id", "chunks")},
{hashed_vectors("qvec", "item_id", "benchmark")},
dense_scores as (
  select q.item_id as qid, c.chunk_id, round(sum(q.w * c.w), 9) as score
  from qvec q join cvec c using (bucket) group by all),
dense_all as (
  select b.qid, c.chunk_id, coalesce(s.score, 0.0) as score
  from (select distinct item_id as qid from qvec) b cross join chunks c
  left join dense_scores s on s.qid = b.qid and s.chunk_id = c.chunk_id),
dense as (
  select * from (
    select qid, chunk_id, score,
           (row_number() over (partition by qid order by score desc, chunk_id))::int as rank
    from dense_all) where rank <= 20)"""

FUSED = """
lists as (
  select qid, chunk_id, rank, 0 as list from dense
  union all select qid, chunk_id, rank, 1 from sparse),
fused_scores as (
  select qid, chunk_id, round(sum(1.0 / (60 + rank)), 12) as score,
         min(list * 1000000 + rank) as seen
  from lists group by all),
fused as (
  select qid, chunk_id, score,
         (row_number() over (partition by qid order by score desc, seen))::int as rank
  from fused_scores)"""

HYBRID = f"{CHUNKS}, {SPARSE}, {DENSE}, {FUSED}"

RERANKED = f"""
pairs as (
  select f.qid, f.chunk_id, f.rank as before,
         list_distinct({tokens("b.text")}) as asked, {tokens("c.text")} as had
  from fused f join chunks c using (chunk_id) join benchmark b on b.item_id = f.qid
  where f.rank <= 20),
reranked as (
  select qid, chunk_id, score, rank from (
    select qid, chunk_id, score,
           (row_number() over (partition by qid order by score desc, before))::int as rank
    from (select qid, chunk_id, before,
                 round(len(list_intersect(asked, had)) / len(asked), 9) as score from pairs))
  where rank <= 5)"""
