"""Queries on routing, answering and the embedding cache, with models that are plain rules.

The benchmark texts are the questions. The rules stand in for language models, so
that every step of the stages runs and its result is known.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from passagework.catalog import table, texts
from passagework.catalog.guards import turns
from passagework.catalog.retrieval import asked
from passagework.functions.structured import parse_critique, parse_route
from passagework.operators import fusion
from passagework.operators.answering import answer_json as to_json
from passagework.operators.answering import answers, route, split_routes
from passagework.operators.answering import stage_log as stages
from passagework.operators.chunking import chunk_fixed
from passagework.operators.guarding import guard_queries
from passagework.operators.inference import cached_embed
from passagework.operators.sizing import top_k
from passagework.session import materialize

ROUTES = ("factual", "analytical", "summary", "out_of_scope", "unknown")


def rule_router():
    """A category by the length of the query; every fifth reply is not a known one."""

    def reply(messages):
        category = ROUTES[len(messages[-1]["content"]) % 5]
        return 'Sure.\n```json\n{"category": "%s", "reasoning": "by length"}\n```' % category

    return reply


def rule_writer():
    """Cites the first passage; a revision cites the second one, too."""

    def write(messages):
        revised = "Reviewers objected" in messages[0]["content"]
        return "See [1] and [2], not [99]." if revised else "See [1], again [1]."

    return write


def rule_critic():
    """Asks for a revision of short questions' drafts until the second passage is cited,
    and of every third long question's draft without end."""

    def judge(messages):
        body = messages[-1]["content"]
        draft, _, rest = body.removeprefix("<answer>").partition("</answer>")
        question = rest.rpartition("<query>")[2].removesuffix("</query>")
        stubborn = len(question) % 3 == 0
        if stubborn or (len(question) < 200 and "[2]" not in draft):
            return '{"verdict": "revise", "grounded": false, "issues": ["cite more"]}'
        return '{"verdict": "approve", "grounded": true, "issues": []}'

    return judge


def _answered(spark, folder):
    index = fusion.build_hybrid_index(chunk_fixed(texts(spark, folder, "documents")))
    safe, _ = guard_queries(asked(spark, folder))
    return answers(
        safe,
        lambda queries: fusion.hybrid_topk(index, queries),
        index.chunks,
        rule_router,
        rule_writer,
        rule_critic,
        cut=lambda df: materialize(df, "routed"),
    )


def answer_batch(spark, folder):
    rows = _answered(spark, folder)
    return rows.select(
        "qid",
        "text",
        "category",
        "correction_rounds",
        F.size("citations").alias("n_citations"),
        "context_size",
        "error",
    )


def answer_json(spark, folder):
    """The fields of each response's JSON."""
    body = F.from_json(
        "body", "text string, citations array<struct<chunk_id:string>>, category string, correction_rounds int, pii_redacted boolean"
    )
    rows = to_json(_answered(spark, folder)).select("qid", body.alias("b"))
    return rows.select("qid", "b.text", F.size("b.citations").alias("n_citations"), "b.category", "b.correction_rounds", "b.pii_redacted")


def stage_log(spark, folder):
    return stages(_answered(spark, folder))


def route_split(spark, folder):
    queries = turns(spark, folder).select("qid", "text")
    inside, outside = split_routes(route(queries, rule_router))
    rows = inside.withColumn("branch", F.lit("retrieve")).unionByName(outside.withColumn("branch", F.lit("reject")))
    return rows.select("qid", "category", F.col("route_fallback").alias("fallback"), "branch")


def _replies(spark, folder):
    """Model replies of all shapes: fenced, embedded, unknown value, broken, plain."""
    n = F.length("text") % 5
    fenced = F.lit('Ok:\n```json\n{"category": "summary", "reasoning": "r"}\n```\nbye')
    bare = F.lit('I think {"category": "analytical"} fits')
    unknown = F.lit('{"category": "weather", "reasoning": "r"}')
    broken = F.lit('{"category": "factual"')
    reply = F.when(n == 0, fenced).when(n == 1, bare).when(n == 2, unknown).when(n == 3, broken).otherwise(F.col("text"))
    return turns(spark, folder).select("qid", reply.alias("reply"))


def parse_structured(spark, folder):
    rows = _replies(spark, folder).withColumn("p", parse_route(F.col("reply")))
    return rows.select("qid", "p.category", "p.reasoning", "p.fallback")


def parse_verdicts(spark, folder):
    n = F.length("text") % 3
    good = F.lit('```\n{"verdict": "revise", "grounded": false, "issues": ["a", "b"]}\n```')
    reply = F.when(n == 0, good).when(n == 1, F.lit('so {"verdict": "approve"} it is')).otherwise(F.col("text"))
    rows = turns(spark, folder).select("qid", parse_critique(reply).alias("p"))
    return rows.select("qid", "p.verdict", "p.grounded", F.array_join("p.issues", ",").alias("issues"), "p.fallback")


def embed_cache(spark, folder):
    """Turns looked up in a cache that holds the first turn of every conversation, some too long ago."""
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    rows = table(spark, folder, "conversations")
    first = top_k(rows, "conv_id", [F.col("turn")], 1, "n").drop("n")
    age = F.when(F.length("text") % 2 == 0, F.lit("2024-01-01 12:00:00")).otherwise(F.lit("2023-12-31 12:00:00"))
    none = spark.createDataFrame([], "key string, vector array<double>, stored_at timestamp")
    _, stored = cached_embed(first, none, "hash", now, row_id="conv_id")
    aged = first.withColumn("stored_at", age.cast("timestamp")).select("text", "stored_at")
    # Equal texts share a key; the freshest entry counts.
    keyed, _ = cached_embed(aged, none, "hash", now, row_id="stored_at")
    cache = keyed.select("key", "vector", "stored_at")
    found, _ = cached_embed(rows, materialize(cache, "cache"), "hash", now, row_id="conv_id")
    return found.groupBy("hit").agg(F.count("*").alias("turns"), F.countDistinct("key").alias("texts"))


QUERIES = {
    "answer_batch": answer_batch,
    "answer_json": answer_json,
    "stage_log": stage_log,
    "route_split": route_split,
    "parse_structured": parse_structured,
    "parse_verdicts": parse_verdicts,
    "embed_cache": embed_cache,
}

_ANSWERS = """asked as (
  select item_id as qid, length(text) as n,
         case length(text) % 5 when 1 then 'analytical' when 2 then 'summary' when 3 then 'out_of_scope'
           else 'factual' end as category from benchmark),
turned as (
  select qid, category, case when category = 'out_of_scope' then 0 when n % 3 = 0 then 2
                             when n < 200 then 1 else 0 end as rounds from asked)"""

SQL = {
    "answer_batch": f"""with {_ANSWERS}
        select qid, category, rounds as correction_rounds, null::varchar as error,
               case when category = 'out_of_scope' then 'The request is outside the scope of the indexed documents.'
                    when rounds > 0 then 'See [1] and [2], not [99].' else 'See [1], again [1].' end as text,
               case when category = 'out_of_scope' then 0 when rounds > 0 then 2 else 1 end as n_citations,
               case when category <> 'out_of_scope' then 5 end as context_size
        from turned""",
    "answer_json": f"""with {_ANSWERS}
        select qid, category, rounds as correction_rounds, false as pii_redacted,
               case when category = 'out_of_scope' then 'The request is outside the scope of the indexed documents.'
                    when rounds > 0 then 'See [1] and [2], not [99].' else 'See [1], again [1].' end as text,
               case when category = 'out_of_scope' then 0 when rounds > 0 then 2 else 1 end as n_citations
        from turned""",
    "stage_log": f"""with {_ANSWERS},
        listed as (
          select qid, case when category = 'out_of_scope' then ['router', 'reject', 'answer']
            else list_concat(list_concat(['router', 'retrieve'],
                   flatten(list_transform(range(0, rounds + 1), lambda r: ['reason', 'critic']))), ['cite', 'answer']) end as s
          from turned)
        select qid, (i - 1)::int as seq, s[i] as stage
        from (select qid, s, unnest(range(1, len(s) + 1)) as i from listed)""",
    "route_split": """select conv_id || ':' || turn as qid,
          case length(text) % 5 when 1 then 'analytical' when 2 then 'summary' when 3 then 'out_of_scope'
            else 'factual' end as category, length(text) % 5 = 4 as fallback,
          case when length(text) % 5 = 3 then 'reject' else 'retrieve' end as branch from conversations""",
    "parse_structured": """select conv_id || ':' || turn as qid,
          case length(text) % 5 when 0 then 'summary' when 1 then 'analytical' else 'factual' end as category,
          case when length(text) % 5 = 0 then 'r' else '' end as reasoning,
          length(text) % 5 >= 2 as fallback from conversations""",
    "parse_verdicts": """select conv_id || ':' || turn as qid,
          case when length(text) % 3 = 0 then 'revise' else 'approve' end as verdict,
          length(text) % 3 <> 0 as grounded, case when length(text) % 3 = 0 then 'a,b' else '' end as issues,
          length(text) % 3 = 2 as fallback from conversations""",
    "embed_cache": """with firsts as (
          select text from conversations qualify row_number() over (partition by conv_id order by turn) = 1),
        live as (select distinct text from firsts where length(text) % 2 = 0)
        select l.text is not null as hit, count(*) as turns, count(distinct c.text) as texts
        from conversations c left join live l on l.text = c.text group by 1""",
}
