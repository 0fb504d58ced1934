"""Routing, context, drafting with a bounded revision loop, and citations."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.defaults import MAX_CONTEXT_CHUNKS, MAX_ROUNDS, QUOTE_CHARS
from passagework.functions.structured import parse_critique, parse_route
from passagework.operators.fusion import with_text
from passagework.operators.inference import complete

CITATION_TYPE = "array<struct<document_id:string,source:string,chunk_id:string,quote:string>>"


@dataclass(frozen=True)
class Templates:
    """Texts sent to the models. Callers supply their own; these are plain defaults."""

    router: str = 'Classify the query as factual, analytical, summary or out_of_scope. Answer in JSON with "category" and "reasoning".'
    reasoner: str = "Answer from the numbered passages only and cite them like [1].\n\nPassages:\n"
    revision: str = "\n\nRewrite the text below. Reviewers objected to: {issues}.\n<text>{draft}</text>"
    review: str = "<answer>{draft}</answer>\n<passages>{context}</passages>\n<query>{query}</query>"
    critic: str = 'Check each claim of the draft against the passages. Answer in JSON with "verdict" (approve or revise), "grounded" and "issues".'
    refusal: str = "The request is outside the scope of the indexed documents."


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat(system: Column, user: Column) -> Column:
    return F.array(message("system", system), message("user", user))


def filled(template: str, **values: Column) -> Column:
    """A template with {name} places; missing values are empty. Values are not looked into for places."""
    parts = re.split(r"\{(\w+)\}", template)
    pieces = [F.coalesce(values[x], F.lit("")) if i % 2 else F.lit(x) for i, x in enumerate(parts)]
    return F.concat(*pieces)


def route(queries: DataFrame, model: Callable, templates: Templates = Templates()) -> DataFrame:
    """Adds `category` and `route_fallback`; what cannot be parsed is factual."""
    asked = queries.withColumn("_talk", chat(F.lit(templates.router), F.col("text")))
    raw = complete(asked, "_talk", "_raw", model, error="_route_error")
    parsed = parse_route(F.coalesce("_raw", F.lit("")))
    return (
        raw.withColumn("_route", parsed)
        .withColumn("category", F.col("_route.category"))
        .withColumn("route_fallback", F.col("_route.fallback"))
        .drop("_talk", "_raw", "_route", "_route_error")
    )


def split_routes(routed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to retrieve, out of scope)."""
    out = F.col("category") == "out_of_scope"
    return routed.filter(~out), routed.filter(out)


def contexts(ranked: DataFrame, chunks: DataFrame, limit: int = MAX_CONTEXT_CHUNKS) -> DataFrame:
    """(qid, context ARRAY<STRUCT<rank, chunk_id, doc_id, source, text>>, context_text).

    At most `limit` passages per query, in rank order, numbered from 1.
    """
    rows = with_text(ranked.filter(F.col("rank") <= limit).select("qid", "chunk_id", "rank"), chunks)
    source = F.coalesce(F.try_element_at("metadata", F.lit("source")), F.col("doc_id").cast("string"))
    item = F.struct("rank", "chunk_id", F.col("doc_id").cast("string").alias("doc_id"), source.alias("source"), "text")
    packed = rows.groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("context"))
    return packed.withColumn("context_text", context_block(F.col("context")))


def context_block(items: Column) -> Column:
    numbered = F.transform(
        items, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c["text"])
    )
    return F.array_join(numbered, "\n\n")


def draft_messages(templates: Templates) -> Column:
    """Messages for a first draft, or for a revision if the critique asked for one."""
    again = filled(templates.revision, issues=F.array_join("critique.issues", "; "), draft=F.col("draft"))
    first = F.concat(F.lit(templates.reasoner), F.coalesce("context_text", F.lit("")))
    wants = F.coalesce(F.col("critique.verdict") == "revise", F.lit(False))
    return chat(F.when(wants, F.concat(first, again)).otherwise(first), F.col("text"))


def critic_messages(templates: Templates) -> Column:
    asked = filled(
        templates.review, draft=F.col("draft"), context=F.col("context_text"), query=F.col("text")
    )
    return chat(F.lit(templates.critic), asked)


def draft_and_review(
    rows: DataFrame,
    writer: Callable,
    critic: Callable,
    max_rounds: int = MAX_ROUNDS,
    templates: Templates = Templates(),
) -> DataFrame:
    """Adds `draft`, `correction_rounds`, `error` by 1 + `max_rounds` passes at most.

    The passes form one chain of narrow stages. A row that is approved, failed or
    out of rounds is carried along without calling a model, so nothing is computed
    twice and nothing is shuffled. A failed critique counts as approval.
    """
    none = F.lit(None).cast("struct<verdict:string,grounded:boolean,issues:array<string>,fallback:boolean>")
    rows = (
        rows.withColumn("draft", F.lit(None).cast("string"))
        .withColumn("critique", none)
        .withColumn("correction_rounds", F.lit(0))
        .withColumn("error", F.lit(None).cast("string"))
        .withColumn("_active", F.lit(True))
    )
    for turn in range(max_rounds + 1):
        rows = rows.withColumn("_talk", draft_messages(templates))
        if turn:
            rows = rows.withColumn(
                "correction_rounds", F.col("correction_rounds") + F.col("_active").cast("int")
            )
        rows = complete(rows, "_talk", "draft", writer, active="_active")
        rows = rows.withColumn("_active", F.col("_active") & F.col("error").isNull())
        rows = rows.withColumn("_talk", critic_messages(templates)).withColumn(
            "_verdict", F.lit(None).cast("string")
        ).withColumn("_critic_error", F.lit(None).cast("string"))
        rows = complete(rows, "_talk", "_verdict", critic, active="_active", error="_critic_error")
        fresh = parse_critique(F.coalesce("_verdict", F.lit("")))
        rows = rows.withColumn("critique", F.when(F.col("_active"), fresh).otherwise(F.col("critique")))
        again = F.col("_active") & (F.col("critique.verdict") == "revise")
        rows = rows.withColumn("_active", F.coalesce(again, F.lit(False)))
    return rows.drop("_active", "_talk", "_verdict", "_critic_error")


def markers(text: Column) -> Column:
    """Numbers in [n] marks, each once, in order of first use."""
    found = F.regexp_extract_all(text, F.lit(r"\[([0-9]+)\]"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda n: n.try_cast("int")), lambda n: n.isNotNull()))


def citations(draft: Column, context: Column, quote_chars: int = QUOTE_CHARS) -> Column:
    """The cited passages; marks without a passage are dropped.

    A context is a handful of passages held in the row, so this is a lookup, not a join.
    """
    real = F.filter(markers(draft), lambda n: n.between(1, F.size(context)))

    def cite(n: Column) -> Column:
        item = F.get(context, n - 1)
        return F.struct(
            item["doc_id"].alias("document_id"),
            item["source"].alias("source"),
            item["chunk_id"].alias("chunk_id"),
            F.substring(item["text"], 1, quote_chars).alias("quote"),
        )

    return F.transform(real, cite)


def answers(
    queries: DataFrame,
    retrieve: Callable[[DataFrame], DataFrame],
    chunks: DataFrame,
    router: Callable,
    writer: Callable,
    critic: Callable,
    max_rounds: int = MAX_ROUNDS,
    templates: Templates = Templates(),
    cut: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """(qid, text, category, correction_rounds, citations, context_size, error).

    `queries(qid, text)` have passed the guard. `retrieve` maps queries to a ranked
    list. `cut` is applied to the routed queries, which are read more than once;
    passing `materialize` keeps the router from being called again.
    """
    routed = cut(route(queries.select("qid", "text"), router, templates))
    inside, outside = split_routes(routed)
    found = contexts(retrieve(inside.select("qid", "text")), chunks)
    ready = inside.join(found, "qid", "left").withColumn(
        "context", F.coalesce("context", F.array().cast(found.schema["context"].dataType))
    )
    written = draft_and_review(ready, writer, critic, max_rounds, templates)
    done = written.select(
        "qid",
        F.col("draft").alias("text"),
        "category",
        "correction_rounds",
        citations(F.coalesce("draft", F.lit("")), F.col("context")).alias("citations"),
        F.size("context").alias("context_size"),
        "error",
    )
    refused = outside.select(
        "qid",
        F.lit(templates.refusal).alias("text"),
        "category",
        F.lit(0).alias("correction_rounds"),
        F.array().cast(CITATION_TYPE).alias("citations"),
        F.lit(None).cast("int").alias("context_size"),
        F.lit(None).cast("string").alias("error"),
    )
    return done.unionByName(refused)


def answer_json(answered: DataFrame, pii: DataFrame | None = None) -> DataFrame:
    """(qid, body): the response as JSON with `pii_redacted` from `pii(qid, pii_redacted)`."""
    rows = answered.join(pii, "qid", "left") if pii is not None else answered.withColumn("pii_redacted", F.lit(False))
    body = F.struct(
        "text",
        "citations",
        "category",
        "correction_rounds",
        F.coalesce("pii_redacted", F.lit(False)).alias("pii_redacted"),
    )
    return rows.select("qid", F.to_json(body).alias("body"))


def stage_log(answered: DataFrame) -> DataFrame:
    """(qid, seq, stage): the stages each answer went through, in order."""
    turns = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.col("correction_rounds")),
            lambda _: F.array(F.lit("reason"), F.lit("critic")),
        )
    )
    inside = F.concat(F.array(F.lit("router"), F.lit("retrieve")), turns, F.array(F.lit("cite"), F.lit("answer")))
    outside = F.array(F.lit("router"), F.lit("reject"), F.lit("answer"))
    stages = F.when(F.col("category") == "out_of_scope", outside).otherwise(inside)
    return answered.select("qid", F.posexplode(stages).alias("seq", "stage"))
