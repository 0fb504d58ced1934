"""Queries on injection scores and personal data."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagework.catalog import texts
from passagework.defaults import PII_TYPES
from passagework.functions.guard import (
    INJECTION_RULES,
    injection_assessment,
    pii_values,
    redact_pii,
)
from passagework.operators.fusion import valid_query
from passagework.operators.guarding import guard_queries


def all_texts(spark, folder):
    """(kind, id, part, text): every document and every conversation turn."""
    docs = texts(spark, folder, "documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("bigint").alias("part"), "text"
    )
    talk = texts(spark, folder, "conversations").select(
        F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), F.col("turn").alias("part"), "text"
    )
    return docs.unionByName(talk)


def injection_score(spark, folder):
    rows = all_texts(spark, folder).withColumn("a", injection_assessment(F.col("text")))
    rules = F.array_join("a.matched_rules", ",")
    return rows.select("kind", "id", "part", "a.score", rules.alias("rules"), "a.blocked")


def pii_flags(spark, folder):
    counts = [F.size(pii_values(F.col("text"), kind)).alias(kind) for kind in PII_TYPES]
    return all_texts(spark, folder).select("kind", "id", "part", *counts)


def pii_email_iban(spark, folder):
    counts = [F.array_join(pii_values(F.col("text"), kind), " ").alias(kind) for kind in ("email", "iban")]
    return all_texts(spark, folder).select("kind", "id", "part", *counts)


def pii_spans(spark, folder):
    rows = all_texts(spark, folder).select("kind", "id", "part", redact_pii(F.col("text")).alias("r"))
    found = rows.select("kind", "id", "part", F.explode("r.matches").alias("m"))
    return found.select("kind", "id", "part", "m.type", "m.value", "m.start", "m.end")


def pii_redact(spark, folder):
    rows = all_texts(spark, folder).select("kind", "id", "part", redact_pii(F.col("text")).alias("r"))
    return rows.select("kind", "id", "part", F.col("r.text").alias("text"))


def turns(spark, folder):
    return texts(spark, folder, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("qid"), "role", "text"
    )


def query_guard(spark, folder):
    return turns(spark, folder).filter(valid_query(F.col("text"))).select("qid")


def guard_stage(spark, folder):
    safe, refused = guard_queries(turns(spark, folder))
    return safe.select("qid", "text", "pii_redacted", F.lit(None).cast("string").alias("reason")).unionByName(
        refused.select("qid", "text", F.lit(False).alias("pii_redacted"), "reason")
    )


def guardrail_counts(spark, folder):
    """Texts per guard outcome, and spans per type of personal data."""
    rows = all_texts(spark, folder)
    blocked = rows.filter(injection_assessment(F.col("text"))["blocked"]).select(F.lit("injection").alias("guardrail"))
    spans = rows.select(F.explode(redact_pii(F.col("text"))["matches"]).alias("m"))
    kinds = spans.select(F.concat(F.lit("pii_"), F.col("m.type")).alias("guardrail"))
    return blocked.unionByName(kinds).groupBy("guardrail").agg(F.count("*").alias("hits"))


QUERIES = {
    "injection_score": injection_score,
    "pii_flags": pii_flags,
    "pii_email_iban": pii_email_iban,
    "pii_spans": pii_spans,
    "pii_redact": pii_redact,
    "query_guard": query_guard,
    "guard_stage": guard_stage,
    "guardrail_counts": guardrail_counts,
}

_TEXTS = """texts as (
  select 'document' as kind, doc_id as id, 0::bigint as part, text from documents
  union all select 'turn', conv_id, turn, text from conversations)"""


def _rule(flags: str, pattern: str) -> str:
    # Word boundaries see ASCII letters only here, so other letters become an ASCII one.
    plain = r"regexp_replace(text, '[^\x00-\x7f]', 'x', 'g')"
    return f"regexp_matches({plain}, '{f'(?{flags})' if flags else ''}{pattern}')"


_HITS = ", ".join(f"{_rule(flags, pattern)} as {name}" for name, flags, pattern, _ in INJECTION_RULES)
# The weights once more, so that the SQL does not depend on the function it checks. As decimals
# products are exact.
_MISSED = " * ".join(
    f"(case when {name} then {left} else 1 end)::decimal(3, 2)"
    for name, left in (
        ("override_instructions", "0.40"),
        ("reveal_system_prompt", "0.40"),
        ("role_hijack", "0.55"),
        ("delimiter_escape", "0.50"),
        ("safety_bypass", "0.40"),
        ("encoded_payload", "0.65"),
    )
)
_NAMES = "[" + ", ".join(f"case when {name} then '{name}' end" for name, *_ in INJECTION_RULES) + "]"

# Patterns of personal data by hand: this engine has no look-around, so what comes before a value is matched with it.
_AROUND = {
    "email": ("", r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+", ""),
    "credit_card": ("(?:^|[^0-9A-Za-z])", "(?:[0-9][ -]?){12,18}[0-9]", r"\b"),
    "ssn": ("(?:^|[^0-9])", "[0-9]{3}-[0-9]{2}-[0-9]{4}", "(?:$|[^0-9])"),
    "iban": (r"\b", "[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", r"\b"),
    "ip_address": ("(?:^|[^0-9])", r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}", "(?:$|[^0-9])"),
    "phone": (
        "(?:^|[^0-9A-Za-z])",
        r"\+?[0-9]{1,3}[\s.-]?\(?[0-9]{2,4}\)?[\s.-]?[0-9]{2,4}[\s.-]?[0-9]{2,4}[\s.-]?[0-9]{0,4}",
        r"\b",
    ),
}
_LUHN = """(length({0}) >= 13 and list_sum(list_transform(range(1, length({0}) + 1), lambda i:
  case when (length({0}) - i) % 2 = 0 then substr({0}, i, 1)::int
       when substr({0}, i, 1)::int > 4 then substr({0}, i, 1)::int * 2 - 9 else substr({0}, i, 1)::int * 2 end)) % 10 = 0)"""


def _found(kind: str) -> str:
    before, value, after = _AROUND[kind]
    text = r"regexp_replace(text, '[^\x00-\x7f]', 'x', 'g')" if kind == "iban" else "text"
    return f"regexp_extract_all({text}, '{before}({value}){after}', 1)"


SQL = {
    "injection_score": f"""with {_TEXTS},
        hits as (select kind, id, part, {_HITS} from texts),
        scored as (select *, 1 - {_MISSED} as score from hits)
        select kind, id, part, round(score::double, 4) as score, score >= 0.5 as blocked,
               array_to_string(list_filter({_NAMES}, lambda n: n is not null), ',') as rules from scored""",
    "pii_email_iban": rf"""with {_TEXTS}
        select kind, id, part,
               array_to_string(regexp_extract_all(text, '[\p{{L}}\p{{N}}_.+-]+@[\p{{L}}\p{{N}}_-]+\.[\p{{L}}\p{{N}}_.-]+'), ' ') as email,
               array_to_string(regexp_extract_all(regexp_replace(text, '[^\x00-\x7f]', 'x', 'g'),
                               '\b[A-Z]{{2}}\d{{2}}[A-Z0-9]{{11,30}}\b'), ' ') as iban
        from texts""",
    "pii_flags": rf"""with {_TEXTS},
        found as (
          select kind, id, part, {_found("email")} as email, {_found("credit_card")} as credit_card, {_found("ssn")} as ssn,
                 {_found("iban")} as iban, {_found("ip_address")} as ip_address, {_found("phone")} as phone
          from texts)
        select kind, id, part, len(email)::int as email, len(ssn)::int as ssn, len(iban)::int as iban,
               len(list_filter(credit_card, lambda v: {_LUHN.format("regexp_replace(v, '[ -]', '', 'g')")}))::int as credit_card,
               len(list_filter(ip_address, lambda v:
                 list_max(list_transform(string_split(v, '.'), lambda o: o::int)) <= 255))::int as ip_address,
               len(list_filter(phone, lambda v: length(regexp_replace(v, '[^0-9]', '', 'g')) between 10 and 15))::int as phone
        from found""",
    "query_guard": "select conv_id || ':' || turn as qid from conversations where length(text) between 1 and 4000",
}
