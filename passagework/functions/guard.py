"""Prompt-injection scoring and personal-data detection."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, insort
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from passagework.defaults import INJECTION_THRESHOLD, PII_TYPES
from passagework.functions.text import let, once

# Rule names, patterns, flags and weights decide the scores.
INJECTION_RULES = (
    (
        "override_instructions",
        "is",
        r"\b(ignore|forget|disregard)\b.{0,40}\b(previous|prior|above|all|any|earlier)\b"
        r".{0,40}\b(instruction|prompt|rule|context)",
        0.6,
    ),
    (
        "reveal_system_prompt",
        "is",
        r"\b(reveal|show|print|repeat|output|leak)\b.{0,40}\b(system prompt|initial prompt|"
        r"hidden instruction|your instruction)",
        0.6,
    ),
    (
        "role_hijack",
        "i",
        r"\b(you are now|pretend (to be|you are)|act as|new persona|jailbreak|"
        r"developer mode|dan mode)\b",
        0.45,
    ),
    (
        "delimiter_escape",
        "im",
        r"<\|[^|]{1,30}\|>|\[/?(INST|SYS|SYSTEM)\]|^#{1,4}\s*(system|instruction)\b",
        0.5,
    ),
    (
        "safety_bypass",
        "is",
        r"\b(bypass|disable|override|remove)\b.{0,40}\b(safety|filter|guardrail|"
        r"restriction|moderation)",
        0.6,
    ),
    ("encoded_payload", "", r"[A-Za-z0-9+/]{80,}={0,2}", 0.35),
)

# The patterns decide which spans count as personal data.
PII_PATTERNS = {
    "email": r"[\w.+-]+@[\w-]+\.[\w.-]+",
    "credit_card": r"(?<![\dA-Za-z])(?:\d[ -]?){13,19}(?![\dA-Za-z])",
    "ssn": r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)",
    "iban": r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b",
    "ip_address": r"(?<!\d)(?:\d{1,3}\.){3}\d{1,3}(?!\d)",
    "phone": (
        r"(?<![\dA-Za-z])\+?\d{1,3}[\s.-]?\(?\d{2,4}\)?[\s.-]?\d{2,4}[\s.-]?\d{2,4}"
        r"[\s.-]?\d{0,4}(?![\dA-Za-z])"
    ),
}
SPAN_TYPE = "array<struct<type:string,value:string,start:int,end:int>>"


def injection_flags(col: Column) -> list[Column]:
    """One boolean per rule, in rule order; (?U) gives Java the Unicode classes Python has,
    (?d) its notion of a line: only a line feed ends one."""
    return [col.rlike(f"(?{flags}Ud){pattern}") for _, flags, pattern, _ in INJECTION_RULES]


def noisy_or(mask: int) -> float:
    hit = [w for bit, (_, _, _, w) in enumerate(INJECTION_RULES) if mask >> bit & 1]
    return 1.0 - math.prod(1.0 - w for w in hit) if hit else 0.0


def injection_assessment(col: Column, threshold: float = INJECTION_THRESHOLD) -> Column:
    """STRUCT<score, matched_rules, blocked>.

    Six rules give 64 possible scores. They are worked out once here, so the
    rounding of ties is decided in one place and the plan only looks them up.
    """
    if not 0.0 < threshold <= 1.0:
        raise ValueError("threshold must be in (0, 1]")
    raw = [noisy_or(mask) for mask in range(1 << len(INJECTION_RULES))]
    scores = F.array(*[F.lit(round(s, 4)) for s in raw])
    blocked = F.array(*[F.lit(s >= threshold) for s in raw])
    names = F.array(*[F.lit(name) for name, *_ in INJECTION_RULES])

    def assess(hits: Column) -> Column:
        mask = F.lit(0)
        for bit in range(len(INJECTION_RULES)):
            mask = mask + F.when(F.get(hits, F.lit(bit)), 1 << bit).otherwise(0)
        return F.struct(
            F.get(scores, mask).alias("score"),
            F.filter(names, lambda _, i: F.get(hits, i)).alias("matched_rules"),
            F.get(blocked, mask).alias("blocked"),
        )

    return let(F.array(*injection_flags(col)), assess)


def luhn_valid(digits: str) -> bool:
    if len(digits) < 13 or not digits.isdigit():
        return False
    values = [int(d) for d in digits[::-1]]
    doubled = (v * 2 - 9 if v > 4 else v * 2 for v in values[1::2])
    return (sum(values[::2]) + sum(doubled)) % 10 == 0


def luhn(col: Column) -> Column:
    """At least 13 digits, nothing else, and a right check digit."""
    return F.coalesce(
        col.rlike("^[0-9]{13,}$") & F.call_function("luhn_check", col), F.lit(False)
    )


def valid_ip(col: Column) -> Column:
    return F.forall(F.split(col, r"\."), lambda octet: octet.cast("int") <= 255)


def digit_count(col: Column) -> Column:
    return F.length(F.regexp_replace(col, r"(?U)\D", ""))


def pii_values(col: Column, kind: str) -> Column:
    """All valid matches of one type, overlaps between types not resolved; JVM only."""
    found = F.regexp_extract_all(col, F.lit(f"((?U){PII_PATTERNS[kind]})"), F.lit(1))
    if kind == "credit_card":
        return F.filter(found, lambda v: luhn(F.regexp_replace(v, "[ -]", "")))
    if kind == "ip_address":
        return F.filter(found, valid_ip)
    if kind == "phone":
        return F.filter(found, lambda v: digit_count(v).between(10, 15))
    return found


_COMPILED = {kind: re.compile(pattern) for kind, pattern in PII_PATTERNS.items()}


def _is_real(kind: str, value: str) -> bool:
    if kind == "credit_card":
        return luhn_valid(value.replace(" ", "").replace("-", ""))
    if kind == "ip_address":
        return all(int(octet) <= 255 for octet in value.split("."))
    if kind == "phone":
        return 10 <= sum(c.isdigit() for c in value) <= 15
    return True


def pii_spans(text: str, kinds: tuple[str, ...]) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) in text order; an earlier type keeps what it claimed."""
    taken: list[tuple[int, int, str]] = []
    for kind in kinds:
        for match in _COMPILED[kind].finditer(text):
            start, end = match.span()
            if not _is_real(kind, match.group()):
                continue
            at = bisect_left(taken, (start, end, kind))
            before_clear = at == 0 or taken[at - 1][1] <= start
            after_clear = at == len(taken) or taken[at][0] >= end
            if before_clear and after_clear:
                insort(taken, (start, end, kind))
    return taken


def _ordered(kinds: Iterable[str] | None) -> tuple[str, ...]:
    wanted = set(kinds) if kinds is not None else set(PII_TYPES)
    unknown = wanted - set(PII_TYPES)
    if unknown:
        raise ValueError(f"unknown PII types: {sorted(unknown)}")
    return tuple(k for k in PII_TYPES if k in wanted)


def redact_pii(col: Column, kinds: Iterable[str] | None = None) -> Column:
    """STRUCT<text, matches>: the text with [TYPE] in place of every span, and the spans.

    Texts with neither "@" nor a digit cannot match; they reach Python as NULL
    and are restored here.
    """
    order = _ordered(kinds)

    @F.pandas_udf(f"text string, matches {SPAN_TYPE}")
    def scan(texts: pd.Series) -> pd.DataFrame:
        out_text: list[str | None] = []
        out_spans: list[list[dict] | None] = []
        for text in texts:
            if text is None:
                out_text.append(None)
                out_spans.append(None)
                continue
            spans = pii_spans(text, order)
            pieces, at = [], 0
            for start, end, kind in spans:
                pieces += [text[at:start], f"[{kind.upper()}]"]
                at = end
            out_text.append("".join(pieces) + text[at:])
            out_spans.append(
                [{"type": k, "value": text[s:e], "start": s, "end": e} for s, e, k in spans]
            )
        return pd.DataFrame({"text": out_text, "matches": out_spans})

    scanned = once(scan)(F.when(col.rlike(r"(?U)[@\d]"), col))
    return F.struct(
        F.coalesce(scanned["text"], col).alias("text"),
        F.coalesce(scanned["matches"], F.array().cast(SPAN_TYPE)).alias("matches"),
    )
