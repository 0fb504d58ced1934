"""Lenient JSON out of model output, with fallbacks for what does not parse."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from passagework.defaults import CATEGORIES
from passagework.functions.text import strip

ROUTE_SCHEMA = "category string, reasoning string"
CRITIQUE_SCHEMA = "verdict string, grounded boolean, issues array<string>"
VERDICTS = ("approve", "revise")


def json_candidate(col: Column) -> Column:
    """The fenced JSON block if there is one, else the outermost braces, else the text."""
    text = strip(col)
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(fenced != "", fenced).when(braces != "", braces).otherwise(text)


def parse_json(col: Column, schema: str) -> Column:
    return F.from_json(json_candidate(col), schema, {"allowSingleQuotes": "false"})


def parse_route(col: Column) -> Column:
    """STRUCT<category, reasoning, fallback>; anything invalid counts as factual."""
    parsed = parse_json(col, ROUTE_SCHEMA)
    ok = F.coalesce(parsed["category"].isin(*CATEGORIES), F.lit(False))
    return F.struct(
        F.when(ok, parsed["category"]).otherwise("factual").alias("category"),
        F.when(ok, F.coalesce(parsed["reasoning"], F.lit(""))).otherwise("").alias("reasoning"),
        (~ok).alias("fallback"),
    )


def parse_critique(col: Column) -> Column:
    """STRUCT<verdict, grounded, issues, fallback>; anything invalid counts as approval."""
    parsed = parse_json(col, CRITIQUE_SCHEMA)
    ok = F.coalesce(parsed["verdict"].isin(*VERDICTS), F.lit(False))
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(ok, parsed["verdict"]).otherwise("approve").alias("verdict"),
        F.when(ok, F.coalesce(parsed["grounded"], F.lit(True))).otherwise(True).alias("grounded"),
        F.when(ok, F.coalesce(parsed["issues"], none)).otherwise(none).alias("issues"),
        (~ok).alias("fallback"),
    )
