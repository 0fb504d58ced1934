"""HTML and Markdown to text.

`html_to_text` walks the tags of each page with the standard parser inside
Arrow batches. `strip_html` and `strip_markdown` are the JVM-side chains for
input that is well-formed enough for patterns.
"""

from __future__ import annotations

from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from passagework.functions.text import normalize_text, once

HIDDEN = frozenset({"script", "style", "noscript"})
# HTML elements that never have content.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr "
    "basefont bgsound command frame image isindex keygen menuitem nextid spacer".split()
)


class _VisibleText(HTMLParser):
    """Collects text nodes. The parser hands a node over in pieces; tags and comments end it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.parts: list[str] = []
        self.node: list[str] = []

    def end_node(self) -> None:
        if self.node:
            self.parts.append("".join(self.node))
            self.node = []

    def handle_starttag(self, tag, attrs):
        self.end_node()
        if tag not in VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        self.end_node()
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_comment(self, data):
        self.end_node()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def handle_data(self, data):
        if HIDDEN.isdisjoint(self.open):
            self.node.append(data)


def visible_text(page: str) -> str:
    parser = _VisibleText()
    parser.feed(page)
    parser.close()
    parser.end_node()
    return "\n".join(parser.parts)


def html_to_text(col: Column) -> Column:
    """Text nodes outside script, style and noscript, one per line, normalised."""

    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        return pages.map(visible_text, na_action="ignore")

    return normalize_text(once(extract)(col))


# The entities that pages use most, ampersand last so that
# "&amp;lt;" stays "&lt;".
ENTITIES = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&nbsp;", " "),
    ("&amp;", "&"),
)
HTML_STEPS = (
    (r"(?is)<!--.*?-->|<!doctype[^>]*>", "\n"),
    (r"(?is)<script\b.*?</script\s*>", "\n"),
    (r"(?is)<style\b.*?</style\s*>", "\n"),
    (r"(?is)<noscript\b.*?</noscript\s*>", "\n"),
    (r"(?s)</?[A-Za-z][^>]*>", "\n"),
)
#: A fenced block with its content as the second group; the closing fence may be missing.
FENCE = r"(?m)^ {0,3}(```+|~~~+)[^\n]*\n((?s:.*?))(?:^ {0,3}\1[`~]*[ \t]*$|\z)"
#: A code span with its content as the first group.
SPAN = r"`([^`\n]+)`"
# Rules and setext underlines, headings, quotes, list marks.
BLOCK_STEPS = (
    (r"(?m)^ {0,3}(?:(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$", ""),
    (r"(?m)^ {0,3}(?:=+|-+(?:[ \t]*-)*)[ \t]*$", ""),
    (r"(?m)^ {0,3}#{1,6}(?:[ \t]+|$)", ""),
    (r"(?m)[ \t]+#+[ \t]*$", ""),
    (r"(?m)^ {0,3}>[ \t]?", ""),
    (r"(?m)^[ \t]*(?:[-*+]|[0-9]{1,9}[.)])[ \t]+", ""),
)
# Images vanish, links keep their text. A mark of emphasis touches what it marks, and an
# underscore stands outside words.
INLINE_STEPS = (
    (r"!\[[^\]\n]*\]\([^)\n]*\)", ""),
    (r"\[([^\]\n]*)\]\([^)\n]*\)", "$1"),
    (r"\*\*(?=[^\s*])([^*\n]*[^\s*])\*\*", "$1"),
    (r"(?<![\p{L}\p{N}_])__(?=[^\s_])([^\n]*?[^\s_])__(?![\p{L}\p{N}_])", "$1"),
    (r"\*(?=[^\s*])([^*\n]*[^\s*])\*", "$1"),
    (r"(?<![\p{L}\p{N}_])_(?=[^\s_])([^\n]*?[^\s_])_(?![\p{L}\p{N}_])", "$1"),
)


def strip_html(col: Column) -> Column:
    for pattern, to in HTML_STEPS:
        col = F.regexp_replace(col, pattern, to)
    for entity, char in ENTITIES:
        col = F.replace(col, F.lit(entity), F.lit(char))
    return normalize_text(col)


def _steps(col: Column, steps: tuple[tuple[str, str], ...]) -> Column:
    for pattern, to in steps:
        col = F.regexp_replace(col, pattern, to)
    return col


def _around(col: Column, pattern: str, group: int, change: Callable[[Column], Column]) -> Column:
    """Change what lies between matches; of a match keep one group as it is."""
    between = F.transform(F.split(col, pattern), change)
    inside = F.regexp_extract_all(col, F.lit(pattern), F.lit(group))
    joined = F.zip_with(between, inside, lambda b, i: F.concat(F.coalesce(b, F.lit("")), F.coalesce(i, F.lit(""))))
    return F.when(col.isNotNull(), F.array_join(joined, ""))


def strip_markdown(col: Column) -> Column:
    """Drop the common marks; code in fences and spans stays as it is. Not a full renderer."""

    def inline(text: Column) -> Column:
        return _around(_steps(text, BLOCK_STEPS), SPAN, 1, lambda t: _steps(t, INLINE_STEPS))

    return normalize_text(_around(col, FENCE, 2, inline))
