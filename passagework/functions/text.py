"""Text cleaning, tokens, sentences and term counts as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What Python's str.split() and str.splitlines() treat as blank
# and as a line end. Java's \s and \R differ, so the classes are spelled out.
BLANK = r"[\s\x0B\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# Blanks that end no line, without the space; line ends other than \n.
_TAB = r"\t\x1f\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}"
_OTHER_END = r"\r\n|[\x0B\f\r\x1c-\x1e\x85\x{2028}\x{2029}]"
WORD = r"[\p{L}\p{N}_]+"
_NO_WORD = r"[^\p{L}\p{N}_]++"
# The characters of BLANK one by one.
_BLANKS = "".join(
    map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
SENTENCE_BREAK = rf"(?<=[.!?]){BLANK}+|\n{{2,}}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind `value` once and evaluate `body` on it.

    Inside a lambda an outer expression is evaluated again for every element;
    a bound variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(udf):
    """Have `udf` evaluated once per row.

    Python functions count as cheap to the optimizer, which copies them into
    filters and generators and moves the copies below a repartitioning. Declared
    as non-deterministic they stay where they are written.
    """
    return udf.asNondeterministic()


def strip(col: Column) -> Column:
    """Remove blanks of every kind at both ends (SQL trim removes spaces only)."""
    return F.btrim(col, F.lit(_BLANKS))


def collapse(col: Column) -> Column:
    """Every run of blanks becomes one space; none is left at the ends. A single space is no match."""
    other = BLANK.replace(r"\s", r"\t\n\f\r")
    return F.trim(F.regexp_replace(col, rf"{other}{BLANK}*| {BLANK}+", " "))


def normalize_text(col: Column) -> Column:
    """Collapse blanks within lines, allow one empty line in a row, strip the ends.

    After the first two steps spaces and \\n are the only blanks, and no two spaces are neighbours.
    """
    single = F.regexp_replace(col, rf"[{_TAB}][ {_TAB}]*| [ {_TAB}]+", " ")
    lines = F.regexp_replace(single, _OTHER_END, "\n")
    for edge in (" \n", "\n "):
        lines = F.replace(lines, F.lit(edge), F.lit("\n"))
    return F.btrim(F.regexp_replace(lines, r"\n{3,}", "\n\n"), F.lit(" \n"))


def content_hash(col: Column) -> Column:
    """SHA-256 of the text, blind to case and to the amount of blank space."""
    return F.sha2(F.lower(collapse(col)), 256)


def tokenize(col: Column) -> Column:
    """Runs of letters, digits and underscores in any script, lower-cased."""
    return F.transform(F.regexp_extract_all(col, F.lit(f"({WORD})"), F.lit(1)), F.lower)


def words(col: Column) -> Column:
    """The tokens of `tokenize` in one string, with a space between two: cheaper to make, to store and to send than a list."""
    return F.lower(F.btrim(F.regexp_replace(col, _NO_WORD, " ")))


def split_sentences(col: Column) -> Column:
    """Cut after . ! ? followed by blanks, and at paragraph breaks; empty parts vanish."""
    parts = F.transform(F.split(col, SENTENCE_BREAK), strip)
    return F.filter(parts, lambda part: part != "")


def term_counts(tokens: Column) -> Column:
    """MAP<term, count> of one token list, by run lengths of the sorted list.

    Works inside the row, so counting terms needs no shuffle.
    """

    def runs(ordered: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(ordered) - 1),
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )
        return let(
            starts,
            lambda s: F.map_from_arrays(
                F.transform(s, lambda i: F.get(ordered, i)),
                F.transform(s, lambda i, j: F.coalesce(F.get(s, j + 1), F.size(ordered)) - i),
            ),
        )

    empty = F.create_map().cast("map<string,int>")
    # sort_array compares natively; array_sort would interpret a comparator per pair.
    return let(F.sort_array(tokens), lambda o: F.when(F.size(o) > 0, runs(o)).otherwise(empty))


def fixed_chunks(col: Column, size: int, overlap: int) -> Column:
    """Windows of `size` characters, each starting `size - overlap` after the last.

    The last window is the first that reaches the end of the text; empty text has none.
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    step = size - overlap

    def windows(text: Column) -> Column:
        last = F.greatest(F.ceil((F.length(text) - overlap) / step).cast("int") - 1, F.lit(0))
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.substring(text, i * step + 1, F.lit(size)),
        )

    return F.when(F.length(col) > 0, let(col, windows)).otherwise(F.array().cast("array<string>"))
