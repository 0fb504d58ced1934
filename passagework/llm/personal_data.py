"""Personal data in texts: fixed patterns, and what a conditional random field finds beyond them.

The patterns decide the base spans (email, ip, card, phone). The field (`crf`) is trained
from a small labelled table in which the same kinds also stand in other forms: addresses
with words for their signs, numbers without a leading plus, cards cut by dots or wider
blanks, addresses of the newer internet protocol; among dates, prices, versions, keys and
other numbers that are nobody's. Its sequences are the stretches of a line around a digit,
an at sign or a written one (everything else can hold none of the kinds); all sequences of
an Arrow slice are decoded together by Viterbi. A span of the field is added if its form is
possible for its kind (`plausible`: Luhn, digit counts, address syntax) and it overlaps no
base span. Base spans always stay.

`find` gives spans (kind, start, end, base) in code points, end exclusive, in the order of
start and kind; `redact` replaces them. Both take any table with a text column.

Defined cases: a null or empty text has no span; repeated rows each get theirs; columns of
the table are carried in the struct `row` and cannot clash; very long texts are read whole,
in time linear in their length; an empty table gives no rows; an empty labelled table, or
one without a known kind, leaves the base spans alone. Of a labelled table with more than
TRAIN_ROWS rows those with the smallest hash of text and spans are learnt from; rows with a
null text or null spans teach nothing.
"""

from __future__ import annotations

import ipaddress
import random
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from passagework.llm import crf
from passagework.llm.common import as_texts, carried, text_slices

#: Kinds in the order that breaks ties, and what their base spans look like.
KINDS = ["email", "ip", "card", "phone"]
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# Possessive repeats and the look-behind change no match: no part can begin or end elsewhere.
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
A_DIGIT, BLANK = re.compile("[0-9]"), re.compile(r"\s")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
DIALLED = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

TRAIN_ROWS = 2_000
#: Characters on either side of a trigger that belong to its sequence.
AROUND = 48
TRIGGER = re.compile(r"[0-9]+|@|[\[({]\s?[aA][tT]\s?[\])}]|\b[dD][oO][tT]\b")

SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"
LABELLED = "text string, spans array<struct<kind:string,start:int,end:int>>"

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _emails(text: str) -> Iterator[Span]:
    """Every at sign with the run of local characters before it; the same as matching from the left, in linear time."""
    free = 0
    at = text.find("@")
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield "email", start, domain.end()
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[Span]:
    """The spans that the fixed patterns decide."""
    found = list(_emails(text))
    if A_DIGIT.search(text):
        found += [("ip", *m.span()) for m in ADDRESS.finditer(text) if all(map(_octet, m.group().split(".")))]
        for m in DIGITS.finditer(text):
            if 12 <= len(digits := digits_of(m.group())) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        found += [("phone", *m.span()) for m in DIALLED.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def stretches(text: str) -> list[tuple[int, int]]:
    """The parts of lines around triggers, cut at blanks; they do not overlap."""
    found: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        start, end = max(0, m.start() - AROUND), m.end() + AROUND
        if found and start <= found[-1][1]:
            found[-1][1] = end
        else:
            found.append([start, end])
    out = []
    free = 0
    for start, end in found:
        # Grown to the next blanks, so that no word is cut; what the one before took is taken.
        if end > free:
            start = max(free, text.rfind(" ", free, start) + 1, text.rfind("\n", free, start) + 1) if start > free else free
            blank = BLANK.search(text, end)
            free = blank.start() if blank else len(text)
            begin = start
            for line in text[start:free].split("\n"):
                if line.strip():
                    out.append((begin, begin + len(line)))
                begin += len(line) + 1
    return out


def plausible(kind: str, text: str) -> bool:
    """Whether a span of the field can be of its kind."""
    digits = digits_of(text)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 7 <= len(digits) <= 15 and not re.search(r"[^0-9+(). /-]", text)
    if kind == "ip":
        try:
            return bool(ipaddress.ip_address(re.sub(r"\s", "", text)))
        except ValueError:
            return False
    signs = re.sub(r"(?i)\s*[\[({]\s?at\s?[\])}]\s*|\s+at\s+|\s*@\s*", "@", text)
    signs = re.sub(r"(?i)\s*[\[({]\s?dot\s?[\])}]\s*|\s+dot\s+", ".", signs)
    return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", signs))


def merged(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the parts that spans, sorted by their start, cover together."""
    starts, ends = [], []
    for _, start, end in spans:
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def added_spans(text: str, base: list[Span], guessed: list[Span]) -> list[Span]:
    """Guesses of a possible form that overlap no base span."""
    starts, ends = merged(base)

    def is_free(start: int, end: int) -> bool:
        before = bisect_left(starts, end)
        return not before or ends[before - 1] <= start

    return [g for g in guessed if is_free(*g[1:]) and plausible(g[0], text[g[1] : g[2]])]


def spans_of(texts: list[str], model: crf.Field) -> list[list[tuple[str, int, int, bool]]]:
    """All spans (kind, start, end, base) of each text."""
    places = [(i, s, e) for i, t in enumerate(texts) for s, e in stretches(t)]
    guessed: list[list[Span]] = [[] for _ in texts]
    for (i, start, _), spans in zip(places, model.decode([texts[i][s:e] for i, s, e in places])):
        guessed[i] += [(k, s + start, e + start) for k, s, e in spans]
    out = []
    for text, more in zip(texts, guessed):
        own = base_spans(text)
        every = [(*s, True) for s in own] + [(*s, False) for s in added_spans(text, own, more)]
        out.append(sorted(every, key=lambda s: (s[1], KINDS.index(s[0]))))
    return out


def train(labelled: DataFrame, turns: int = crf.TURNS) -> crf.Field:
    """A field from a table LABELLED; at most TRAIN_ROWS rows reach the driver."""
    rows = labelled.filter("text is not null and spans is not null").select("text", "spans").orderBy(F.xxhash64("text", F.to_json("spans")), "text")
    table = [(r["text"], [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] in KINDS]) for r in rows.limit(TRAIN_ROWS).collect()]
    return crf.fit(table, KINDS, turns)


def _mapped(docs: DataFrame, columns: list[str], text: str, model: crf.Field, schema: str, derive: Callable) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*carried(docs, columns, text))
    schema = StructType([source.schema["row"], *StructType.fromDDL(schema).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, columns, text):
            texts = as_texts(batch.column("_text"))
            yield derive(batch.column("row"), batch.column("_text"), texts, spans_of(texts, shared.value))

    return source.mapInArrow(run, schema)


_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def find(docs: DataFrame, columns: list[str], model: crf.Field, text: str = "text") -> DataFrame:
    """(row, spans): `columns` of each row, and its spans."""

    def derive(row, _, texts, spans):
        named = [[dict(zip(("kind", "start", "end", "base"), s)) for s in own] for own in spans]
        return pa.RecordBatch.from_arrays([row, pa.array(named, _SPAN_TYPE)], names=["row", "spans"])

    return _mapped(docs, columns, text, model, f"spans {SPANS}", derive)


def redact(docs: DataFrame, columns: list[str], model: crf.Field, text: str = "text") -> DataFrame:
    """(row, redacted): the text with [KIND] for every span; overlapping spans become one, named by the first."""

    def derive(row, column, texts, spans):
        clean = [None if not valid else replaced(t, own) for valid, t, own in zip(column.is_valid().to_pylist(), texts, spans)]
        return pa.RecordBatch.from_arrays([row, pa.array(clean, pa.string())], names=["row", "redacted"])

    return _mapped(docs, columns, text, model, "redacted string", derive)


def replaced(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    parts, at, end = [], 0, 0
    for kind, start, stop, _ in spans:
        if start >= end:
            parts += [text[at:start], f"[{kind.upper()}]"]
        end = at = max(end, stop)
    return "".join([*parts, text[at:]])


def digests() -> list[Column]:
    """The columns of the report: counts and digest of the base spans, and all spans as text."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, k)) for k in KINDS]
    counts = [(F.size(base) - rest).cast("long").alias(f"n_{k}") for k, rest in zip(KINDS, counts)]
    return [*counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")]


# The labelled table that comes with the operator: forms and settings, combined by rule.
LABELLED_ROWS = 600

_FIRST = "anna ben carla david eva frank grace hugo ines jonas karla leo mina nils olga paul rosa tom".split()
_LAST = "alder brook castle dean ellis fox grant hill irving jones king lake marsh north oak park reed stone".split()
_PLACES = "example acme mail office studio garden river atlas nova harbor".split()
_ENDS = "com org net de fr es io co.uk".split()
_PROSE = "the of and we in our to was this that with from der die und les une para con were there then river house long small over under again green paper stone walks reads late early morning evening".split()

#: Settings; {email} and so on stand for a form of that kind, {other} for a number or sign that is nobody's, {words} for prose.
_SETTINGS = """
{words} {email} {words} | contact {email} for {words} | e-mail: {email} | mail {email} or {email} | write to {email}, {words}
{words} {ip} {words} | server {ip} {words} | login from {ip} at {other} | host {ip}, {words} | address {ip}
{words} {card} {words} | card {card} {words} | paid with {card} on {other} | visa: {card} | card number {card}, {words}
call {phone} {words} | phone: {phone} | tel. {phone}, {words} | fax {phone} or phone {phone} | ring me at {phone} {words} | mobile {phone}
{words} {other} {words} | {other} {words} {other} | {words} {words} {other}. | look at {other} {words} | the dot at {words} | {words} dot {words} at {words}
{words} at {other} {words} | order {other}, {words} {other} | {words} in {other} and {other} {words} | page {other} | {words} (at {words})
{words} @ {other} | meet @ {words} | {other} {other} {other} | {words} 'at' the {words} | total {other}
"""


def _number(rng: random.Random, size: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(size))


def _card(rng: random.Random) -> str:
    body = rng.choice("3456") + _number(rng, rng.choice((14, 14, 14, 13, 12)))
    return next(body + d for d in "0123456789" if luhn(body + d))


def _email(rng: random.Random) -> str:
    name = rng.choice(_FIRST) + rng.choice([".", "_", "", "-"]) + rng.choice(_LAST) + rng.choice(["", "", str(rng.randint(1, 99))])
    where, end = rng.choice(_PLACES), rng.choice(_ENDS)
    at, dot = rng.choice([("@", "."), ("@", "."), (" at ", " dot "), ("[at]", "."), (" [at] ", " [dot] "), ("(at)", "."), (" (at) ", " (dot) "), (" (at) ", ".")])
    if dot == " dot " and rng.random() < 0.5:
        name = name.replace(".", " dot ")
    return rng.choice([str, str, str.capitalize])(f"{name}{at}{where}{end if end.startswith('.') else dot + end.replace('.', dot)}")


def _ip(rng: random.Random) -> str:
    if rng.random() < 0.5:
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    words = [f"{rng.randint(0, 0xFFFF):x}" for _ in range(8)]
    return rng.choice([":".join(words), ":".join(f"{int(w, 16):04x}" for w in words), f"2001:db8::{words[0]}", f"fe80::{':'.join(words[:4])}"])


def _grouped_card(rng: random.Random) -> str:
    digits = _card(rng)
    gap = rng.choice(["", " ", "-", ".", " . ", "  ", " - "])
    return gap.join(digits[i : i + 4] for i in range(0, len(digits), 4))


def _phone(rng: random.Random) -> str:
    a, b, c = _number(rng, 3), _number(rng, 3), _number(rng, 4)
    national = [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{a} {b}{c}", f"0{a}/{b}{c}", f"00{a[:2]} {b} {c}{a}", f"({a}){b}-{c}", f"{a} {b} {c}"]
    return rng.choice([*national, f"+{rng.randint(1, 99)} ({a}) {b}-{c}", f"+{rng.randint(1, 99)} {a} {b}{c}"])


def _other(rng: random.Random) -> str:
    n = lambda size: _number(rng, size)
    hexed = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    return rng.choice(
        [
            n(1), n(2), n(4), n(16), n(12), f"{n(1)}.{n(1)}", f"{n(1)}.{n(1)}.{n(1)}", f"{rng.randint(1, 28)}/{rng.randint(1, 12)}/20{n(2)}",
            f"20{n(2)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.20{n(2)}", f"{rng.randint(10, 23)}:{rng.randint(10, 59)}",
            f"{rng.randint(10, 23)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}", f"$ {n(3)}.{n(2)}", f"{n(1)},{n(3)}.{n(2)}", f"{n(2)} %", f"19{n(2)}-20{n(2)}", f"#{n(5)}", f"{n(3)}-{n(3)}",
            f'token = "{hexed}"', f"password={hexed[:18]}", f"AKIA{hexed[:16].upper()}", f"v{n(1)}.{n(2)}", f"Version {n(1)}.{n(1)}", f"BY-NC {n(1)}.0", f"{n(1)}:{n(1)}",
            f"{n(2)}:{hexed[:2]}:{hexed[2:4]}:{hexed[4:6]}:{n(2)}:{n(2)}", f"978-{n(1)}-{n(2)}-{n(6)}-{n(1)}", f"{n(3)}.{n(3)}.{n(3)},{n(2)}", f"{n(2)}***", f"{n(2)} x {n(2)}", f"({n(2)})",
            f"{n(3)}.{n(3)}.{n(3)}.{n(3)}.{n(3)}", f"{n(8)}", f"{n(7)}", f"{n(4)}-{n(4)}", f"chapter {n(2)}.{n(1)}.{n(1)}",
        ]
    )


_FORMS = {"email": _email, "ip": _ip, "card": _grouped_card, "phone": _phone, "other": _other}


def _words(rng: random.Random) -> str:
    own = "".join(rng.choice(["ba", "en", "the", "lo", "ri", "ón", "eux", "sch"]) for _ in range(3))
    picked = [rng.choice([*_PROSE, own]) for _ in range(rng.randint(2, 7))]
    return " ".join(picked) + rng.choice(["", "", ".", ","])


def examples(rows: int = LABELLED_ROWS, seed: int = 1) -> list[tuple[str, list[Span]]]:
    """Labelled rows (text, spans), the same for the same seed."""
    rng = random.Random(seed)
    settings = [s.strip() for s in re.split(r"[|\n]", _SETTINGS) if s.strip()]
    out = []
    for i in range(rows):
        text, spans = "", []
        for part in re.split(r"(\{\w+\})", settings[i % len(settings)]):
            kind = part[1:-1] if part.startswith("{") else None
            value = part if kind is None else _words(rng) if kind == "words" else _FORMS[kind](rng)
            if kind in KINDS:
                spans.append((kind, len(text), len(text) + len(value)))
            text += value
        out.append((text, spans))
    return out


def labelled_table(spark: SparkSession, rows: int = LABELLED_ROWS, seed: int = 1) -> DataFrame:
    """The labelled table that comes with the operator."""
    return spark.createDataFrame(examples(rows, seed), LABELLED)
