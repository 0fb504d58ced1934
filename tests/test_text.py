import hashlib
import uuid
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from passagework.functions import ids, markup, text, vectors

SAMPLES = [
    "red \t fox\r\n\r\n\r\n\r\n  den \u2028burrow  ",
    "Zwölf Boxkämpfer_7 jagen\xa0東 \u2003 weit\x0büber\x85Sylt",
    "\t \x0c ",
    "",
    "Is it? Yes!  No. e.g.3\n\n\nNew part",
    "q" * 40 + "!\n Z\n\n\nw. ",
    "split\x1chere\x1ftoo ³ Ⅳ",
    "Red red RED fox",
]
# What each function gives for each sample, written out.
NORMALIZED = [
    "red fox\n\nden\nburrow",
    "Zwölf Boxkämpfer_7 jagen 東 weit\nüber\nSylt",
    "",
    "",
    "Is it? Yes! No. e.g.3\n\nNew part",
    "q" * 40 + "!\nZ\n\nw.",
    "split\nhere too ³ Ⅳ",
    "Red red RED fox",
]
HASHED = [
    "red fox den burrow",
    "zwölf boxkämpfer_7 jagen 東 weit über sylt",
    "",
    "",
    "is it? yes! no. e.g.3 new part",
    "q" * 40 + "! z w.",
    "split here too ³ ⅳ",
    "red red red fox",
]
TOKENS = [
    ["red", "fox", "den", "burrow"],
    ["zwölf", "boxkämpfer_7", "jagen", "東", "weit", "über", "sylt"],
    [],
    [],
    ["is", "it", "yes", "no", "e", "g", "3", "new", "part"],
    ["q" * 40, "z", "w"],
    ["split", "here", "too", "³", "ⅳ"],
    ["red", "red", "red", "fox"],
]
SENTENCES = [
    ["red \t fox\r\n\r\n\r\n\r\n  den \u2028burrow"],
    ["Zwölf Boxkämpfer_7 jagen\xa0東 \u2003 weit\x0büber\x85Sylt"],
    [],
    [],
    ["Is it?", "Yes!", "No.", "e.g.3", "New part"],
    ["q" * 40 + "!", "Z", "w."],
    ["split\x1chere\x1ftoo ³ Ⅳ"],
    ["Red red RED fox"],
]


def column(spark, expression):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "id int, text string")
    return [r[0] for r in df.orderBy("id").select(expression(F.col("text")).alias("x")).collect()]


def test_normalize_text(spark):
    assert column(spark, text.normalize_text) == NORMALIZED


def test_content_hash(spark):
    assert column(spark, text.content_hash) == [hashlib.sha256(s.encode()).hexdigest() for s in HASHED]


def test_tokenize(spark):
    assert column(spark, text.tokenize) == TOKENS


def test_sentences(spark):
    assert column(spark, text.split_sentences) == SENTENCES


def test_term_counts(spark):
    assert column(spark, lambda c: text.term_counts(text.tokenize(c))) == [dict(Counter(words)) for words in TOKENS]


def test_fixed_chunks_cover_the_text(spark):
    parts = column(spark, lambda c: text.fixed_chunks(c, 10, 3))
    for sample, windows in zip(SAMPLES, parts):
        assert "".join(w if not i else w[3:] for i, w in enumerate(windows)) == sample
        assert all(len(w) <= 10 for w in windows)


def test_uuid5_equals_python(spark):
    assert column(spark, ids.uuid5) == [str(uuid.uuid5(uuid.NAMESPACE_URL, s)) for s in SAMPLES]


def test_cache_key(spark):
    keys = column(spark, lambda c: ids.cache_key("m", c))
    assert keys[7] == "emb:" + hashlib.sha256(b"m:Red red RED fox").hexdigest()


def test_words_are_the_tokens(spark):
    assert column(spark, text.words) == [" ".join(words) for words in TOKENS]
    rows = spark.createDataFrame([("\u0130x'\u03a3 a\u03a3.",)], "t string").select(text.tokenize(F.col("t")).alias("a"), text.words(F.col("t")).alias("b"))
    assert rows.first().b == " ".join(rows.first().a)


def test_word_lists_of_slices():
    strings = pa.array(["x", "a b", "", None, "c"])
    assert vectors.word_lists(strings.slice(1)).to_pylist() == [["a", "b"], None, None, ["c"]]
    assert vectors.word_lists(strings.slice(4)).to_pylist() == [["c"]]


def test_hash_embed(spark):
    got = column(spark, lambda c: vectors.hash_embed(text.tokenize(c), 16))
    for words, vector in zip(TOKENS, got):
        wanted = [0.0] * 16
        for word in words:
            wanted[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % 16] += 1
        assert vector == wanted


def texts_of(spark, expression, values):
    df = spark.createDataFrame(list(enumerate(values)), "id int, t string")
    return [r[0] for r in df.orderBy("id").select(expression(F.col("t"))).collect()]


def test_html_to_text(spark):
    pages = {
        "<main><script src=q>let a = 1 < 2;</script><h2>Tide tables</h2></main>": "Tide tables",
        "<section><noscript>turn <i>it</i> on</noscript></section>low<!-- note -->high &amp; dry<hr>end": "low\nhigh & dry\nend",
        "<style>b{}</style><p>one<p>two": "one\ntwo",
        "price a < b & c > d": "price a < b & c > d",
        "<p>x &lt; y <b>z</b></p>": "x < y\nz",
        "5 <6 and <7>": "5 <6 and <7>",
    }
    assert texts_of(spark, markup.html_to_text, list(pages)) == list(pages.values())


def test_markdown_marks_vanish(spark):
    cases = {
        "## Harbour\n\nA **very** old `quay()` by [the sea](http://x/y).\n\n* ropes\n2. nets": (
            "Harbour\n\nA very old quay() by the sea.\n\nropes\nnets"
        ),
        "x = a * b * c and 2 ** 3 ** 4": "x = a * b * c and 2 ** 3 ** 4",
        "```sh\n# keep me\necho *all* _of_ it\n```\nafter": "# keep me\necho *all* _of_ it\n\nafter",
        "`**raw** _x_` and **bold**": "**raw** _x_ and bold",
        "see ![alt text](p.png) here": "see here",
        "Title\n=====\nSub\n---\nbody": "Title\n\nSub\n\nbody",
        "_soft_ and snake_case_name and __strong__": "soft and snake_case_name and strong",
        "> quoted\n\n***\n\nend ##": "quoted\n\nend",
        "~~~\nopen fence # stays": "open fence # stays",
        "": "",
    }
    assert texts_of(spark, markup.strip_markdown, list(cases)) == list(cases.values())
    assert texts_of(spark, markup.strip_markdown, [None]) == [None]


def test_a_loaded_text_is_normalised_once(spark):
    from passagework.sources.files import load_documents

    files = spark.createDataFrame([("a.txt", b" x \r\n\r\n\r\n\r\n y "), ("b.txt", b" \n "), ("c.md", b"# t")], "filename string, content binary")
    good, bad = load_documents(files)
    for rows in (good.select("text"), bad.select("reason")):
        # One place for each of the three formats.
        assert rows._jdf.queryExecution().executedPlan().toString().count(r"\n{3,}") <= 3
    assert sorted(r.text for r in good.collect()) == ["t", "x\n\ny"]
    assert [r.reason for r in bad.collect()] == ["no text in text"]


def test_normalising_equals_lines_one_by_one(spark):
    import random
    import re

    draw = random.Random(3)
    letters = " \t\n\r\x0b\x0c\x1c\x1e\x1f\x85\xa0  　​ab."
    texts = ["".join(draw.choice(letters) for _ in range(draw.randrange(30))) for _ in range(2000)]
    found = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.normalize_text(F.col("t")).alias("n"), text.collapse(F.col("t")).alias("c"))
    for row in found.collect():
        lines = re.sub(r"\n{3,}", "\n\n", "\n".join(" ".join(line.split()) for line in texts[row.i].splitlines()))
        assert row.n == lines.strip() and row.c == " ".join(texts[row.i].split())
