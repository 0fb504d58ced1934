"""Quality rules, token counts, licence scan, BPE and language identification."""

import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from passagework.llm import bpe, language_id, license_scan, quality_rules, token_counts
from tests.llm.conftest import LONG, documents

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")


def counted(text):
    """The base counts of one text, one step at a time."""
    words = text.split()
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    marked = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
    seen, again = set(), 0
    lines = [x for x in text.split(b"\n") if x.split()]
    for line in lines:
        again += line in seen
        seen.add(line)
    chars = sum(len(w.decode()) for w in words)
    symbols = sum(c in b"#*$%&|<>" for c in text)
    return [len(words), chars, symbols, again, len(marked), len(lines)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é#|\n\t東", max_size=60), min_size=1, max_size=8))
def test_quality_counts(texts):
    raw = [t.encode() for t in texts]
    found = quality_rules.text_stats(raw)
    assert [list(map(int, x)) for x in zip(*found.values())] == [counted(t) for t in raw]


def test_sketch_buckets_hold_their_values(spark):
    from pyspark.sql import functions as F

    df = spark.range(0, 5000).select("id", quality_rules.bucket(F.col("id")).alias("b"))
    rows = df.select("id", "b", quality_rules.upper_edge(F.col("b")).alias("top")).orderBy("id").collect()
    assert all(r.id <= r.top <= max(r.id * 17 / 16, r.id) for r in rows)
    assert [r.b for r in rows] == sorted(r.b for r in rows)


def test_limits_follow_the_group(spark):
    rng = random.Random(1)
    clean = [" ".join(f"{rng.choice('abcdef')}{rng.randint(0, 999)}" for _ in range(60)) for _ in range(600)]
    dirty = [t.replace(" ", " *** $$$ ") for t in clean[:20]]
    listed = [t.replace(" ", " # ") + " x" for t in clean[:300]]
    rows = [(i, t, "en", "plain") for i, t in enumerate(clean + dirty)]
    rows += [(10_000 + i, t, "en", "listed") for i, t in enumerate(listed)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality_rules.keep_good(docs, "lang", "source").collect()}
    assert kept >= set(range(600)) and not kept & set(range(600, 620))
    # A source in which every document has many signs is judged by its own distribution.
    assert kept >= set(range(10_000, 10_300))


def test_limits_come_from_the_sketch_alone(spark):
    """One document is ordinary in a source with such documents and far out in one without, at rates of every height."""
    rng = random.Random(3)
    plain = [" ".join(f"{rng.choice('abcdef')}{rng.randint(0, 999)}" for _ in range(60)) for _ in range(300)]
    # A sign beside every tenth word: some 25 of 1,000 characters. One text of long words.
    signs = [" ".join(w + " #" * (i % 10 == 0) for i, w in enumerate(t.split())) for t in plain]
    long = " ".join("abcdefg" for _ in range(2)) + " " + " ".join(f"long{i:04d}" for i in range(58))
    rows = [(i, t, "en", "plain") for i, t in enumerate([*plain, signs[0], long])]
    rows += [(1000 + i, t, "en", "signs") for i, t in enumerate(signs)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality_rules.keep_good(docs, "lang", "source").collect()}
    assert kept == {*range(300), *range(1000, 1300)}


def test_quality_of_odd_tables(odd, nothing):
    kept = quality_rules.keep_good(odd, "lang", "source")
    assert kept.columns == odd.columns and kept.dtypes == odd.dtypes
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["5", "5", "6", "7", "None"]
    assert quality_rules.keep_good(nothing, "lang", "source").collect() == []
    stats = quality_rules.with_stats(odd, ["doc_id"], "lang", "source").filter("row.doc_id = 4").first()
    assert (stats.n_words, stats.n_repeat_words) == (120_000, 120_000)


ODD_TEXTS = [
    ":\U0003d000 a\u1c89 \ua7ceX",
    "", " ", "\n\n x", "end\n", " lead", "a  b   c \n\n d", "it's 's' don't I'LL", "Ünï 1234 x́é́",
    "<|endoftext|>abc <|startoftext|> x<|endoftext|>", "ΟΔΟΣ İstanbul ﬁ ẞ", "ab\x1cde f　g\t\n\r h",
    "日本語テキスト 한국어 กำ", "😀😀 ok", "a​b \x00a\x00", "x" * 700, "१२३ ²³ Ⅷ", "aé é\nö ü\tx",
]


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def test_token_counts_equal_the_library(spark):
    docs = documents(spark, [*ODD_TEXTS, None])
    tokenizer = library(BYTE)
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, BYTE).collect()}
    for i, text in enumerate([*ODD_TEXTS, ""]):
        assert got[i] == (len(text.encode()), len(tokenizer.encode(text, add_special_tokens=False).ids)), text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1.'é \n\t <|東ö"), max_size=80))
def test_safe_boundaries_change_no_count(text):
    assert token_counts.lengths(BYTE, [text])[0] == len(library_of(BYTE).encode(text, add_special_tokens=False).ids)


_kept = {}


def library_of(path):
    if path not in _kept:
        _kept[path] = library(path)
    return _kept[path]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="abcdeé 'S1\n", max_size=200))
def test_bpe_equals_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    ids, decoded, n = bpe.vocabulary(WORD).encode(text)
    wanted = library_of(WORD).encode(text, add_special_tokens=False).ids
    assert list(struct.unpack(f"<{n}I", ids)) == wanted
    assert decoded == library_of(WORD).decode(wanted, skip_special_tokens=False)


def test_bpe_over_tables(spark, odd, nothing):
    docs = documents(spark, [*ODD_TEXTS, None])
    encoded = bpe.encode_texts(docs, WORD)
    for r in encoded.collect():
        text = ([*ODD_TEXTS, ""])[r.doc_id]
        assert list(struct.unpack(f"<{r.n_tokens}I", r.ids)) == library_of(WORD).encode(text, add_special_tokens=False).ids
        assert r.decoded == library_of(WORD).decode([i for (i,) in struct.iter_unpack("<I", r.ids)], skip_special_tokens=False)
    again = {r.doc_id: r.decoded for r in bpe.decode_ids(encoded, WORD).collect()}
    assert again == {r.doc_id: r.decoded for r in encoded.collect()}
    assert bpe.encode_texts(odd, WORD).count() == odd.count() and bpe.encode_texts(nothing, WORD).collect() == []


def test_long_words_merge_alike():
    vocabulary = bpe.WordBpe(WORD)
    word = "antidisestablishmentarianism" * 9
    letters = "".join(word)
    parts = [*letters[:-1], letters[-1] + vocabulary.end]
    slow = vocabulary._merge_long(parts)
    bpe_long, bpe.LONG = bpe.LONG, 10_000
    try:
        assert vocabulary.merge(letters) == slow
    finally:
        bpe.LONG = bpe_long


def test_license_places_by_hand(spark):
    texts = [
        "Released under the MIT License. mit-license; MIT  license",
        "Apache License, General Public License and the GNU Affero general PUBLIC license",
        "submit license. mit licenses; MITé license apachelicense",
        "Redistribution and use in source and binary forms, with or without changes are permitted",
        "Licensed under CC BY-NC 4.0.",
        None,
        "Permission is hereby granted, free of charge, to any person obtaining one copy",
    ]
    rows = license_scan.scan(documents(spark, texts)).orderBy("doc_id").collect()
    assert [(r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows[:3]] == [
        (3, 3, 7, "mit"), (3, 0, 9, "apache,gpl"), (0, None, None, "")]
    assert rows[1].labels == "agpl,apache,gpl"
    assert rows[3].labels == "bsd" and 0.75 <= rows[3].score < 1
    assert rows[4].labels == "cc-by-nc" and rows[4].score == 1.0
    assert (rows[5].n_words, rows[5].labels, rows[5].score) == (0, "", 0.0)
    assert rows[6].labels == "mit-grant"


def test_license_scan_equals_brute_force(spark):
    rng = random.Random(4)
    vocabulary = "mit apache general public license gnu version 3 the x licensed under 2 0".split()
    texts = ["".join(rng.choice([" ", ", ", "-"]) + rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    rows = license_scan.scan(documents(spark, texts)).collect()
    for r in rows:
        words = [w for w in "".join(c if c.isalnum() else " " for c in texts[r.doc_id]).split() if w]
        hits = []
        for label, phrase in license_scan.BASE.items():
            p = phrase.split()
            hits += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
        assert r.n_words == len(words) and r.n_base == len(hits)
        assert (r.first_word, r.last_word) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert r.base_labels == ",".join(sorted({x[1] for x in hits}))


def test_license_scan_of_odd_tables(odd, nothing):
    assert license_scan.scan(odd).count() == odd.count()
    assert license_scan.scan(nothing).collect() == []


def sentences(letters, n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(150)]
    return [" ".join(rng.choice(words) for _ in range(40)) for _ in range(n)]


def test_languages_are_told_apart(spark):
    from pyspark.sql import functions as F

    texts = {"aa": sentences("abcdeimno", 80, 1), "bb": sentences("eiklmnoprst", 80, 2), "cc": sentences("éèaoklpdu", 80, 3)}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, many in texts.items() for t in many)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = language_id.train(docs, where=F.col("doc_id") % 2 == 0)
    found = language_id.predict(docs, models, ["doc_id", "lang"]).select("row.*", "lang_pred", "score", "rejected").collect()
    assert np.mean([r.lang == r.lang_pred for r in found if r.doc_id % 2]) > 0.97
    assert not any(r.rejected for r in found) and all(0 <= r.score <= 1 for r in found)
    strange = documents(spark, ["qzx wvj qqz jjw zxv" * 10, "12 34 !", None, ""])
    rows = language_id.predict(strange, models, ["doc_id"]).orderBy("row.doc_id").collect()
    assert rows[0].rejected and [r.lang_pred for r in rows[1:]] == ["und"] * 3 and [r.score for r in rows[1:]] == [0.0] * 3


def test_probabilities_of_a_model_add_up():
    grams = {"x": ["abab", "baba", "abac", "bacb"], "y": ["cccc", "cccd"]}
    models = language_id.build(["x", "y"], grams, {"x": [5, 4, 2, 1], "y": [3, 1]})
    # The letters of each language, and one that it has never seen.
    for lang, letters in enumerate(("abc?", "cd?")):
        for context in ("aba", "bab", "zzz", "ccc", "ccd"):
            rows = [np.array([*map(ord, context + c)], dtype=np.uint32) for c in letters]
            logs = [models._at(r, np.array([3]), 4)[0][lang] for r in rows]
            assert abs(np.exp(logs).sum() - 1) < 1e-5


def test_language_of_odd_tables(odd, nothing):
    models = language_id.train(odd)
    found = language_id.predict(odd, models, ["doc_id"]).collect()
    assert len(found) == odd.count()
    assert all(r.lang_pred == "und" for r in found if r.row.doc_id in (1, 2, 3))
    assert language_id.train(nothing) is None
    assert {r.lang_pred for r in language_id.predict(odd, None, ["doc_id"]).collect()} == {"und"}
    assert language_id.keep_identified(nothing).collect() == []
    assert LONG.strip()
