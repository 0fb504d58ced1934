"""Personal data: base patterns against the plain expressions, the field against held-out rows and by enumeration."""

import hashlib
import itertools
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from passagework.llm import crf, personal_data
from passagework.llm.personal_data import KINDS
from tests.llm.conftest import LONG, documents


@pytest.fixture(scope="module")
def model(spark):
    return personal_data.train(personal_data.labelled_table(spark))


def base_by_hand(text):
    """The patterns as they are stated, without anything that makes them fast."""
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = digits(m.group())
        total = sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(digits(m.group())) <= 15:
            found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(3)
    pieces = ["@", "a", "b.c", "+1", "1", "12", "255", "256", ".", "-", " ", "(", ")", "4111111111111111", "4111 1111-1111 1111", "x@y.z", "+", "0", "é", "%", "\n", "🙂"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 30))) for _ in range(4000)]
    texts += ["+1.2.3.4.5.6.7.8.9", "0001.0255.00.0", "a@b@c.d@e.f.g", "@a.b", "a.@-.-.", "1.2.3.4.5.6.7.8", "+1 (826) 555-4081 190.137.223.204", "999999999999999999999.1.1.1"]
    for text in texts:
        assert personal_data.base_spans(text) == base_by_hand(text), text
    for hard in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" + "." * 300_000, "a@" * 150_000, "1 " * 150_000):
        began = time.perf_counter()
        personal_data.base_spans(hard)
        personal_data.stretches(hard)
        assert time.perf_counter() - began < 5


def test_viterbi_and_likelihood_equal_enumeration():
    rng = np.random.default_rng(1)
    moves = rng.normal(0, 1, (4, 3))
    rows = rng.normal(0, 1, (6, 2 * crf.REACH + 1, 3))
    kinds = [rng.integers(1, 6, n) for n in (5, 4, 4, 2, 1, 1)]
    gold = [rng.integers(0, 3, len(k)) for k in kinds]

    def score(k, labels, rows=rows, moves=moves):
        around = np.concatenate([[0] * crf.REACH, k, [0] * crf.REACH])
        total = moves[-1, labels[0]] + sum(moves[a, b] for a, b in zip(labels, labels[1:]))
        return total + sum(rows[around[t + p], p, labels[t]] for t in range(len(k)) for p in range(2 * crf.REACH + 1))

    best = crf.viterbi(kinds, rows, 0, moves)
    for k, found in zip(kinds, best):
        assert tuple(found) == max(itertools.product(range(3), repeat=len(k)), key=lambda x: score(k, x))

    def whole(rows, moves):
        return sum(
            score(k, list(g), rows, moves) - np.log(sum(np.exp(score(k, x, rows, moves)) for x in itertools.product(range(3), repeat=len(k))))
            for k, g in zip(kinds, gold)
        )

    value, row_slope, move_slope = crf.likelihood(kinds, gold, rows, 0, moves)
    assert np.isclose(value, whole(rows, moves))
    for place in [(1, 2, 0), (0, 0, 1), (5, 4, 2)]:
        moved = rows.copy()
        moved[place] += 1e-5
        assert np.isclose((whole(moved, moves) - value) / 1e-5, row_slope[place], atol=1e-3)
    for place in [(0, 1), (3, 2)]:
        moved = moves.copy()
        moved[place] += 1e-5
        assert np.isclose((whole(rows, moved) - value) / 1e-5, move_slope[place], atol=1e-3)


def test_held_out_rows(model):
    """Rows of another seed: what base patterns and field find together."""
    rows = personal_data.examples(400, seed=2)
    assert not {t for t, _ in rows} & {t for t, _ in personal_data.examples()}
    found = personal_data.spans_of([t for t, _ in rows], model)
    right = sum(len({s[:3] for s in got} & set(spans)) for got, (_, spans) in zip(found, rows))
    assert right / sum(len(s) for _, s in rows) > 0.9 and right / sum(map(len, found)) > 0.95
    beyond = sum(not s[3] and s[:3] in spans for got, (_, spans) in zip(found, rows) for s in got)
    assert beyond > 60


def test_added_spans_are_possible_and_apart(model):
    text = "Write to jane.doe (at) example (dot) org or call (555) 123-4567 on 2024-01-15, card 4111.1111.1111.1111, token 16 digits 4111111111111112."
    found = [(k, text[s:e], base) for k, s, e, base in personal_data.spans_of([text], model)[0]]
    assert ("email", "jane.doe (at) example (dot) org", False) in found and ("phone", "(555) 123-4567", False) in found
    assert ("card", "4111.1111.1111.1111", False) in found and not any("2024" in t or "1112" in t for _, t, _ in found)
    # Base takes phone and address for one number of too many digits; the field tells them apart.
    text = "Ring +1 (826) 555-4081 190.137.223.204 now"
    assert [(k, b) for k, _, _, b in personal_data.spans_of([text], model)[0]] == [("phone", False), ("ip", True)]
    assert personal_data.spans_of(["", "plain words at home, 3 of them, version 2.0."], model) == [[], []]


def test_report_and_redaction(spark, odd, nothing, model):
    docs = documents(spark, ["Mail a.b@c.de, 10.0.0.1 or +49 (030) 123-456.", None, "", "4111 1111 1111 1111 é x@y.zz 300.1.1.1", LONG])
    found = personal_data.find(docs, ["doc_id"], model).select("row.doc_id", *personal_data.digests()).orderBy("doc_id").collect()
    for r, d in zip(found, docs.orderBy("doc_id").collect()):
        base = base_by_hand(d.text)
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        kinds = Counter(k for k, _, _ in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in KINDS)
        assert set(said.split(",")) <= set(r.spans.split(","))
    clean = {r.row.doc_id: r.redacted for r in personal_data.redact(docs, ["doc_id"], model).collect()}
    assert clean[0] == "Mail [EMAIL], [IP] or [PHONE]." and clean[1] is None and clean[2] == "" and clean[4] == LONG
    assert personal_data.replaced("abcdef", [("ip", 1, 4, True), ("card", 2, 5, True)]) == "a[IP]f"
    every = personal_data.find(odd, odd.columns, model)
    assert every.count() == odd.count() and every.filter("row.doc_id is null").count() == 2
    assert personal_data.find(nothing, ["text", "spans"][:1], model).collect() == []


def test_what_teaches_nothing(spark):
    rows = [(None, []), ("no spans", None), ("none of these kinds", [("name", 0, 4)]), ("", [])]
    model = personal_data.train(spark.createDataFrame(rows, personal_data.LABELLED), turns=3)
    assert personal_data.spans_of(["x@y.zz (555) 123-4567"], model) == [[("email", 0, 6, True)]]
    empty = personal_data.train(spark.createDataFrame([], personal_data.LABELLED))
    assert personal_data.spans_of(["x@y.zz 10.0.0.1"], empty) == [[("email", 0, 6, True), ("ip", 7, 15, True)]]
