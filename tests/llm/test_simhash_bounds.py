"""Pairs that cannot be similar are left out before any text is read; copies are worked on once."""

import random

import numpy as np
from pyspark.sql import functions as F

from passagework.llm import components, simhash
from passagework.session import materialize
from tests.llm.conftest import documents
from tests.llm.test_simhash_verified import jaccard


def test_parities_differ_in_no_more_bits_than_shingles():
    rng = np.random.default_rng(5)
    for _ in range(300):
        one = np.unique(rng.integers(0, 1 << 62, rng.integers(0, 400)))
        kept = one[rng.random(len(one)) < rng.choice([0.1, 0.8, 1.0])]
        two = np.unique(np.concatenate([kept, rng.integers(0, 1 << 62, rng.integers(0, 300))]))
        (differ,) = simhash.odd_bits([simhash.parities(one)], [simhash.parities(two)])
        assert differ <= len(np.setxor1d(one, two))
    same = simhash.parities(one)
    assert simhash.odd_bits([same, same], [same, simhash.parities(two)]).tolist() == [0, differ]


def test_pairs_with_one_passage_in_common_are_not_compared(spark, monkeypatch):
    """Texts that share a passage, so that its shingles are in all prefixes, and some real copies."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for _ in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(150, 300))]
        texts.append(" ".join(base[:70] + passage + base[70:]))
    texts += [t.rsplit(" ", 8)[0] for t in texts[:5]]
    sent = []

    def watched(rows, pairs, *rest):
        pairs = materialize(pairs, "watched")
        sent.extend((r.a, r.b) for r in pairs.collect())
        return verified(rows, pairs, *rest)

    verified = simhash.verified
    rows = simhash._with_word_prints(documents(spark, texts), "text", 1)
    rows = materialize(rows.withColumns({"at": F.monotonically_increasing_id(), "bytes": F.octet_length("row.text").cast("long")}), "rows")
    monkeypatch.setattr(simhash, "verified", watched)
    none = spark.createDataFrame([], "a long, b long")
    found = {(r.a, r.b) for r in simhash.all_links(rows, "text", 5, 0.8, none).collect()}
    named = {r.whole: r.row.text for r in rows.collect()}
    assert found == {(a, b) for a in named for b in named if a < b and jaccard(named[a], named[b]) >= 0.8} and len(found) == 5
    assert len(set(sent)) < 20


def test_a_text_is_worked_on_once_however_often_it_occurs(spark):
    rows = simhash._with_word_prints(documents(spark, ["a b c", "d e f g"] * 90 + ["A  b c", ""]).repartition(3), "text", 1)
    rows = materialize(rows.withColumns({"at": F.monotonically_increasing_id(), "bytes": F.lit(1)}), "rows")
    assert sorted(r.row.text.lower().split() for r in simhash.one_each(rows).collect()) == [[], ["a", "b", "c"], ["d", "e", "f", "g"]]


def test_links_that_point_at_their_smallest_need_no_round(spark, monkeypatch):
    made = []

    def watched(df, label):
        made.append(label)
        return materialize(df, label)

    monkeypatch.setattr(components, "materialize", watched)
    stars = spark.createDataFrame([(1, 5), (1, 7), (2, 9)], "a long, b long")
    assert sorted(components.smallest_reachable(stars, "a", "b").collect()) == [(1, 1), (2, 2), (5, 1), (7, 1), (9, 2)]
    assert made == ["links"]
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.root for r in components.smallest_reachable(chain, "a", "b").collect()} == {0}
