"""Pairs of texts are verified without storing or shuffling their shingles."""

import random

from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from passagework.llm import simhash
from passagework.session import materialize
from tests.llm.conftest import documents


def jaccard(x, y, shingle=5):
    one, two = ({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} for w in (x.split(), y.split()))
    return len(one & two) / len(one | two)


def test_texts_travel_instead_of_sets_and_heads_are_copied(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = [" ".join(base)]
    for cut in range(1, 40):
        texts.append(" ".join(base[:-cut] + [f"x{cut}y{i}" for i in range(cut)]))
    texts += [texts[5], texts[5].replace(" ", "\n"), "one"]
    stored = []

    def watched(df, label):
        if any(isinstance(f.dataType, ArrayType) for f in df.schema):
            stored.append(label)
        return materialize(df, label)

    monkeypatch.setattr(simhash, "MEMBERS", 4, raising=False)
    rows = simhash._with_word_prints(documents(spark, texts), "text", 1)
    rows = materialize(rows.withColumns({"at": F.monotonically_increasing_id(), "bytes": F.octet_length("row.text").cast("long")}), "rows")
    named = {r.whole: r.row.text for r in rows.collect()}
    pairs = [(a, b) for a in sorted(named) for b in sorted(named) if a < b]
    monkeypatch.setattr(simhash, "materialize", watched)
    found = simhash.verified(rows, spark.createDataFrame(pairs, "a long, b long"), "text", 5, 0.8)
    got = sorted((r.a, r.b) for r in found.collect())
    assert got == [(a, b) for a, b in pairs if jaccard(named[a], named[b]) >= 0.8] and got
    assert not stored


def test_the_sample_for_common_shingles_grows_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SAMPLE_TEXTS", 10)
    texts = [" ".join(f"t{i}w{j}" for j in range(20)) + (" one passage that many of these texts hold" if i % 3 == 0 else "") for i in range(600)]
    rows = materialize(simhash._with_word_prints(documents(spark, texts), "text", 1), "rows")
    # A third of the texts holds it: about 33 of the 100 texts of the sample; with a sample of 10 texts it was not common.
    assert len(simhash._common(rows, "text", 5)) >= 4
