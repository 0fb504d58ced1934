"""Centroid clustering and the ranked lexical search against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from passagework.llm import clustering, lexical_search
from tests.llm.conftest import CLASHING, LONG, documents


def clusters_by_hand(rows, k, rounds, dimension, scale):
    kept = [
        (i, [math.floor(scale * x) for x in v])
        for i, v in rows
        if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) and abs(scale * x) < 1 << 26 for x in v)
    ]
    hashed = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in hashed[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            members = [v for (_, v), o in zip(kept, own) if o == j]
            if members:
                centroids[j] = [sum(x) // len(members) for x in zip(*members)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    per = Counter()
    for _, j, d in found:
        per[j] += d
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, j, d, per[j], sum(per.values()), digests[j]) for i, j, d in found)


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.withColumns({c: F.lit("other") for c in [*CLASHING, "block", "ids", "vectors", "clusters", "v", "x"]})


def as_floats(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


def test_clusters_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (5, 6))
    rows = [(i, (centres[i % 5] + rng.normal(0, 0.4, 6)).tolist()) for i in range(400)]
    rows += [(3, rows[3][1]), (3, [0.0] * 6), (None, rows[5][1]), (900, None), (901, []), (902, [1.0] * 5)]
    rows += [(903, [1.0, None, 0, 0, 0, 0]), (904, [math.nan] * 6), (905, [math.inf] * 6), (906, [1e30] * 6), (907, [0.0] * 6), (908, [0.0] * 6)]
    rows = as_floats(rows)
    monkeypatch.setattr(clustering, "BLOCK_ROWS", 37)
    monkeypatch.setattr(clustering, "BUCKET_BYTES", 2_000)
    for k, rounds in ((8, 10), (1, 2), (3, 0)):
        found = clustering.cluster(vectors(spark, rows), k, rounds, dimension=6)
        assert Counter(tuple(r) for r in found.collect()) == clusters_by_hand(rows, k, rounds, 6, 1024)
    few = as_floats([(1, [0, 0, 0, 0, 0, 1]), (1, [0, 0, 0, 0, 0, 1]), (2, [5, 0, 0, 0, 0, 0])])
    found = clustering.cluster(vectors(spark, few), dimension=6)
    assert Counter(tuple(r) for r in found.collect()) == clusters_by_hand(few, 8, 10, 6, 1024)
    nothing = clustering.cluster(vectors(spark, rows).limit(0), dimension=6)
    assert nothing.collect() == [] and nothing.columns == found.columns
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("passagework_")]


def test_a_sphere_loosens_less_than_the_drift_and_never_too_little():
    rng = np.random.default_rng(6)
    saved = 0
    for _ in range(60):
        old = rng.normal(0, 10, (6, 5))
        new = old + rng.normal(0, rng.choice([0.01, 1, 8]), (6, 5))
        new[0] = old[0]
        radius = rng.uniform(0, 6, 6)
        loose = clustering.loosening(old, new, radius)
        drift = np.sqrt(((new - old) ** 2).sum(axis=1))
        for i in range(6):
            others = np.arange(6) != i
            step = rng.normal(0, 1, (400, 5))
            x = old[i] + step / np.sqrt((step**2).sum(axis=1))[:, None] * radius[i]
            nearer = np.sqrt(((x[:, None] - old[others]) ** 2).sum(axis=2)) - np.sqrt(((x[:, None] - new[others]) ** 2).sum(axis=2))
            assert nearer.max() <= loose[i] <= drift[others].max() * (1 + 1e-6)
            saved += loose[i] < 0.9 * drift[others].max()
    assert saved > 100


def test_bounds_spare_most_vectors_a_scan():
    rng = np.random.default_rng(7)
    centres = rng.integers(-4000, 4000, (8, 16))
    points = np.repeat(centres, 200, axis=0) + rng.integers(-300, 300, (1600, 16))
    centroids = centres + 20
    held = clustering.first_bounds(points, centroids)
    assert (held[0] == clustering.squares(points, centroids).argmin(axis=1)).all()
    moved = np.array([points[held[0] == j].mean(axis=0) for j in range(8)]).astype(np.int64)
    radius = np.array([held[1][held[0] == j].max() for j in range(8)], dtype=float)
    drift = np.sqrt(((moved - centroids) ** 2.0).sum(axis=1))
    loose = clustering.loosening(centroids.astype(float), moved.astype(float), radius)
    after = clustering.tightened(points, held, moved, drift, loose, clustering.half_gaps(moved))
    assert (after[0] == clustering.squares(points, moved).argmin(axis=1)).all() and after[3] < 160


def terms_of(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def ranked_by_hand(docs, items, k):
    bags = [(i, Counter(terms_of(t)), len(terms_of(t))) for i, t in docs]
    bags = [b for b in bags if b[2]]
    total, n_docs = sum(b[2] for b in bags), len(bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = Counter()
    for item, text in items:
        scored = []
        for i, bag, n in bags:
            m = 100 - 25 + (25 * n * n_docs) // total
            score = 0
            for t in terms_of(text):
                if t in bag:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * bag[t]) // (1000 * bag[t] + 12 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        for place, (score, _, _, i) in enumerate(sorted(scored)[:k], 1):
            out[item, place, i, -score] += 1
    return out


def test_lexical_search_equals_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)] + ["Über", "naïve", "東京", "x1", "ÄB", "co"]
    texts = [" ".join(rng.choices(words, range(1, 67), k=rng.randint(1, 40))) for _ in range(200)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, texts[6]), (None, texts[6]), (300, None), (301, ""), (302, " ,;\x00 ")]
    docs += [(303, "w1-w2_w3 W4\x7fco.Co"), (304, "w1 " * 3000 + "東京")]
    items = [(i, " ".join(rng.sample(words, 6))) for i in range(12)] + [(3, "w59 W59"), (None, "co x1"), (50, None), (51, "..."), (52, "unheard")]
    doc_table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("other") for c in [*CLASHING, "n", "terms", "rank", "item_id"]})
    item_table = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in ["term", "number", "times", "doc_id"]})
    wanted = ranked_by_hand(docs, items, 20)
    found = lexical_search.rank(doc_table, item_table)
    assert Counter(tuple(r) for r in found.collect()) == wanted
    monkeypatch.setattr(lexical_search, "PIECE", 50)
    monkeypatch.setattr(lexical_search, "CELLS", 40)
    found = lexical_search.rank(doc_table, item_table, term_limit=300)
    assert Counter(tuple(r) for r in found.collect()) == wanted
    assert found.columns == ["item_id", "rank", "doc_id", "score"]


def test_lexical_search_of_odd_tables(spark, odd, nothing):
    items = documents(spark, ["lorem", "words of them", None]).withColumnRenamed("doc_id", "item_id")
    found = lexical_search.rank(odd, items).collect()
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in found) == ranked_by_hand(rows, [(0, "lorem"), (1, "words of them")], 20)
    assert LONG in [t for _, t in rows]
    assert lexical_search.rank(nothing, items).collect() == [] and lexical_search.rank(odd, items.limit(0)).collect() == []
