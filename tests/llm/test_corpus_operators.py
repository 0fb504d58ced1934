"""SimHash groups, suffix-array removal, language model, packing and exact search."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from passagework.llm import exact_search, language_model, packing, simhash, suffix_dedup
from passagework.llm.anchors import segments
from passagework.llm.components import smallest_reachable
from passagework.llm.suffix_array import common_prefixes, suffix_array
from tests.llm.conftest import LONG, documents


def by_union(ids, linked):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids}


def test_components_of_paths_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 200)]
    edges += [(rng.randint(1000, 1300), rng.randint(1000, 1300)) for _ in range(180)]
    rng.shuffle(edges)
    found = {r.node: r.root for r in smallest_reachable(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    wanted = by_union(nodes, [e for e in edges if e[0] != e[1]])
    assert found == wanted
    assert smallest_reachable(spark.createDataFrame([], "x long, y long"), "x", "y").collect() == []


def print_by_hand(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark, odd):
    texts = ["", None, "one", "One two", "a b c", "a b c d e f g a b c d", "Ä ä\x0bb\x0cc d e", LONG]
    found = simhash.components(documents(spark, texts)).collect()
    assert {r.doc_id: r.fingerprint for r in found} == {i: f"{print_by_hand(t):016x}" for i, t in enumerate(texts)}
    assert simhash.components(odd).count() == odd.count()


def test_golay_indices_meet_at_one_bit():
    words = np.random.default_rng(5).integers(0, 1 << 23, 2000)
    own = simhash.codeword_indices(words)
    near, far = simhash.decoding()
    assert (near > 0).sum() == 2047 and set((far > 0).sum(axis=1)) == {0, 5}
    for bit in range(23):
        other = simhash.codeword_indices(words ^ (1 << bit))
        assert all(set(a[a >= 0]) & set(b[b >= 0]) for a, b in zip(own, other))


def test_links_equal_brute_force(spark):
    """Chains, a crowded bucket and lone words; once with small and once with large buckets."""
    rng = np.random.default_rng(8)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    words = [int(c) for c in centres]
    for c in words[:6]:
        for _ in range(40):
            c ^= 1 << int(rng.integers(64))
            if rng.random() < 0.5:
                c ^= 1 << int(rng.integers(64))
            words.append(c)
    words += [words[0] ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(0, 64, 5)]
    words = sorted({w - (1 << 64) if w >> 63 else w for w in words} | {0, -1, -2})
    as_unsigned = np.array(words, dtype=np.int64).view(np.uint64)
    near = [(i, j) for i in range(len(words)) for j in np.flatnonzero(np.bitwise_count(as_unsigned ^ as_unsigned[i]) <= 2) if i < j]
    wanted = by_union(range(len(words)), near)
    distinct = spark.createDataFrame([(0, w) for w in words], "view int, fp long")
    for small in (4, 64, 100_000):
        edges = [(r.a, r.b) for r in simhash.links(distinct, small).collect()]
        assert all((a ^ b).bit_count() <= 2 if (a ^ b) >= 0 else ((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in edges)
        place = {w: i for i, w in enumerate(words)}
        assert by_union(range(len(words)), [(place[a], place[b]) for a, b in edges]) == wanted


def test_one_document_of_each_group_stays(spark, odd, nothing):
    texts = ["the same words in one text"] * 50 + ["something else altogether here"] * 3 + [None, ""]
    docs = documents(spark, texts)
    assert sorted(r.doc_id for r in simhash.keep_first(docs).collect()) == [0, 50, 53]
    kept = simhash.keep_first(odd, shingle=5)
    assert kept.dtypes == odd.dtypes
    ids = Counter(r.doc_id for r in kept.collect())
    # Empty texts are one group, 5, its copy and 6 another; the text without an id stands alone.
    assert ids == {1: 1, 4: 1, 5: 1, 7: 1, None: 1}
    rng = random.Random(12)
    words = [f"word{i}" for i in range(3000)]
    base = [[rng.choice(words) for _ in range(300)] for _ in range(40)]
    edited = [[*b[:100], "changed", *b[101:200], "again", *b[201:]] for b in base]
    half = [b[:150] + [rng.choice(words) for _ in range(150)] for b in base]
    near = documents(spark, [" ".join(b) for b in base + edited + half])
    ids = {r.doc_id for r in simhash.keep_first(near).collect()}
    # Two words of 300 leave a similarity of 286 / 306; another half leaves about a third.
    assert len(ids & set(range(40, 80))) <= 2 and ids >= {*range(40), *range(80, 120)}
    assert simhash.keep_first(nothing).collect() == [] and simhash.components(nothing).collect() == []


def kept_by_hand(texts):
    """Ids that stay if every pair of texts is compared."""
    sets = []
    for words in (t.split() for t in texts):
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    near = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    return set(by_union(range(len(sets)), near).values())


def test_near_copies_of_every_kind_are_found(spark):
    """Blocks before, after and within a text, cut-off texts and scattered edits, at similarities on both sides of 0.8."""
    rng = random.Random(21)
    words = [f"word{i}" for i in range(2000)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    line = prose(12)
    texts = []
    for _ in range(25):
        base = prose(rng.randint(20, 300)) + line
        n = len(base)
        for share in (0.05, 0.1, 0.15, 0.19, 0.25):
            k = int(n * share)
            at = rng.randrange(n)
            edited = [rng.choice(words) if rng.random() < share / 5 else w for w in base]
            texts += [base, base + prose(k), prose(k) + base, base[:at] + prose(k) + base[at:], base[: n - k], base[k:], edited]
    texts = [" ".join(t) for t in texts]
    order = list(range(len(texts)))
    rng.shuffle(order)
    texts = [texts[i] for i in order]
    assert {r.doc_id for r in simhash.keep_first(documents(spark, texts)).collect()} == kept_by_hand(texts)


def test_copies_of_one_text_that_are_unlike_each_other(spark, monkeypatch):
    """Crowds of copies that only their original is similar to, in buckets of any size; and copies of copies."""
    rng = random.Random(33)
    words = [f"word{i}" for i in range(5000)]
    texts = []
    for n in (70, 130):
        base = [rng.choice(words) for _ in range(300)]
        copies = []
        for _ in range(n):
            places = set(rng.sample(range(10, 290), 4))
            copies.append([rng.choice(words) if i in places else w for i, w in enumerate(base)])
        copies += [[rng.choice(words) if i % 75 == 7 else w for i, w in enumerate(c)] for c in copies[:10]]
        texts += [" ".join(t) for t in [*copies, base]]
    rng.shuffle(texts)
    wanted = kept_by_hand(texts)
    for pairs in (4, 0):
        monkeypatch.setattr(simhash, "PAIRS_A_ROW", pairs)
        assert {r.doc_id for r in simhash.keep_first(documents(spark, texts)).collect()} == wanted


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for _ in range(150):
        text = np.concatenate([rng.integers(1, rng.integers(2, 6), rng.integers(1, 70)), [0]])
        plain = text.tolist()
        wanted = sorted(range(len(plain)), key=lambda i: plain[i:])
        assert suffix_array(text).tolist() == wanted
        shared = common_prefixes(text, np.array(wanted), 9)
        for x, y in zip(wanted, wanted[1:]):
            n = 0
            while max(x, y) + n < len(plain) and plain[x + n] == plain[y + n]:
                n += 1
            assert shared[y] == min(n, 9)


def test_equal_windows_have_equal_anchors():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc ") for _ in range(400)).encode() for _ in range(6)]
    texts += [b"xx" + texts[0][100:300] + b"yy", b"a" * 200, b"a" * 90, b"", b"short"]
    found = segments(texts, 50, 16)
    of_window, of_content, sides = {}, {}, {}
    for owner, first, windows, anchor, content in zip(*vars(found).values()):
        data = texts[owner][first : first + windows - 1 + 50]
        assert of_content.setdefault(data, (anchor, content)) == (anchor, content)
        for w in range(windows):
            key = texts[owner][first + w : first + w + 50]
            assert of_window.setdefault(key, anchor) == anchor
            sides.setdefault(key, []).append((int(content) >> 16 & 0xFFFF, int(content) & 0xFFFF))
    # Segments that share a window agree on one side, and have that side.
    assert all(any(a and a == b for a, b in zip(x, y)) for found in sides.values() for x in found for y in found)
    assert sum(x for x in segments(texts, 50, 16).windows) == sum(max(0, len(t) - 49) for t in texts)


def removed_by_hand(rows):
    first = {}
    for d, t in rows:
        for i in range(len(t) - 49):
            first[t[i : i + 50]] = min(first.get(t[i : i + 50], d), d)
    out = {}
    for d, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(t)))
        rest = bytes(c for c, g in zip(t, gone) if not g)
        out[d] = (len(t), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    return out


def passages(seed):
    rng = random.Random(seed)
    base = "".join(rng.choice("ab") for _ in range(2000)) + "é" * 200 + "a" * 300
    piece = lambda most: base[(at := rng.randrange(len(base))) : at + rng.randrange(most)]
    rows = [(i, piece(300) + rng.choice(["", "zz", "é"]) + piece(200)) for i in range(-20, 90)]
    return rows + [(500, None), (501, ""), (502, "a" * 49), (503, "a" * 50), (504, "a" * 1000), (505, " " * 400)]


def test_removed_passages_equal_brute_force(spark, monkeypatch):
    docs = spark.createDataFrame(passages(3), "doc_id long, text string")
    wanted = removed_by_hand([(d, (t or "").encode()) for d, t in passages(3)])
    for crowded, anchors in ((4096, 1 << 23), (4, 0)):
        monkeypatch.setattr(suffix_dedup, "CROWDED", crowded)
        monkeypatch.setattr(suffix_dedup, "MAP_CONTENTS", anchors)
        found = suffix_dedup.digests(docs, ["doc_id"]).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
        assert {r[0]: tuple(r[1:]) for r in found} == wanted


def test_texts_stay_valid_and_columns_stay(spark, odd, nothing):
    shared = "é" * 40 + "plain words that two texts share, long enough to count"
    texts = ["x" + shared + "è end", "y" + shared + "ê other end", shared]
    rows = suffix_dedup.remove_repeats(documents(spark, texts)).orderBy("doc_id").collect()
    assert [r.text for r in rows] == ["x" + shared + "è end", "yê other end", ""]
    assert [r.n_chars for r in rows] == [len(r.text) for r in rows]
    found = suffix_dedup.remove_repeats(odd)
    assert found.schema.fieldNames() == odd.schema.fieldNames() and found.count() == odd.count()
    by_id = {r.doc_id: r.text for r in found.collect()}
    # Repeated rows have one id and so nobody smaller; 6 differs at both ends only.
    assert by_id[5].startswith("A small") and by_id[2] is None and by_id[4] == LONG and len(by_id[6]) < 20
    assert suffix_dedup.remove_repeats(nothing).collect() == []


def test_language_model_orders_keys():
    """Also keys that differ only in the bits that carry places."""
    rng = np.random.default_rng(4)
    for size in (0, 1, 2, 5, 300):
        for keys in (rng.integers(0, 1 << 63, size, dtype=np.uint64), rng.integers(0, 9, size).astype(np.uint64), np.arange(size, dtype=np.uint64)[::-1].copy()):
            order, found = language_model._ordered(keys)
            assert order.tolist() == np.argsort(keys, kind="stable").tolist()
            assert found.tolist() == sorted(keys.tolist())
    key = np.array([7, 3, 7, 1, 3], dtype=np.uint64)
    keys, number, place = language_model._numbered(key, np.array([0, 1, 2, 4]))
    assert (keys.tolist(), number.tolist(), key[place].tolist()) == ([3, 7], [1, 0, 1, 0], [3, 7])


def test_language_model_hashes_words():
    words = pa.array(["", "a", "zwölf", "", "x" * 40])
    for part in (words, words.slice(2), words.slice(0, 0), pa.array([""])):
        for seed in (0, 1):
            assert language_model.word_hashes(part, seed).tolist() == [xxhash.xxh64_intdigest(w.encode(), seed) for w in part.to_pylist()]


def test_language_model_base_and_sums(spark, odd, nothing):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(words[: rng.choice([3, 30])]) for _ in range(rng.randint(0, 40))) for _ in range(150)] + [None, ""]
    docs = documents(spark, texts)
    train = F.crc32(F.col("doc_id").cast("string")) % 10 != 0
    rows = {r.row.doc_id: r for r in language_model.score_texts(docs, ["doc_id"], train).collect()}
    tokens = [(t or "").encode().lower().split() + [b""] for t in texts]
    learnt = [zlib.crc32(str(i).encode()) % 10 != 0 for i in range(len(texts))]
    c = Counter(w for t, k in zip(tokens, learnt) if k for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(tokens):
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel_tol=1e-12)
    assert sum(r.score for r in rows.values()) > sum(r.base_score for r in rows.values())
    assert language_model.score_texts(odd, ["doc_id"], F.lit(True)).count() == odd.count()
    untrained = language_model.score_texts(odd, ["doc_id"], F.lit(False)).collect()
    assert {(r.n_known, r.train_tokens, r.score) for r in untrained} == {(0, 0, 0.0)}
    assert language_model.score_texts(nothing, ["doc_id"], F.lit(True)).collect() == []


def backed_off(texts, learnt):
    """The model in plain Python: (probability of a token after a history, counts of words)."""
    grams = [Counter(), Counter(), Counter()]
    for t, k in zip(texts, learnt):
        if k:
            for n in range(3):
                grams[n].update(zip(*(t[i:] for i in range(n + 1))))
    arcs = [Counter(g[:-1] for g in grams[n]) for n in range(3)]
    total, distinct = sum(grams[0].values()), len(grams[0])

    def probability(history, word):
        if not history:
            return (grams[0][(word,)] + 0.1) / (total + 0.1 * (distinct + 1))
        lower = probability(history[1:], word)
        n = len(history)
        if not arcs[n][history]:
            return lower
        left = language_model.DISCOUNT * arcs[n][history]
        return (max(grams[n][(*history, word)] - language_model.DISCOUNT, 0) + left * lower) / grams[n - 1][history]

    return probability, grams[0]


def test_states_of_the_automaton_add_up():
    """The arcs and failure arcs of the automaton give every history a distribution, an unknown word included."""
    rng = random.Random(4)
    texts = [[rng.choice("abcd") for _ in range(rng.randint(0, 9))] + [""] for _ in range(30)]
    probability, words = backed_off(texts, [True] * 30)
    for history in ((), ("a",), ("", ), ("b", "c"), ("d", "d"), ("z", "a")):
        assert math.isclose(sum(probability(history, w) for (w,) in words) + probability(history, "unknown"), 1)


def test_scores_equal_the_plain_model(spark, monkeypatch):
    """Every n-gram of the training texts is an arc, however small its share; walks give what the recursion gives."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words[: rng.choice([4, 40])]) for _ in range(rng.randint(0, 30))) for _ in range(120)]
    texts += ["rare words meet", "rare words meet once more", None, "", "unseen w1 w2 w3", "rare words part"]
    texts += ["common filler text " * 100_000]
    learnt = [i % 7 != 0 and i < len(texts) - 3 or i == len(texts) - 1 for i in range(len(texts))]
    tokens = [tuple((t or "").lower().split() + [""]) for t in texts]
    probability, _ = backed_off(tokens, learnt)
    monkeypatch.setattr(language_model, "PART_TOKENS", 60_000)
    docs = documents(spark, texts).withColumn("learnt", F.array(*map(F.lit, learnt))[F.col("doc_id")]).repartition(5)
    rows = {r.row.doc_id: r for r in language_model.score_texts(docs, ["doc_id"], F.col("learnt")).collect()}
    for i, t in enumerate(tokens[:-1]):
        wanted = sum(math.log10(probability(t[max(0, p - 2) : p], w)) for p, w in enumerate(t))
        assert math.isclose(rows[i].score, wanted, rel_tol=1e-9), texts[i]
    # Two occurrences in 300,000 tokens are under any share of them, yet their words follow each other.
    assert rows[120].score > rows[120].base_score + 6
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("passagework_")]


def test_packing(spark, odd, nothing):
    rng = np.random.default_rng(3)
    sizes = np.concatenate([rng.integers(0, 4097, 400), [4096, 4096, 0, 0, 1]])
    bins, capacity = packing.pack(sizes)
    used = np.bincount(bins, weights=sizes)
    assert (used <= capacity).all() and set(capacity) <= set(packing.LENGTHS)
    smaller = {b: a for a, b in zip(packing.LENGTHS, packing.LENGTHS[1:])}
    assert all(used[i] > smaller.get(int(c), -1) for i, c in enumerate(capacity))
    assert sizes.sum() / capacity.sum() > 0.95
    docs = documents(spark, ["w " * 10_000, "a b c", "", None])
    rows = packing.best_fit(docs, ["doc_id"]).orderBy("row.doc_id", "piece").collect()
    assert [(r.row.doc_id, r.piece, r.first_word, r.size) for r in rows] == [
        (0, 0, 0, 4096), (0, 1, 4096, 4096), (0, 2, 8192, 1808), (1, 0, 0, 3), (2, 0, 0, 0), (3, 0, 0, 0)]
    assert packing.best_fit(odd, odd.columns).select("row.*").dtypes == odd.dtypes
    assert packing.best_fit(nothing, ["doc_id"]).collect() == []


def searched(vectors, k, scale=64):
    usable = [(i, [math.floor(scale * float(np.float32(c))) for c in v]) for i, v in vectors if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for at, (q, v) in enumerate(usable):
        if q % 20 == 0:
            found = [(-sum(a * b for a, b in zip(v, w)), i) for j, (i, w) in enumerate(usable) if j != at and len(w) == len(v)]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def test_search_equals_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    vectors = [(i, [rng.gauss(0, 1) + (i % 5) for _ in range(8)]) for i in range(-40, 400)]
    vectors += [(20, None), (1000, []), (40, [None] * 8), (60, [float("nan")] * 8), (None, [1.0] * 8), (2000, [1.0, 2.0]), (2001, [3.0, 4.0])]
    vectors += [(500 + i, [1.0] * 8) for i in range(40)] + [(900, [1e12] * 8), (3001, [0.5] * 8), (3001, [0.5] * 8)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(5)
    wanted = searched(vectors, 6)
    for slice_bytes, rows in ((16 << 20, 8192), (700, 50)):
        monkeypatch.setattr(exact_search, "SLICE_BYTES", slice_bytes)
        monkeypatch.setattr(exact_search, "BLOCK_ROWS", rows)
        found = exact_search.top_k(df, F.col("vec_id") % 20 == 0, 6)
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect()) == wanted
    assert exact_search.top_k(df.limit(0), F.col("vec_id") % 20 == 0, 6).collect() == []


def test_repeated_query_rows_have_a_list_each(spark, monkeypatch):
    rng = random.Random(19)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(1, 200)]
    # 40 comes three times, twice with one vector; 60 is one row; 7 is no query.
    vectors += [vectors[39], (40, [rng.gauss(0, 1) for _ in range(6)]), (7, vectors[6][1])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(4)
    wanted = searched(vectors, 9)
    assert sum(q == 40 for q, *_ in wanted) == 27
    for slice_bytes in (16 << 20, 200):
        monkeypatch.setattr(exact_search, "SLICE_BYTES", slice_bytes)
        found = exact_search.top_k(df, F.col("vec_id") % 20 == 0, 9)
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect()) == wanted


def test_bounds_leave_candidates_out(monkeypatch):
    monkeypatch.setattr(exact_search, "STEP", 50)
    monkeypatch.setattr(exact_search, "QUERY_ROWS", 2)
    rng = np.random.default_rng(1)
    centres = rng.integers(-400, 400, (10, 16))
    rows = centres[rng.integers(0, 10, 4000)] + rng.integers(-9, 9, (4000, 16))
    search = exact_search.Search(np.arange(20), rows[:20], centres, 10)
    for at in range(0, 4000, 1000):
        search.add(np.arange(at, at + 1000), rows[at : at + 1000], np.zeros(1000, dtype=bool))
    assert search.evaluated < 20 * 4000 * 0.8
