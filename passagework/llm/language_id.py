"""Language of a text by interpolated Kneser-Ney character models.

Training. Characters are letters in lower case, everything else counts as a space,
and runs of spaces as one. N-grams up to ORDER characters are counted on Spark over
a documented sample: of every language the TRAIN_TEXTS distinct texts with the
smallest hash, so that copies count once. Of every language the MODEL_GRAMS most
frequent n-grams of the highest order form its model, which bounds what reaches the
driver and the workers. The driver turns these counts into interpolated Kneser-Ney
probabilities: the highest order discounts counts, lower orders discount the number
of different characters seen before.

Storage. For every order one sorted array of n-gram hashes is shared by all
languages, with a table beside it that has a column of log-probabilities for each;
another such pair holds the back-off weights of contexts. A batch of texts looks all
its n-grams up by binary search; those found in no language go on to the next order.

Decision. The language with the lowest cross-entropy per character wins. Whether the
text is in any of them at all is decided by a limit halfway between the cross-entropy
of validation texts (those of the sample that the models did not learn from) under
their own language and that of their shuffled characters.

Defined cases: a null text, or one without a letter, is `und` with score 0 and is
rejected; without any labelled text every document is `und` and rejected; ties between
languages go to the first by name; very short texts are judged like any other; repeated
rows each get a row; only the key, text and label columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from passagework.llm.common import as_texts, carried, slices, starts_of, sums_between, text_slices
from passagework.session import materialize

ORDER = 4
#: Bound of the sample: so many distinct texts of each language, a tenth of them for validation.
TRAIN_TEXTS = 2_000
#: Bound of the model: so many n-grams of the highest order for each language.
MODEL_GRAMS = 200_000
DISCOUNT = 0.75
SPACE = 32
#: Characters after which more text no longer makes the score more certain.
CERTAIN_AFTER = 60

_classes: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For every code point: itself if it is a letter or a mark, else a space."""
    if not _classes:
        points = np.arange(0x110000, dtype=np.uint32)
        keep = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
        keep[0x300:0x370] = True
        _classes.append(np.where(keep, points, SPACE).astype(np.uint32))
    return _classes[0]


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each preceded by a space, and where each begins.

    The result of a text without letters is its leading space alone.
    """
    encoded = [(" " + x.lower() + " ").encode("utf-32-le", "surrogatepass") for x in texts]
    bounds = starts_of(np.array([len(x) // 4 for x in encoded], dtype=np.int64))
    points = _letters()[np.frombuffer(b"".join(encoded), dtype=np.uint32)]
    keep = np.ones(len(points), dtype=bool)
    keep[1:] = (points[1:] != SPACE) | (points[:-1] != SPACE)
    keep[bounds[:-1]] = True
    kept_before = starts_of(keep.astype(np.int64))
    return points[keep], kept_before[bounds]


def _mix(state: np.ndarray, points: np.ndarray) -> np.ndarray:
    state = (state + points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return state ^ (state >> np.uint64(31))


def _row_hashes(rows: np.ndarray) -> np.ndarray:
    """Hashes of n-grams given as rows of code points."""
    state = np.full(len(rows), rows.shape[1], dtype=np.uint64)
    for j in range(rows.shape[1]):
        state = _mix(state, rows[:, j])
    return state


@dataclass
class Models:
    """`grams[n]` and `contexts[n]` are (sorted hashes, table with a column per language) of order n."""

    langs: list[str]
    grams: dict[int, tuple[np.ndarray, np.ndarray]]
    contexts: dict[int, tuple[np.ndarray, np.ndarray]]
    floor: np.ndarray
    limit: float = float("inf")

    def log_probs(self, points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Natural log-probability of each character but a text's first, per language; the first has 0."""
        out = np.zeros((len(points), len(self.langs)), dtype=np.float32)
        inside = np.arange(len(points)) - np.repeat(bounds[:-1], np.diff(bounds))
        for order in range(ORDER, 0, -1):
            # Characters near the beginning have short contexts.
            chosen = inside >= ORDER - 1 if order == ORDER else inside == order - 1
            chosen &= inside > 0
            at = np.flatnonzero(chosen)
            if len(at):
                out[at] = self._at(points, at, order)
        return out

    def _at(self, points: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
        if order == 0:
            return np.broadcast_to(self.floor, (len(at), len(self.langs))).astype(np.float32)
        hashes, table = self.grams[order]
        state = np.full(len(at), order, dtype=np.uint64)
        for j in range(order):
            state = _mix(state, points[at - order + 1 + j])
        found, where = _find(hashes, state)
        out = np.empty((len(at), len(self.langs)), dtype=np.float32)
        out[found] = table[where[found]]
        rest = np.flatnonzero(~found)
        if len(rest):
            lower = self._at(points, at[rest], order - 1)
            if order > 1:
                known, weights = self.contexts[order - 1]
                context = np.full(len(rest), order - 1, dtype=np.uint64)
                for j in range(order - 1):
                    context = _mix(context, points[at[rest] - order + 1 + j])
                seen, place = _find(known, context)
                lower[seen] += weights[place[seen]]
            out[rest] = lower
        return out

    def entropies(self, points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character and language, and the number of characters."""
        logs = self.log_probs(points, bounds)
        size = np.maximum(np.diff(bounds) - 1, 0)
        each = [sums_between(logs[:, i].astype(np.float64), bounds) for i in range(len(self.langs))]
        return -np.stack(each, axis=1) / np.maximum(size, 1)[:, None], size


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), dtype=bool), np.zeros(len(wanted), dtype=np.int64)
    where = np.searchsorted(keys, wanted)
    where[where == len(keys)] = 0
    return keys[where] == wanted, where


def _estimate(grams: np.ndarray, counts: np.ndarray) -> tuple[dict, dict, float]:
    """Of one language: per order the n-grams as rows with log-probabilities, and contexts with log-weights."""
    levels = {ORDER: (grams, counts.astype(np.float64))}
    for order in range(ORDER - 1, 0, -1):
        # How many different characters come before each shorter n-gram.
        rows, n = np.unique(levels[order + 1][0][:, 1:], axis=0, return_counts=True)
        levels[order] = (rows, n.astype(np.float64))
    alphabet = len(levels[1][0]) + 1
    floor = -np.log(alphabet)
    probs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    weights: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    lower: dict[bytes, float] = {}
    for order in range(1, ORDER + 1):
        rows, n = levels[order]
        contexts, owner = np.unique(rows[:, :-1], axis=0, return_inverse=True) if order > 1 else (None, np.zeros(len(rows), dtype=np.int64))
        owner = owner.reshape(-1)
        total = np.bincount(owner, weights=n)
        kinds = np.bincount(owner)
        weight = DISCOUNT * kinds / total
        below = np.array([lower[r.tobytes()] for r in np.ascontiguousarray(rows[:, 1:])]) if order > 1 else np.full(len(rows), 1 / alphabet)
        p = np.maximum(n - DISCOUNT, 0) / total[owner] + weight[owner] * below
        probs[order] = (rows, np.log(p))
        if order > 1:
            weights[order - 1] = (contexts, np.log(weight))
        else:
            floor += float(np.log(weight[0])) if len(weight) else 0.0
        lower = {r.tobytes(): x for r, x in zip(np.ascontiguousarray(rows), p.tolist())}
    return probs, weights, floor


def build(langs: list[str], grams: dict[str, list[str]], counts: dict[str, list[int]]) -> Models:
    """Models of several languages in shared arrays.

    A language that lacks an n-gram which another has gets the probability its
    own back-off gives.
    """
    own = {}
    for lang in langs:
        rows = np.array([[ord(c) for c in g] for g in grams[lang]], dtype=np.uint32).reshape(-1, ORDER)
        own[lang] = _estimate(rows, np.array(counts[lang]))
    floor = np.array([own[lang][2] for lang in langs], dtype=np.float32)
    models = Models(langs, {}, {}, floor)
    for order in range(1, ORDER):
        parts = [own[lang][1][order] for lang in langs]
        models.contexts[order] = _merge_columns(parts, np.zeros(len(langs)))[:2]
    for order in range(1, ORDER + 1):
        parts = [own[lang][0][order] for lang in langs]
        hashes, table, rows = _merge_columns(parts, np.full(len(langs), np.nan))
        # Fill what a language lacks by its back-off: the shorter n-gram and the weight of the context.
        flat = rows.reshape(-1)
        ends = np.arange(len(rows)) * order + order - 1
        if len(rows):
            lower = models._at(flat, ends, order - 1)
            if order > 1:
                known, weights = models.contexts[order - 1]
                seen, place = _find(known, _row_hashes(rows[:, :-1]))
                lower[seen] += weights[place[seen]]
            table = np.where(np.isnan(table), lower, table).astype(np.float32)
        models.grams[order] = (hashes, table)
    return models


def _merge_columns(parts: list[tuple[np.ndarray, np.ndarray]], empty: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = np.concatenate([p[0] for p in parts])
    values = np.concatenate([p[1] for p in parts])
    column = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    hashes, first, where = np.unique(_row_hashes(rows), return_index=True, return_inverse=True)
    table = np.tile(empty, (len(hashes), 1)).astype(np.float32)
    table[where.reshape(-1), column] = values
    return hashes, table, rows[first]


def _sample(docs: DataFrame, text: str, label: str, where: Column) -> DataFrame:
    """(lang, text, check): the texts to learn from; those with `check` are for validation."""
    # Only hashes are sorted out; the texts of the chosen ones are read in a second look.
    labelled = docs.filter(where & docs[label].isNotNull() & docs[text].isNotNull())
    rows = labelled.select(labelled[label].cast("string").alias("lang"), labelled[text].alias("text"))
    hashes = rows.select("lang", F.xxhash64("text").alias("h")).groupBy("lang", "h").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = hashes.withColumn("place", place).filter(F.col("place") <= TRAIN_TEXTS)
    chosen = chosen.select("lang", "h", (F.col("place") % 10 == 0).alias("check"))
    picked = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(materialize(chosen, "language-sample")), ["lang", "h"])
    # Copies of a chosen text were kept by the join; one of each remains.
    return materialize(picked.groupBy("lang", "h").agg(F.first("text").alias("text"), F.first("check").alias("check")), "language-texts")


def _count_grams(sample: DataFrame) -> DataFrame:
    """(lang, gram, n) over the texts to learn from."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            labels = np.array(part.column("lang").to_pylist(), dtype=object)
            texts = as_texts(part.column("text"))
            for lang in sorted(set(labels.tolist())):
                points, bounds = characters([x for x, y in zip(texts, labels) if y == lang])
                if len(points) < ORDER:
                    continue
                windows = np.lib.stride_tricks.sliding_window_view(points, ORDER)
                owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                windows = windows[owner[: len(windows)] == owner[ORDER - 1 :]]
                _, first, n = np.unique(_row_hashes(windows), return_index=True, return_counts=True)
                grams = ["".join(map(chr, w)) for w in windows[first].tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(n, pa.int64())],
                    names=["lang", "gram", "n"],
                )

    counted = sample.filter(~F.col("check")).select("lang", "text").mapInArrow(count, "lang string, gram string, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text: str = "text", label: str = "lang", where: Column | None = None) -> Models | None:
    """Models of every language that labels the rows of `where`; None if there are none."""
    sample = _sample(docs, text, label, F.lit(True) if where is None else where)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = _count_grams(sample).withColumn("place", place).filter(F.col("place") <= MODEL_GRAMS)
    grams: dict[str, list[str]] = {}
    counts: dict[str, list[int]] = {}
    for r in top.select("lang", "gram", "n").toLocalIterator():
        grams.setdefault(r["lang"], []).append(r["gram"])
        counts.setdefault(r["lang"], []).append(r["n"])
    if not grams:
        return None
    models = build(sorted(grams), grams, counts)
    _calibrate(models, sample.filter("check"))
    return models


def _calibrate(models: Models, checks: DataFrame) -> None:
    """Set the limit from validation texts and their shuffled characters."""
    shared = checks.sparkSession.sparkContext.broadcast(models)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            points, bounds = characters(as_texts(part.column("text")))
            mixed = points.copy()
            draw = np.random.default_rng(0)
            for begin, end in zip(bounds[:-1], bounds[1:]):
                draw.shuffle(mixed[begin:end])
            own, _ = shared.value.entropies(points, bounds)
            other, _ = shared.value.entropies(mixed, bounds)
            yield pa.RecordBatch.from_arrays([pa.array(own.min(axis=1)), pa.array(other.min(axis=1))], names=["own", "mixed"])

    found = checks.select("text").mapInArrow(measure, "own double, mixed double")
    high, low = found.agg(F.percentile_approx("own", 0.999), F.percentile_approx("mixed", 0.5)).first()
    if high is not None:
        models.limit = max(high * 1.1, (high + low) / 2)


def predict(docs: DataFrame, models: Models | None, columns: list[str], text: str = "text") -> DataFrame:
    """`columns` of each row as the struct `row`, with `lang_pred`, `score` and `rejected`."""
    chosen = docs.select(*carried(docs, columns, text))
    shared = docs.sparkSession.sparkContext.broadcast(models)
    found = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for part in text_slices(batches, columns, text, 1 << 20):
            points, bounds = characters(as_texts(part.column("_text")))
            letters = sums_between((points != SPACE).astype(np.int64), bounds) > 0
            if models is None:
                names = np.full(len(letters), "und", dtype=object)
                score, rejected = np.zeros(len(letters)), np.ones(len(letters), dtype=bool)
            else:
                entropy, size = models.entropies(points, bounds)
                best = entropy.argmin(axis=1)
                least = entropy.min(axis=1)
                certain = np.minimum(size, CERTAIN_AFTER)[:, None]
                share = 1 / np.exp(-np.minimum((entropy - least[:, None]) * certain, 700)).sum(axis=1)
                names = np.where(letters, np.array(models.langs, dtype=object)[best], "und")
                score = np.where(letters, share, 0.0)
                rejected = ~letters | (least > models.limit)
            arrays = [part.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "lang_pred", "score", "rejected"])

    return chosen.mapInArrow(run, StructType([chosen.schema[0], *found]))


def keep_identified(docs: DataFrame, text: str = "text", label: str = "lang") -> DataFrame:
    """The documents whose language is one of those that label the table, with their own columns."""
    return predict(docs, train(docs, text, label), docs.columns, text).filter("NOT rejected").select("row.*")
