"""A linear-chain conditional random field over the shapes of words, in NumPy.

A token's features are its shape, whether it stands apart from the token before it, and
its letters if the training table has them often; every token also sees those of REACH
neighbours on either side. Since features depend on the token alone, the weights of each
(neighbour's place, token type) are summed once per distinct type, and a sequence is scored
by looking up rows. Training (`fit`) maximises the penalised likelihood of a small labelled
table by forward and backward sums over all its sequences together; decoding (`Field.decode`)
is Viterbi over a whole batch of sequences at a time, longest first, so that the rows still
running are always a prefix.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np

#: Neighbours that a token sees on either side.
REACH = 2
#: Words that stand in at least so many training rows are features by their letters.
COMMON_WORD = 3
#: Distinct token types whose scores a worker keeps.
KEPT_TYPES = 1 << 16
TURNS = 80
STEP = 0.15
PENALTY = 0.002
NEVER = -1e4

TOKEN = re.compile(r"[^\W0-9_]+|[0-9]+|\S")
EDGE = ("", True)


def tokens(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text)]


def shape(word: str) -> str:
    """Letters by case and number, digits by number, anything else as it is."""
    if "0" <= word[0] <= "9":
        return f"9x{min(len(word), 20)}"
    if not word[0].isalpha():
        return word[0]
    case = "x" if word.islower() else "X" if word.isupper() else "Xx"
    return f"{case}{min(len(word), 4)}"


def features(word: str, apart: bool, common: frozenset[str]) -> list[str]:
    if not word:
        return ["edge"]
    drawn = shape(word)
    found = [f"s:{drawn}", f"a:{apart}", f"sa:{drawn}:{apart}"]
    low = word.lower()
    if "0" <= word[0] <= "9" and len(word) <= 3:
        found.append(f"byte:{int(word) <= 255}")
    elif word[0].isalpha():
        if low in common:
            found.append(f"w:{low}:{apart}")
        if len(word) <= 4 and all(c in "abcdef" for c in low):
            found.append("hex")
    return found


def allowed(labels: list[str]) -> np.ndarray:
    """0 where a label may follow another, NEVER where I- would not continue its own kind; the last row is the start."""
    out = np.zeros((len(labels) + 1, len(labels)))
    for j, to in enumerate(labels):
        if to.startswith("I-"):
            for i, before in enumerate([*labels, "start"]):
                if before[2:] != to[2:] or before[:2] not in ("B-", "I-"):
                    out[i, j] = NEVER
    return out


def marks(spans: list[tuple[str, int, int]], places: list[tuple[int, int]], labels: list[str]) -> list[int]:
    """The label of each token under spans (kind, start, end)."""
    out = [0] * len(places)
    for kind, start, end in spans:
        first = True
        for i, (s, e) in enumerate(places):
            if s >= start and e <= end:
                out[i] = labels.index(f"{'B' if first else 'I'}-{kind}")
                first = False
    return out


@dataclass
class Field:
    """Trained weights: per place of a neighbour, feature and label; and per pair of labels (last row: the start)."""

    labels: list[str]
    common: frozenset[str]
    names: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray
    types: dict[tuple[str, bool], int] = field(default_factory=dict)
    rows: list[np.ndarray] = field(default_factory=list)

    def type_of(self, word: str, apart: bool) -> int:
        found = self.types.get((word, apart))
        if found is None:
            found = len(self.rows)
            known = [self.names[f] for f in features(word, apart, self.common) if f in self.names]
            self.rows.append(self.weights[:, known].sum(axis=1))
            self.types[word, apart] = found
        return found

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Places (start, end) and types of the tokens of one sequence."""
        places = np.array(tokens(text), dtype=np.int64).reshape(-1, 2)
        before = -1
        kinds = np.empty(len(places), dtype=np.int64)
        for i, (start, end) in enumerate(places.tolist()):
            kinds[i] = self.type_of(text[start:end], start != before)
            before = end
        return places, kinds

    def decode(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """Spans (kind, start, end) of each sequence under the best labelling."""
        found: list[list] = [[] for _ in texts]
        waiting: list = []
        edge = self._forget()
        for i, text in enumerate(texts):
            if len(self.rows) >= KEPT_TYPES:
                self._decode(waiting, edge, found)
                waiting, edge = [], self._forget()
            places, kinds = self.encode(text)
            if len(kinds):
                waiting.append((i, places, kinds))
        self._decode(waiting, edge, found)
        return found

    def _forget(self) -> int:
        """Start a new table of types; the number of the edge."""
        self.types.clear()
        self.rows.clear()
        return self.type_of(*EDGE)

    def _decode(self, encoded: list, edge: int, found: list) -> None:
        order = sorted(range(len(encoded)), key=lambda x: -len(encoded[x][2]))
        labelled = viterbi([encoded[x][2] for x in order], np.stack(self.rows), edge, self.moves)
        for x, best in zip(order, labelled):
            i, places, _ = encoded[x]
            for at in np.flatnonzero(best):
                label = self.labels[best[at]]
                if label[0] == "B":
                    found[i].append([label[2:], int(places[at][0]), int(places[at][1])])
                else:
                    found[i][-1][2] = int(places[at][1])
            found[i] = [tuple(s) for s in found[i]]


def padded(kinds: list[np.ndarray], edge: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All sequences in one array with REACH edges around each; where each begins, and lengths."""
    sizes = np.array([len(k) for k in kinds], dtype=np.int64)
    around = np.full(REACH, edge)
    flat = np.concatenate([x for k in kinds for x in (around, k, around)]) if kinds else np.empty(0, np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + 2 * REACH)[:-1]]).astype(np.int64) + REACH if len(kinds) else sizes
    return flat, begins, sizes


def emissions(flat: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores of all labels for the tokens at the places `at`."""
    return sum(rows[flat[at + place - REACH], place] for place in range(2 * REACH + 1))


def viterbi(kinds: list[np.ndarray], rows: np.ndarray, edge: int, moves: np.ndarray) -> list[np.ndarray]:
    """The best labels of each sequence; sequences come longest first."""
    if not kinds:
        return []
    flat, begins, sizes = padded(kinds, edge)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    back = np.zeros((starts[-1], moves.shape[1]), dtype=np.int8)
    score = emissions(flat, begins, rows) + moves[-1]
    last = np.zeros(len(kinds), dtype=np.int64)
    running = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")
    for t in range(1, int(sizes[0])):
        n = int(running[t])
        ended = slice(n, int(running[t - 1]))
        last[ended] = score[ended].argmax(axis=1)
        through = score[:n, :, None] + moves[:-1]
        best = through.argmax(axis=1)
        back[starts[:n] + t] = best
        score = np.take_along_axis(through, best[:, None, :], axis=1)[:, 0] + emissions(flat, begins[:n] + t, rows)
        # Rows that have ended are dropped; their last label is known.
    n = len(score)
    last[:n] = score.argmax(axis=1)
    out = np.zeros(starts[-1], dtype=np.int64)
    out[starts[:-1] + sizes - 1] = last
    for t in range(int(sizes[0]) - 1, 0, -1):
        n = int(running[t])
        at = starts[:n] + t
        out[at - 1] = back[at, out[at]]
    return [out[b:e] for b, e in zip(starts[:-1], starts[1:])]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def likelihood(kinds: list[np.ndarray], gold: list[np.ndarray], rows: np.ndarray, edge: int, moves: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of the labels, and its slopes for `rows` and `moves`; sequences come longest first."""
    flat, begins, sizes = padded(kinds, edge)
    steps, labels = int(sizes[0]), moves.shape[1]
    running = [int(np.searchsorted(-sizes, -t, "left")) for t in range(steps)]
    forward, scores = [], []
    for t in range(steps):
        n = running[t]
        scores.append(emissions(flat, begins[:n] + t, rows))
        before = moves[-1] if t == 0 else _log_sum(forward[-1][:n, :, None] + moves[:-1], 1)
        forward.append(before + scores[-1])
    total = np.empty(len(kinds))
    for t in range(steps):
        ended = slice(running[t + 1] if t + 1 < steps else 0, running[t])
        total[ended] = _log_sum(forward[t][ended], 1)
    value = -total.sum()
    row_slope, move_slope = np.zeros_like(rows), np.zeros_like(moves)
    backward = np.zeros((0, labels))
    for t in range(steps - 1, -1, -1):
        n = running[t]
        after = np.zeros((n, labels))
        if len(backward):
            m = len(backward)
            into = moves[:-1] + (scores[t + 1] + backward)[:, None, :]
            pair = np.exp(forward[t][:m, :, None] + into - total[:m, None, None])
            move_slope[:-1] -= pair.sum(axis=0)
            after[:m] = _log_sum(into, 2)
        backward = after
        seen = -np.exp(forward[t] + after - total[:n, None])
        own = np.array([g[t] for g in gold[:n]])
        seen[np.arange(n), own] += 1
        value += scores[t][np.arange(n), own].sum()
        if t == 0:
            move_slope[-1] += seen.sum(axis=0)
            value += moves[-1, own].sum()
        else:
            earlier = np.array([g[t - 1] for g in gold[:n]])
            np.add.at(move_slope, (earlier, own), 1)
            value += moves[earlier, own].sum()
        for place in range(2 * REACH + 1):
            np.add.at(row_slope[:, place], flat[begins[:n] + t + place - REACH], seen)
    return value, row_slope, move_slope


def fit(table: list[tuple[str, list[tuple[str, int, int]]]], kinds: list[str], turns: int = TURNS) -> Field:
    """A field for spans of `kinds`, from rows (text, spans (kind, start, end))."""
    labels = ["O", *(f"{part}-{kind}" for kind in kinds for part in "BI")]
    words = Counter(w for text, _ in table for w in {text[s:e].lower() for s, e in tokens(text)} if w[0].isalpha())
    common = frozenset(w for w, n in words.items() if n >= COMMON_WORD)
    bans = allowed(labels)
    places = 2 * REACH + 1
    found = Field(labels, common, {}, np.zeros((places, 0, len(labels))), bans.copy())
    encoded = []
    for text, spans in table:
        at, types = found.encode(text)
        if len(types):
            encoded.append((types, np.array(marks(spans, [tuple(x) for x in at.tolist()], labels))))
    if not encoded:
        return found
    edge = found.type_of(*EDGE)
    encoded.sort(key=lambda x: -len(x[0]))
    sequences, gold = [x[0] for x in encoded], [x[1] for x in encoded]
    drawn = [features(w, apart, common) for w, apart in sorted(found.types, key=found.types.get)]
    names = {f: i for i, f in enumerate(sorted({f for fs in drawn for f in fs}))}
    has = np.zeros((len(drawn), len(names)))
    for i, fs in enumerate(drawn):
        has[i, [names[f] for f in fs]] = 1
    weights, moves = np.zeros((places, len(names), len(labels))), np.zeros_like(bans)
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(moves)]
    for turn in range(1, turns + 1):
        rows = np.einsum("tf,pfl->tpl", has, weights)
        _, row_slope, move_slope = likelihood(sequences, gold, rows, edge, moves + bans)
        slopes = (np.einsum("tf,tpl->pfl", has, row_slope) / len(gold) - PENALTY * weights, move_slope / len(gold) - PENALTY * moves)
        for i, (values, slope) in enumerate(zip((weights, moves), slopes)):
            mean, square = moments[2 * i], moments[2 * i + 1]
            mean += 0.1 * (slope - mean)
            square += 0.01 * (slope**2 - square)
            values += STEP * (mean / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.99**turn)) + 1e-8)
    return Field(labels, common, names, weights, moves + bans)
