"""Byte-pair encoding and decoding with word ends, as the tokenizers library does it.

A word is encoded on a contiguous rank array: the boundaries of its parts and,
beside them, the rank of merging each part with the next. The smallest rank is
found by a scan, its inner boundary deleted, and the ranks on both sides looked up
again, until no neighbouring parts can merge. Words are short, so scans beat a heap.

Whole texts are normalised and split piece by piece between white space; every
distinct piece of a slice is encoded once. Special tokens written out in a text
are taken as such, before anything is normalised, which is the library's default.

Defined cases: a null text counts as empty (no ids, decoded to empty text); a word
of any length is encoded (in time square to its length beyond LONG characters
by a heap instead); repeated rows each give a row; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import as_texts, slices

#: White space as the vocabulary's patterns mean it.
SPACE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
LONG = 256
#: Distinct pieces, and distinct words, that a worker remembers between slices.
REMEMBERED = 500_000

NONE = 1 << 60


def byte_letters() -> list[str]:
    """A visible letter for each byte: itself if it is printable Latin-1, else one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


#: Ids as little-endian 32-bit numbers, the text decoded from them, their number.
Encoded = tuple[bytes, str, int]


def joined(parts: list[Encoded]) -> Encoded:
    ids = b"".join([p[0] for p in parts])
    return ids, " ".join([p[1] for p in parts if p[1]]), len(ids) // 4


class WordBpe:
    """A vocabulary file of the word-end kind: ids, merge ranks and special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.ids.items()}
        self.end = model["end_of_word_suffix"] or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens.update({i: t for t, i in self.special.items()})
        self.letters = {b: x for b, x in enumerate(byte_letters())}
        # Fixed value: the splitting pattern of the vocabulary, with its white space spelt out.
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.path, self.library = path, None
        self.pieces: dict[str, Encoded] = {}
        self.known: dict[str, Encoded] = {}

    def merge(self, letters: str) -> list[str]:
        """The parts of one word after all merges."""
        bounds = [*range(len(letters) + 1)]
        parts = [*letters]
        parts[-1] += self.end
        if len(parts) > LONG:
            return self._merge_long(parts)
        rank = self.ranks.get
        # ranks[i] is the rank of merging part i with part i + 1.
        ranks = [rank(pair, NONE) for pair in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            parts[i] += parts[i + 1]
            del parts[i + 1], bounds[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), NONE)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), NONE)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        """The same merges in the same order, for words where scanning would take too long."""
        after = [*range(1, len(parts)), -1]
        before = [*range(-1, len(parts) - 1)]
        held: list[str | None] = [*parts]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := self.ranks.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if held[i] != a or j < 0 or held[j] != b:
                continue
            held[i], held[j] = a + b, None
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (r := self.ranks.get((held[left], held[right]))) is not None:
                    heapq.heappush(heap, (r, left, held[left], held[right]))
        return [x for x in held if x is not None]

    def _word(self, word: str) -> Encoded:
        hit = self.known.get(word)
        if hit is None:
            # Each byte of the word as a letter.
            hit = self._letters(word.encode("utf-8").decode("latin-1").translate(self.letters))
            if len(self.known) < REMEMBERED and len(word) < LONG:
                self.known[word] = hit
        return hit

    def _letters(self, letters: str) -> Encoded:
        tokens = [t for t in self.merge(letters) if t in self.ids]
        return struct.pack(f"<{len(tokens)}I", *[self.ids[t] for t in tokens]), " ".join(tokens), len(tokens)

    def _newer(self, piece: str) -> list[Encoded]:
        """The words of a piece with characters that Python's tables do not know yet.

        The tables of this Python, of the pattern library and of the tokenizers library are of
        different Unicode versions. Only the latter's count for such characters, so it cuts these pieces.
        """
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        plain = self.library.normalizer.normalize_str(piece)
        return [self._letters(letters) for letters, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)]

    def _piece(self, piece: str) -> Encoded:
        """The encoding of a piece between white space."""
        hit = self.pieces.get(piece)
        if hit is None:
            if not piece.isascii() and any(unicodedata.category(c) == "Cn" for c in piece):
                hit = joined(self._newer(piece))
            else:
                # Letters are lowered one by one, without regard to their place in a word.
                plain = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
                words = self.words.findall(plain)
                hit = self._word(words[0]) if len(words) == 1 else joined([self._word(w) for w in words])
            if len(self.pieces) < REMEMBERED and len(piece) < LONG:
                self.pieces[piece] = hit
        return hit

    def _parts(self, text: str) -> list[Encoded]:
        pieces = text.replace("\n", " ").split(" ")
        hits = [*map(self.pieces.get, pieces)]
        if None in hits:
            hits = [self._piece(p) if h is None else h for p, h in zip(pieces, hits)]
        return hits

    def encode(self, text: str) -> Encoded:
        if self.cut is None or not self.cut.search(text):
            parts = self._parts(text)
        else:
            parts = []
            for x in self.cut.split(text):
                if x in self.special:
                    parts.append((struct.pack("<I", self.special[x]), x, 1))
                else:
                    parts += self._parts(x)
        return joined(parts)

    def decode(self, ids: bytes) -> str:
        """Tokens joined by a space; this vocabulary file names no decoder that would do more."""
        known = self.tokens
        return " ".join([known[i] for (i,) in struct.iter_unpack("<I", ids) if i in known])


_loaded: dict[str, WordBpe] = {}


def vocabulary(path: str) -> WordBpe:
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def encode_texts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """(key, n_tokens, ids, decoded) of every row; `ids` holds little-endian 32-bit numbers.

    With `digest`, (key, n_tokens, ids_sha256, decoded_sha256) instead.
    """
    chosen = docs.select(F.col(key), F.col(text).alias("_text"))
    kind = chosen.schema[0].dataType.simpleString()
    names = ["ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for part in slices(batches, "_text"):
            ids, decoded, n = [], [], []
            for x in as_texts(part.column("_text")):
                a, _, c = bpe.encode(x)
                # Decoded from the ids, so that a wrong or missing one would show.
                b = bpe.decode(a)
                ids.append(_sha(a) if digest else a)
                decoded.append(_sha(b.encode("utf-8")) if digest else b)
                n.append(c)
            kinds = pa.string() if digest else pa.binary()
            arrays = [part.column(0), pa.array(n, pa.int64()), pa.array(ids, kinds), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, "n_tokens", *names])

    types = "string" if digest else "binary"
    return chosen.mapInArrow(run, f"`{key}` {kind}, n_tokens long, {names[0]} {types}, {names[1]} string")


def decode_ids(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded) of rows with ids as `encode_texts` writes them; null ids decode to empty text."""
    chosen = encoded.select(F.col(key), F.col(ids).alias("_ids"))
    kind = chosen.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for part in slices(batches, "_ids"):
            out = [bpe.decode(x or b"") for x in part.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], names=[key, "decoded"])

    return chosen.mapInArrow(run, f"`{key}` {kind}, decoded string")
