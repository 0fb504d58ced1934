"""Token counts of whole texts by a public tokenizer's library.

Texts travel in Arrow batches cut by bytes, and only lengths come back. Each
text is split where the tokenizer must begin a new token anyway, so that a text
of any length is a list of short pieces; the library encodes every distinct
piece of a slice in one batch (pieces met before are remembered), and lengths are summed per text.

Safe boundary for the byte-level vocabulary: between a letter, digit or sign and
a following space or line feed. Its splitting pattern has no token in which white
space follows anything else, and looks ahead only from white space. The one
special token holds no white space either. Elsewhere nothing is cut.

Defined cases: a null text counts as empty (0 tokens); a text without a safe
boundary is one piece; repeated rows each give a row; other columns are not read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import as_texts, slices, starts_of, sums_between

#: Before the boundary: a visible ASCII character or a Latin letter; after it: a space or line feed.
SAFE = re.compile(r"(?<=[!-~À-ÖØ-öø-ɏ])(?=[ \n])")

#: Distinct pieces whose lengths a worker remembers between slices.
REMEMBERED = 500_000

_loaded: dict[str, object] = {}
_seen: dict[str, dict[str, int]] = {}


def _tokenizer(path: str):
    """The library's tokenizer, loaded once per worker and path."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            _loaded[path] = SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            loaded = Tokenizer.from_file(path)
            loaded.no_truncation()
            loaded.no_padding()
            _loaded[path] = loaded
    return _loaded[path]


def lengths(path: str, texts: list[str]) -> np.ndarray:
    """Tokens of each text, as the library gives them for the whole text."""
    tokenizer = _tokenizer(path)
    if path.endswith(".model"):
        # This kind has no boundary that is safe in general, so its texts stay whole.
        return np.array([len(x) for x in tokenizer.encode(texts, num_threads=1)], dtype=np.int64)
    pieces = [SAFE.split(x) for x in texts]
    bounds = starts_of(np.array([len(x) for x in pieces], dtype=np.int64))
    seen = _seen.setdefault(path, {})
    own = {p: 0 for x in pieces for p in x if p not in seen}
    for piece, found in zip(own, tokenizer.encode_batch_fast([*own], add_special_tokens=False)):
        own[piece] = len(found)
    each = np.fromiter((own[p] if p in own else seen[p] for x in pieces for p in x), dtype=np.int64, count=bounds[-1])
    for piece, size in own.items():
        if len(seen) >= REMEMBERED:
            break
        if len(piece) < 64:
            seen[piece] = size
    return sums_between(each, bounds)


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens) of every row. `path` is a tokenizer file that all executors have."""
    chosen = docs.select(F.col(key), F.col(text).alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            column = part.column("_text")
            size = pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())
            tokens = pa.array(lengths(path, as_texts(column)))
            yield pa.RecordBatch.from_arrays([part.column(0), size, tokens], names=[key, "n_bytes", "n_tokens"])

    kind = chosen.schema[0].dataType.simpleString()
    return chosen.mapInArrow(count, f"`{key}` {kind}, n_bytes long, n_tokens long")
