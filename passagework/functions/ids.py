"""Identifiers and cache keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the URL namespace of RFC 4122.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def chunk_id(doc_id: Column, index: Column) -> Column:
    return F.concat_ws(":", doc_id.cast("string"), index.cast("string"))


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """Version-5 UUID of `name`: SHA-1 with the version and variant bits set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    variant = F.lower(
        F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("bigint").bitwiseAND(3).bitwiseOR(8))
    )
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def cache_key(model: str, text: Column, namespace: str = "emb") -> Column:
    return F.concat(F.lit(f"{namespace}:"), F.sha2(F.concat(F.lit(f"{model}:"), text), 256))
