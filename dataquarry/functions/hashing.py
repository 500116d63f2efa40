"""Reproducible per-row hashes for splits, folds and samples.

``md5`` rather than ``xxhash64`` so that any SQL engine can recompute the split.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_SPACE = 1 << 32
# Values of at most so many bytes are their own group key.
KEY_BYTES = 64


def salted_digest(key: Column, salt: str = "") -> Column:
    return F.md5(F.concat(F.lit(salt), key.cast("string")))


def value_key(value: Column) -> Column:
    """A short key that is equal exactly for equal texts: the text itself, or its marked SHA-256 if that is shorter.

    A marked digest has 66 bytes, so it never meets a text that stands for itself.
    """
    return F.when(F.octet_length(value) > KEY_BYTES, F.concat(F.lit("#:"), F.sha2(value, 256))).otherwise(value)


def key_hash(key: Column, salt: str = "") -> Column:
    """The first 32 bits of ``md5(salt || key)`` as BIGINT, uniform in [0, 2**32)."""
    return F.conv(F.substring(salted_digest(key, salt), 1, 8), 16, 10).cast("bigint")
