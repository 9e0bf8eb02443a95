"""Seeded hash order: the one source of randomness in this package.

``md5(seed:key)`` is a pure function of the row, so every sample, shuffle and
split is the same for any partitioning, any number of retries and any engine
that has md5.  Nothing here uses ``rand()``, ``uuid()`` or partition ids.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(seed: int | str, *keys: str | Column) -> Column:
    """32 hex digits, ``md5(seed:key1:key2...)``; hex text sorts as the number does."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hash_int(digest: Column, digits: int = 15) -> Column:
    """The first ``digits`` hex digits as a BIGINT (15 digits = 60 bits, always positive)."""
    if not 1 <= digits <= 15:
        raise ValueError("digits must be between 1 and 15")
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def as_list(keys: str | Sequence[str]) -> list[str]:
    """One column name or several, as a list."""
    return [keys] if isinstance(keys, str) else list(keys)
