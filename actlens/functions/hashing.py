"""Keyed hashes: the only source of randomness in the package.

A draw depends on (seed, key) alone, never on row order or partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60


def text_hash(text: Column) -> Column:
    """sha256 of the UTF-8 text, as hex."""
    return F.sha2(text, 256)


def int_hash(text: Column) -> Column:
    """First 60 bits of the sha256 of ``text`` as a non-negative BIGINT.

    Eight bytes instead of a 64-character string through shuffles and sorts.
    """
    number = F.conv(F.substring(F.sha2(text, 256), 1, HASH_BITS // 4), 16, 10).cast("bigint")
    # Never NULL: the planner then adds no null check that would hash a second time.
    return F.coalesce(number, F.lit(0).cast("bigint"))


def key_hash(seed: int, *parts: Column | str) -> Column:
    """Hash of ``seed|part|part…``; plain strings are literals."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return int_hash(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def unit_hash(hashed: Column) -> Column:
    """Map a 60-bit hash to [0, 1)."""
    return hashed.cast("double") / F.lit(float(1 << HASH_BITS))
