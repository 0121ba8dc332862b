"""Keyed hashes: the one source of order and randomness in this package.

Every shuffle, draw and sample is a function of row keys and a seed, so results do
not depend on partitioning, input order or retries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = float(2**32)


def key_hash(*parts: Column | str, seed: int | str | None = None) -> Column:
    """md5 hex of the parts joined by ``_`` (and the seed last, if any)."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    cols = [c.cast("string") for c in cols]
    if seed is not None:
        cols.append(F.lit(str(seed)))
    return F.md5(F.concat_ws("_", *cols))


def uniform(hex_hash: Column) -> Column:
    """Uniform in [0, 1) from the first eight hex digits."""
    return F.conv(F.substring(hex_hash, 1, 8), 16, 10).cast("double") / F.lit(TWO_32)


def order_number(hex_hash: Column) -> Column:
    """The first fifteen hex digits as a non-negative bigint."""
    return F.conv(F.substring(hex_hash, 1, 15), 16, 10).cast("bigint")
