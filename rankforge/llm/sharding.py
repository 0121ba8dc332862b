"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows get the numbers 0 .. n - 1 of a total order; a keyed permutation sends each number
to a position, and position p lies in shard p mod s at slot p div s. Counts of shards are
at most one apart and slots have no gap. Shard and slot of a row number, and the row
number of any shard and slot, are computed from (n, shards, seed) alone.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from rankforge.operators.ordering import row_index

ROUNDS = 6
#: Equal rows are dealt over the tasks in runs of this many.
COPIES_PER_RUN = 100_000

# Multipliers of the round function, below 2**31 so that products fit 63 bits.
MULTIPLIERS = (0x7FEB352D, 0x2C1B3C6D)
_LOW = 0xFFFFFFFF


def _scramble(x, key: int):
    """32-bit mix of a number and a round key; works on ints and on int64 arrays."""
    h = (x + key) & _LOW
    h = h ^ (h >> 16)
    h = (h * MULTIPLIERS[0]) & _LOW
    h = h ^ (h >> 15)
    h = (h * MULTIPLIERS[1]) & _LOW
    return h ^ (h >> 16)


def round_keys(seed: int) -> list[int]:
    return [_scramble((seed & _LOW) ^ (j + 1) * 0x9E3779B9 & _LOW, j) for j in range(ROUNDS)]


def domain(n: int) -> tuple[int, int]:
    """Sides a, b of the smallest near-square with a * b >= n; fewer than a numbers lie outside."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def permute(rows: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Positions of row numbers: a bijection of 0 .. n - 1.

    Even rounds move the part below a, odd ones the part below b; a number that leaves
    0 .. n - 1 walks on along its cycle until it is back inside.
    """
    a, b = domain(n)
    keys = round_keys(seed)
    out = np.array(rows, dtype=np.int64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] % a, out[walking] // a
        for j, key in enumerate(keys):
            if j % 2 == 0:
                left = (left + _scramble(right, key)) % a
            else:
                right = (right + _scramble(left, key)) % b
        out[walking] = left + a * right
        walking = walking[out[walking] >= n]
    return out


def invert(positions: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Row numbers of positions: the rounds backwards, along the cycle backwards."""
    a, b = domain(n)
    keys = round_keys(seed)
    out = np.array(positions, dtype=np.int64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] % a, out[walking] // a
        for j in reversed(range(ROUNDS)):
            if j % 2 == 0:
                left = (left - _scramble(right, keys[j])) % a
            else:
                right = (right - _scramble(left, keys[j])) % b
        out[walking] = left + a * right
        walking = walking[out[walking] >= n]
    return out


def locate(row_number: int, n: int, shards: int, seed: int = 42) -> tuple[int, int]:
    """Shard and slot of a row number, without any table."""
    if not 0 <= row_number < n:
        raise ValueError(f"row number {row_number} is not below {n}")
    at = int(permute(np.array([row_number]), n, seed)[0])
    return at % shards, at // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 42) -> int:
    """The row number that lies at a slot of a shard, without any table."""
    at = slot * shards + shard
    if not (0 <= shard < shards and 0 <= at < n):
        raise ValueError(f"shard {shard} has no slot {slot}")
    return int(invert(np.array([at]), n, seed)[0])


def number_rows(rows: DataFrame, order: list[str], name: str = "row_number") -> DataFrame:
    """``rows`` with their 0-based number in the order of ``order``, nulls first.

    Rows that agree there follow the hash of their other columns; wholly equal ones are
    interchangeable. They are counted first and written out again in runs, numbered as a
    last key, so that a row repeated any number of times is split over tasks. Give it the
    columns that place a row, not the texts; columns cannot be maps.
    """
    columns = rows.columns
    slim = rows.groupBy(*columns).agg(F.count("*").alias("_copies"))
    # the first value of a range of copies; every range goes to a task of its own
    runs = slim.withColumn(
        "_run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_copies") - 1) / COPIES_PER_RUN)))
    ).repartition(*columns, "_run")
    first = F.col("_run") * COPIES_PER_RUN
    last = F.least(first + COPIES_PER_RUN, F.col("_copies")) - 1
    each = runs.withColumn("_copy", F.explode(F.sequence(first, last))).drop("_run", "_copies")
    each = each.withColumn("_rest", F.xxhash64(*columns))
    return row_index(each, [*order, "_rest", "_copy"], name=name).drop("_rest", "_copy")


def shard_rows(rows: DataFrame, order: list[str], shards: int, seed: int = 42) -> DataFrame:
    """``rows`` with ``row_number``, ``position`` (bigint), ``shard`` (int) and ``slot`` (bigint).

    Reproducible: the result depends on the rows, ``order``, ``shards`` and ``seed``, not on
    partitions. Counts of shards differ by one at most, also when there are fewer rows than
    shards. Rows of one text, of one doc_id or wholly equal are separate rows, each with a
    place of its own, and the permutation scatters them; nulls in ``order`` come first; an
    empty table gives an empty one. Columns of ``rows`` with one of the four names would
    clash: an error says so.
    """
    taken = {"row_number", "position", "shard", "slot"} & set(rows.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} exist already")
    if shards < 1:
        raise ValueError("at least one shard is needed")
    numbered = number_rows(rows, order)
    n = numbered.count()

    @pandas_udf("bigint")
    def position(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), n, seed))

    placed = numbered.withColumn("position", position("row_number"))
    return placed.withColumns(
        {
            "shard": (F.col("position") % shards).cast("int"),
            "slot": F.expr(f"position div {int(shards)}"),
        }
    )


def text_places(docs: DataFrame) -> DataFrame:
    """What places a document: doc_id, size (UTF-8 bytes + 1), CRC-32 and digest of its text.

    A null text has size 1 and the CRC-32 of no bytes (0); its digest is null.
    """
    raw = docs["text"].cast("binary")
    return docs.select(
        docs["doc_id"].alias("doc_id"),
        (F.coalesce(F.octet_length(raw), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(raw, F.lit(b""))).alias("text_crc32"),
        F.md5(raw).alias("text_md5"),
    )


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 42) -> DataFrame:
    """One row per document: its place among ``shards`` shards by law ``rows``.

    Documents are numbered by (doc_id, digest of the text), nulls first. Only ids, sizes and
    digests move; texts stay where they are, whatever their length.
    """
    return shard_rows(text_places(docs), ["doc_id", "text_md5"], shards, seed)
