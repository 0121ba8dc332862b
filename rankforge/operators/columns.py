"""Small table-level helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUP_KEYS = ["item", "task", "prompt"]


def require_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Fail before any job runs if columns are missing; the message names them."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def keep_present(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[c for c in cols if c in df.columns])


def digest(*cols: str | Column) -> Column:
    """One md5 for a tuple of text keys, NULL-aware and free of separator clashes.

    Shuffling the digest instead of the texts keeps wide keys out of the exchange.
    """
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.md5(F.concat(*[F.coalesce(F.md5(p.cast("string")), F.lit("-")) for p in parts]))


def all_present(cols: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in cols])


def number_or_null(value: Column) -> Column:
    """NaN counts as missing."""
    return F.when(~F.isnan(value), value)


def union_present(frames: list[DataFrame | None]) -> DataFrame:
    """Union by name of the sources that exist, missing columns filled with NULL."""
    present = [f for f in frames if f is not None]
    if not present:
        raise ValueError("no source present")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), present)


def label_sources(sources: dict[str, DataFrame | None], column: str = "dataset") -> DataFrame:
    """Dataset registry as one table with a label column; absent datasets are skipped."""
    return union_present(
        [None if df is None else df.withColumn(column, F.lit(name)) for name, df in sources.items()]
    )
