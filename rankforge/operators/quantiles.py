"""Exact quantiles with linear interpolation, without one task holding all values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankforge.session import measured

# groups up to this many rows are small enough for the built-in per-group value map
DIRECT_ROWS = 500_000
QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}

#: Slices of a bracket; each is ranked on its own.
_SLICES = 256


def exact_quantiles(
    df: DataFrame, value: str, probs: dict[str, float] | None = None,
    by: list[str] | None = None, accuracy: int = 10_000, direct_rows: int = DIRECT_ROWS,
) -> DataFrame:
    """One row per group with one column per named probability.

    A sketch first brackets each order statistic (its rank error is at most
    rows / accuracy; five times that is kept as margin). A second pass sums equal values
    inside the brackets and counts the rows between them; the wanted order statistics
    are read off the running counts, so the result is exact while no task
    ever keeps more than about 10 / accuracy of a group's distinct values. If no group
    exceeds ``direct_rows``, the second pass is the built-in ``percentile`` instead.
    NULL and NaN are left out. Groups without values give no row.
    """
    probs = probs or QUARTILES
    keys = list(by or [])
    base = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(
        *keys, F.col(value).cast("double").alias("_v")
    )
    if not keys:
        keys = ["_all"]
        base = base.withColumn("_all", F.lit(0))
    margin = 5.0 / accuracy
    names = list(probs)
    lows = [max(0.0, probs[n] - margin) for n in names]
    highs = [min(1.0, probs[n] + margin) for n in names]
    sketch = base.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        F.percentile_approx("_v", lows + highs, accuracy).alias("_q"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
    )
    width = len(names)
    # below this size the margin is less than the two rows interpolation may need
    few = F.col("_n") <= accuracy
    brackets = measured(
        sketch.select(
            *keys, "_n",
            *[
                (F.col("_min") if lows[i] == 0.0 else F.when(few, F.col("_min")).otherwise(F.col("_q")[i])).alias(f"_lo{i}")
                for i in range(width)
            ],
            *[
                (F.col("_max") if highs[i] == 1.0 else F.when(few, F.col("_max")).otherwise(F.col("_q")[width + i])).alias(f"_hi{i}")
                for i in range(width)
            ],
        )
    )
    largest = brackets.agg(F.max("_n")).first()[0] or 0
    if largest <= direct_rows:
        cuts = F.percentile("_v", F.array(*[F.lit(p) for p in probs.values()]))
        direct = base.groupBy(*keys).agg(cuts.alias("_q")).select(
            *keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)]
        )
        return direct if by else direct.drop("_all")
    framed = base.join(brackets, keys)
    v = F.col("_v")
    inside = F.lit(False)
    for i in range(width):
        inside = inside | v.between(F.col(f"_lo{i}"), F.col(f"_hi{i}"))
    # rows outside all brackets are only counted, at the bracket end below them
    end_below = F.greatest(
        F.lit(float("-inf")), *[F.when(F.col(f"_hi{i}") < v, F.col(f"_hi{i}")) for i in range(width)]
    )
    # slices cut the brackets in value order, so that no window holds all of their values
    part = F.lit(-1)
    for i in reversed(range(width)):
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        within = F.coalesce(F.floor((v - lo) / F.when(hi > lo, hi - lo) * _SLICES), F.lit(0))
        above = F.when(~inside & (end_below == hi), i * (_SLICES + 2) + _SLICES + 1)
        own = F.when(inside & v.between(lo, hi), i * (_SLICES + 2) + within)
        part = F.coalesce(own, above, part)
    entries = (
        framed.select(
            *keys, "_n", inside.alias("_in"), F.when(inside, v).otherwise(end_below).alias("_at"),
            part.cast("int").alias("_s"),
        )
        .groupBy(*keys, "_s", "_at", "_in")
        .agg(F.count("*").alias("_c"), F.max("_n").alias("_n"))
    )
    earlier = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    slices = entries.groupBy(*keys, "_s").agg(F.sum("_c").alias("_c"))
    offsets = slices.select(*keys, "_s", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"))
    running = Window.partitionBy(*keys, "_s").orderBy("_at", F.desc("_in"))
    ranked = entries.join(offsets, [*keys, "_s"])
    ranked = ranked.withColumn("_to", F.col("_before") + F.sum("_c").over(running)).withColumn(
        "_from", F.col("_to") - F.col("_c")
    )

    def at_rank(rank):
        held = F.col("_in") & (F.col("_from") <= rank) & (rank < F.col("_to"))
        return F.max(F.when(held, F.col("_at")))

    picks = {}
    for name in names:
        rank = (F.col("_n") - 1) * F.lit(probs[name])
        picks[f"_low_{name}"] = at_rank(F.floor(rank))
        picks[f"_high_{name}"] = at_rank(F.ceil(rank))
        picks[f"_d_{name}"] = F.max(rank - F.floor(rank))
    picked = ranked.groupBy(*keys).agg(*[c.alias(n) for n, c in picks.items()])
    missed = F.raise_error(F.lit("a wanted rank lies outside its bracket"))
    for n in names:
        for end in (f"_low_{n}", f"_high_{n}"):
            picked = picked.withColumn(end, F.coalesce(F.col(end), missed.cast("double")))
    out = picked.select(
        *keys,
        *[
            (F.col(f"_low_{n}") * (1 - F.col(f"_d_{n}")) + F.col(f"_high_{n}") * F.col(f"_d_{n}")).alias(n)
            for n in names
        ],
    )
    return out if by else out.drop("_all")


def attach_quantiles(
    df: DataFrame, value: str, by: list[str] | None = None, probs: dict[str, float] | None = None
) -> DataFrame:
    """Add the group's quantile columns to each row.

    A global set is one row and goes in as literals; grouped sets are joined, and
    Catalyst broadcasts them if their measured size allows.
    """
    probs = probs or QUARTILES
    cuts = exact_quantiles(df, value, probs, by)
    if by:
        return df.join(measured(cuts), list(by), "left")
    row = cuts.first()
    for name in probs:
        df = df.withColumn(name, F.lit(None if row is None else row[name]).cast("double"))
    return df
