"""Ranks and cuts over whole tables without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankforge.session import cut_lineage, measured

_POSITION_BITS = 33  # monotonically_increasing_id keeps the in-partition position here


def row_index(
    df: DataFrame, order: list[str], by: list[str] | None = None, name: str = "row_index"
) -> DataFrame:
    """Dense 0-based index over a declared total order, restarted per ``by`` value.

    Rows are range-partitioned by the whole order key, so a frequent leading value
    is split by the columns behind it. The sorted rows are written once to the
    checkpoint folder, because range bounds are sampled and must not be drawn twice;
    the running offset is then taken over one row per partition.
    """
    by = list(by or [])
    ranged = df.repartitionByRange(*[F.col(c) for c in by + order])
    placed = cut_lineage(
        ranged.sortWithinPartitions(*by, *order).withColumn("_at", F.monotonically_increasing_id())
    )
    placed = placed.withColumn("_part", F.shiftright("_at", _POSITION_BITS))
    sizes = placed.groupBy("_part", *by).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = before.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = measured(
        sizes.select(
            "_part", *by, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
        )
    )
    # positions inside one partition are consecutive, so no second sort is needed
    keyed = placed.join(offsets, ["_part", *by])
    return keyed.withColumn(
        name, (F.col("_at") - F.col("_first") + F.col("_offset")).cast("bigint")
    ).drop("_at", "_part", "_first", "_offset")


def hash_cuts(
    rows: DataFrame, by: list[str], quotas: DataFrame, cuts: list[str],
    hash_col: str = "_h", tie: str = "_tie", digits: int = 3,
) -> DataFrame:
    """Per group, the (hash, tie) of the row that fills each quota.

    ``quotas`` holds one row per group with one bigint column per name in ``cuts``.
    The hash order is uniform whatever the keys look like, so counting rows per hash
    prefix finds the prefix in which a quota ends, and only the rows of that prefix
    (1 in 16**digits of the group) are ever sorted. The result has one struct column
    per cut: a row belongs to the quota if its (hash, tie) is below the cut, and ``k`` of
    the ``same`` rows that are at the cut do.
    """
    prefix = F.substring(hash_col, 1, digits)
    keyed = rows.select(*by, hash_col, tie, prefix.alias("_p"))
    running = Window.partitionBy(*by).orderBy("_p")
    counts = keyed.groupBy(*by, "_p").agg(F.count("*").alias("_n"))
    spans = counts.withColumn("_hi", F.sum("_n").over(running)).withColumn(
        "_lo", F.col("_hi") - F.col("_n")
    )
    wanted = F.array(*[F.struct(F.lit(c).alias("cut"), F.col(c).alias("q")) for c in cuts])
    edges = measured(
        spans.join(quotas, by)
        .select(*by, "_p", "_lo", "_hi", F.explode(wanted).alias("w"))
        .filter((F.col("w.q") > F.col("_lo")) & (F.col("w.q") <= F.col("_hi")))
        .groupBy(*by, "_p")
        .agg(F.collect_list(F.struct("w.cut", (F.col("w.q") - F.col("_lo")).alias("rank"))).alias("_e"))
    )
    ranked = Window.partitionBy(*by, "_p").orderBy(hash_col, tie)
    alike = Window.partitionBy(*by, "_p", hash_col, tie)
    ends = (
        keyed.join(edges, [*by, "_p"])
        .withColumn("_r", F.row_number().over(ranked))
        .withColumn("k", F.col("_r") - F.rank().over(ranked) + 1)
        .withColumn("same", F.count("*").over(alike))
        .select(*by, hash_col, tie, "_r", "k", "same", F.inline("_e"))
        .filter(F.col("_r") == F.col("rank"))
    )
    at = F.struct(F.col(hash_col).alias("h"), F.col(tie).alias("t"), "k", "same")
    return measured(
        ends.groupBy(*by).agg(*[F.max(F.when(F.col("cut") == c, at)).alias(c) for c in cuts])
    )


def within_cut(cut: str, hash_col: str = "_h", tie: str = "_tie") -> Column:
    """True if the row lies inside the quota that ``cut`` (from hash_cuts) closes."""
    h, t = F.col(f"{cut}.h"), F.col(f"{cut}.t")
    order = F.coalesce(F.col(tie) < t, F.lit(False))
    at = F.col(tie).eqNullSafe(t) & (F.col("_nr") <= F.col(f"{cut}.k"))
    inside = (F.col(hash_col) < h) | ((F.col(hash_col) == h) & (order | at))
    return F.coalesce(inside, F.lit(False))


def lowest_by_hash(
    df: DataFrame, by: list[str], quotas: DataFrame, quota: str, hash_expr: Column, tie_expr: Column
) -> DataFrame:
    """Keep, per group, the ``quota`` rows that come first in (hash, tie) order.

    ``df`` is read twice, however much its rows cost: once to count the hash prefixes, and once to
    write out the rows up to the prefix in which the quota ends. All else reads those. A group
    of fewer rows than its quota is kept whole.
    """
    keyed = df.withColumn("_h", hash_expr).withColumn("_tie", tie_expr)
    prefix = F.substring("_h", 1, 3)
    counts = keyed.groupBy(*by, prefix.alias("_p")).agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*by)
    spans = counts.withColumns(
        {"_hi": F.sum("_n").over(group.orderBy("_p")), "_rows": F.sum("_n").over(group)}
    ).join(quotas.select(*by, F.col(quota).alias("_q0")), by)
    wanted = F.least("_q0", "_rows")
    last = measured(
        spans.filter((wanted > 0) & (F.col("_hi") >= wanted))
        .groupBy(*by).agg(F.min("_p").alias("_last"), F.max(wanted).alias(quota))
    )
    near = keyed.join(last.select(*by, "_last"), by).filter(prefix <= F.col("_last")).drop("_last")
    near = cut_lineage(near)
    ends = hash_cuts(near, by, last.drop("_last"), [quota])
    placed = numbered_ties(near.join(ends, by), by, ends, [quota])
    return placed.filter(within_cut(quota)).drop("_h", "_tie", "_nr", quota)


def numbered_ties(placed: DataFrame, by: list[str], ends: DataFrame, cuts: list[str]) -> DataFrame:
    """Add ``_nr``, the number of a row among those of its (hash, tie); 1 where nothing ties.

    Only if some cut falls among tied rows are rows numbered, and only those at a cut;
    their other columns order them, so that equal rows alone are interchangeable.
    """
    torn = F.lit(False)
    for c in cuts:
        torn = torn | F.coalesce(F.col(f"{c}.same") > F.col(f"{c}.k"), F.lit(False))
    if not ends.filter(torn).limit(1).count():
        return placed.withColumn("_nr", F.lit(1))
    at = F.lit(False)
    for c in cuts:
        here = (F.col("_h") == F.col(f"{c}.h")) & F.col("_tie").eqNullSafe(F.col(f"{c}.t"))
        at = at | F.coalesce(here, F.lit(False))
    rest = [f.name for f in placed.schema if f.dataType.typeName() not in ("map", "variant")]
    alike = Window.partitionBy(*by, "_h", "_tie").orderBy(*[c for c in rest if c not in by])
    numbered = placed.filter(at).withColumn("_nr", F.row_number().over(alike))
    return placed.filter(~at).withColumn("_nr", F.lit(1)).unionByName(numbered)
