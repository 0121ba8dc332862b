"""Difficulty of all pairs of every group, counted without writing a pair out.

The report of a pair table needs its score differences only, and these need the sorted
scores of a group: the number of pairs closer than a bound is found by one binary search
per row. Work is rows x log(rows) per bound, where the pairs are rows squared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.functions.verdicts import winner_of
from rankforge.operators.columns import GROUP_KEYS, all_present, digest, require_columns
from rankforge.operators.difficulty import grade
from rankforge.operators.quantiles import QUARTILES
from rankforge.session import cut_lineage, measured, output_partitions

#: Distinct scores of a group that are searched at a time.
BLOCK_VALUES = 100_000
#: Bounds per wanted rank and pass.
_BOUNDS = 8
#: Differences of distinct scores left between two bounds that are listed one by one.
_LISTED = 20_000
_VALUES_PER_TASK = 100_000
#: Smallest differences at which the fixed gradual phases change: 1 - d <= 0.67 and 0.33.
_POSITIVE = math.nextafter(0.0, 1.0)


def _edge_of(score: float) -> float:
    """The smallest difference whose difficulty score is at most ``score``."""
    d = 1.0 - score
    while 1.0 - d > score:
        d = math.nextafter(d, math.inf)
    while 1.0 - math.nextafter(d, 0.0) <= score:
        d = math.nextafter(d, 0.0)
    return d


def _nearest(v: np.ndarray, bound: float) -> np.ndarray:
    """Per sorted distinct value, the first one at or before it that is less than ``bound`` away."""
    if bound <= 0:
        return np.arange(len(v)) + 1
    own = np.arange(len(v))
    at = np.minimum(np.searchsorted(v, v - bound), own)
    # the differences as a pair table has them decide, not the rounded v - bound
    while True:
        far = (at < own) & (v - v[at] >= bound)
        if not far.any():
            break
        at = at + far
    while True:
        near = (at > 0) & (v - v[np.maximum(at - 1, 0)] < bound)
        if not near.any():
            return at
        at = at - near


class _Counter:
    """Per unit and bound: pairs less than the bound apart, and how many pairs of distinct values."""

    def __init__(self, by: list[str], bounds: list[float]):
        self.by, self.bounds = by, bounds

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                v, c, sign = _unit(batch, i)
                until = np.concatenate([[0], np.cumsum(c)])
                equal = int((c * (c - 1) // 2).sum())
                own = np.arange(len(v))
                for k, bound in enumerate(self.bounds):
                    if bound <= 0:
                        rows.append((i, k, 0, 0))
                        continue
                    at = _nearest(v, bound)
                    pairs = int((c * (until[own] - until[at])).sum()) + equal
                    rows.append((i, k, sign * pairs, int((own - at).sum())))
            source, bound, n, distinct = zip(*rows) if rows else ((), (), (), ())
            tags = [batch.column(c).take(pa.array(source, type=pa.int64())) for c in self.by]
            made = [pa.array(bound, type=pa.int32()), pa.array(n, type=pa.int64()), pa.array(distinct, type=pa.int64())]
            yield pa.RecordBatch.from_arrays(tags + made, names=[*self.by, "_k", "_n", "_distinct"])


class _Lister:
    """The differences of distinct values in [low, high) of every bracket, with their pairs."""

    def __init__(self, brackets: list[tuple[float, float]]):
        self.brackets = brackets

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                v, c, sign = _unit(batch, i)
                for k, (low, high) in enumerate(self.brackets):
                    first = _nearest(v, high)
                    last = _nearest(v, low)
                    many = np.maximum(np.minimum(last, np.arange(len(v))) - first, 0)
                    right = np.repeat(np.arange(len(v)), many)
                    left = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(len(right))
                    d, at = np.unique(v[right] - v[left], return_inverse=True)
                    n = np.zeros(len(d), dtype=np.int64)
                    np.add.at(n, at, sign * c[right] * c[left])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(d), k, dtype=np.int32)), pa.array(d), pa.array(n)], names=["_k", "_d", "_n"]
                    )


class _Summer:
    """The sum of all differences of a unit."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for i in range(batch.num_rows):
                v, c, sign = _unit(batch, i)
                v = v - v[0]
                below, weight = np.cumsum(c) - c, np.cumsum(c * v) - c * v
                sums.append(sign * float((c * (v * below - weight)).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(sums, type=pa.float64())], names=["_sum"])


def _unit(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Values, their numbers of rows and the sign of one unit."""
    entries = batch.column("_values")[i].values
    v = np.asarray(entries.field(0).to_numpy(zero_copy_only=False), dtype=float)
    return v, entries.field(1).to_numpy(zero_copy_only=False).astype(np.int64), batch.column("_sign")[i].as_py()


class PairCounts:
    """Counts over all pairs of rows of one group, as ``generate_pairs`` makes them.

    ``by`` names those of the keys that the counts are told apart by. A group's distinct
    scores are a sorted array in one row. Beyond ``block_values`` they are cut into blocks
    by hash; each two blocks then make a unit, and what lies inside a block, counted once
    per partner, is taken off again, so that no task sees a whole large group.
    """

    def __init__(
        self, df: DataFrame, keys: list[str] = GROUP_KEYS, by: list[str] | None = None, block_values: int = BLOCK_VALUES,
    ):
        require_columns(df, ["label", *keys])
        self.spark, self.by = df.sparkSession, list(by or [])
        rows = df.filter(all_present(keys)).select(
            *self.by, digest(*keys).alias("_g"), F.col("label").cast("double").alias("_v")
        )
        # written once: read for the sizes and for the units
        values = cut_lineage(rows.groupBy(*rows.columns).agg(F.count("*").alias("_c")))
        finite = F.col("_v").isNotNull() & ~F.isnan("_v")
        self.infinite = bool(values.filter(F.abs("_v") == float("inf")).limit(1).count())
        sizes = measured(
            values.groupBy(*self.by, "_g").agg(
                F.sum("_c").alias("_n"), F.count_if(finite).alias("_m"),
                F.coalesce(F.sum(F.when(finite, F.col("_c"))), F.lit(0)).alias("_known"),
                F.coalesce(F.sum(F.when(F.isnan("_v"), F.col("_c"))), F.lit(0)).alias("_nan"),
                (F.max(F.when(finite, F.col("_v"))) - F.min(F.when(finite, F.col("_v")))).alias("_span"),
            )
        )

        def pairs(n):
            return F.shiftright(n * (n - 1), 1)

        given = F.col("_known") + F.col("_nan")
        self.odd = measured(
            sizes.groupBy(*self.by).agg(
                F.sum(pairs(F.col("_known"))).alias("valid"),
                F.sum(pairs(F.col("_n")) - pairs(given)).alias("missing"),
                F.sum(F.col("_nan") * F.col("_known")).alias("nan_apart"),
                F.sum(pairs(F.col("_nan"))).alias("nan_equal"),
            )
        )
        self.total, self.nan, self.span, distinct = sizes.select(
            F.coalesce(F.sum(pairs(F.col("_known"))), F.lit(0)),
            F.coalesce(F.sum(F.col("_nan") * F.col("_known") + pairs(F.col("_nan"))), F.lit(0)),
            F.coalesce(F.max("_span"), F.lit(0.0)), F.coalesce(F.sum("_m"), F.lit(0)),
        ).first()
        blocks = F.ceil(F.col("_m") / F.lit(block_values)).cast("int")
        cut = values.filter(finite).join(sizes.select("_g", blocks.alias("_blocks")), "_g")
        own = F.pmod(F.xxhash64("_v"), F.col("_blocks")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
        placed = cut.withColumn("_own", own).withColumn("_other", other).select(
            *self.by, "_g", F.least("_own", "_other").alias("_lo"), F.greatest("_own", "_other").alias("_hi"),
            "_blocks", F.struct("_v", "_c").alias("_e"),
        )
        unit = [*self.by, "_g", "_lo", "_hi"]
        sign = F.when(F.col("_lo") < F.col("_hi"), 1).when(F.col("_blocks") == 1, 1).otherwise(2 - F.col("_blocks"))
        parts = max(
            output_partitions(self.spark, distinct, _VALUES_PER_TASK), 2 * self.spark.sparkContext.defaultParallelism
        )
        gathered = placed.withColumn("_sign", sign).repartition(parts, *unit).groupBy(*unit, "_sign").agg(
            F.sort_array(F.collect_list("_e")).alias("_values")
        )
        self.units = cut_lineage(gathered.select(*self.by, "_sign", "_values").filter("_sign <> 0"))
        sizes.unpersist()

    def below(self, bounds: list[float], by: bool = False) -> DataFrame:
        """Per bound number ``_k`` (and ``by``): pairs less than it apart, pairs of distinct values."""
        keys = self.by if by else []
        ddl = ", ".join(f"`{c}` {self.units.schema[c].dataType.simpleString()}" for c in keys)
        made = self.units.select(*keys, "_sign", "_values").mapInArrow(
            _Counter(keys, bounds), f"{ddl}{', ' if ddl else ''}_k int, _n bigint, _distinct bigint"
        )
        return made.groupBy(*keys, "_k").agg(F.sum("_n").alias("_n"), F.sum("_distinct").alias("_distinct"))

    def _at_ranks(self, ranks: list[int]) -> dict[int, float]:
        """The differences with these 0-based ranks: brackets shrink until few values are left to list."""
        top = math.nextafter(self.span, math.inf)
        zero = {r["_k"]: r for r in self.below([_POSITIVE, top]).collect()}
        found: dict[int, float] = {}
        open_: dict[int, tuple[float, float, int, int]] = {}
        for r in ranks:
            if r < zero[0]["_n"]:
                found[r] = 0.0
            else:
                open_[r] = (_POSITIVE, top, zero[0]["_n"], zero[1]["_distinct"] - zero[0]["_distinct"])
        while True:
            wide = sorted({b[:2] for b in open_.values() if b[3] > _LISTED and math.nextafter(b[0], math.inf) < b[1]})
            if not wide:
                break
            bounds = sorted({lo + (hi - lo) * i / (_BOUNDS + 1) for lo, hi in wide for i in range(1, _BOUNDS + 1)} |
                            {math.nextafter(lo, math.inf) for lo, _ in wide} | {x for b in wide for x in b})
            seen = {bounds[r["_k"]]: (r["_n"], r["_distinct"]) for r in self.below(bounds).collect()}
            for r, (lo, hi, _, _) in list(open_.items()):
                if (lo, hi) not in wide:
                    continue
                low = max(b for b in bounds if lo <= b < hi and seen[b][0] <= r)
                high = min(b for b in bounds if low < b <= hi and seen[b][0] > r)
                open_[r] = (low, high, seen[low][0], seen[high][1] - seen[low][1])
        brackets = sorted({b[:2] for b in open_.values() if math.nextafter(b[0], math.inf) < b[1]})
        listed = self.units.select("_sign", "_values").mapInArrow(_Lister(brackets), "_k int, _d double, _n bigint")
        rows = listed.groupBy("_k", "_d").agg(F.sum("_n").alias("_n")).collect() if brackets else []
        for r, (lo, hi, before, _) in open_.items():
            if (lo, hi) not in brackets:
                found[r] = lo
                continue
            mine = sorted((x["_d"], x["_n"]) for x in rows if x["_k"] == brackets.index((lo, hi)))
            for d, n in mine:
                before += n
                if before > r:
                    found[r] = d
                    break
        return found

    def quantiles(self, probs: dict[str, float] | None = None) -> dict[str, float] | None:
        """Exact quantiles of the differences with linear interpolation; None without any."""
        probs = probs or QUARTILES
        if not self.total:
            return None
        places = {n: (self.total - 1) * p for n, p in probs.items()}
        at = self._at_ranks(sorted({f(x) for x in places.values() for f in (math.floor, math.ceil)}))
        out = {}
        for name, x in places.items():
            low, high, share = at[math.floor(x)], at[math.ceil(x)], x - math.floor(x)
            out[name] = low if low == high else low * (1 - share) + high * share
        return out

    def mean(self) -> float | None:
        if self.nan:
            return math.nan
        if not self.total:
            return None
        return self.units.select("_sign", "_values").mapInArrow(_Summer(), "_sum double").agg(F.sum("_sum")).first()[0] / self.total

    def graded(self) -> DataFrame:
        """The graded pairs as a table of classes: one row per range of differences, ``n`` pairs each.

        Ranges end where a level, a fixed phase or equality begins, so that every rule of
        difficulty and phase holds for all of a range or for none, and reads its lower end.
        """
        cuts = self.quantiles() or {}
        edges = sorted({0.0, _POSITIVE, _edge_of(0.67), _edge_of(0.33), *cuts.values()})
        seen = self.below([*edges, math.inf], by=True).groupBy(*self.by).pivot("_k", list(range(len(edges) + 1))).agg(F.first("_n"))
        none = F.lit(None).cast("double")

        def row(d, equal, n):
            return F.struct(d.alias("norm_diff"), F.lit(equal).alias("_equal"), n.alias("n"))

        ranges = [
            row(F.lit(d), d < _POSITIVE, F.col(str(k + 1)) - F.col(str(k))) for k, d in enumerate(edges)
        ]
        odd = [
            row(none, True, F.col("missing")), row(F.lit(math.nan), False, F.col("nan_apart")),
            row(F.lit(math.nan), True, F.col("nan_equal")),
        ]
        table = seen.select(*self.by, F.inline(F.array(*ranges))).unionByName(
            self.odd.select(*self.by, F.inline(F.array(*odd)))
        ).filter("n > 0")
        out = grade(table, {n: F.lit(cuts.get(n)).cast("double") for n in QUARTILES})
        # which side of a pair is higher is not known here, only whether one is
        return out.withColumn("winner", F.when(F.col("_equal"), winner_of(F.lit(0), F.lit(0)))).drop("_equal")
