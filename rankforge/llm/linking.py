"""Candidate pairs from shared keys, without emitting all pairs of a key.

``post`` is a table (h, gid, n, w): element ``gid`` of size ``n`` carries ``w`` keys, one
row for each key ``h`` that a second element carries too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """What two elements share at least if they link; ``percent`` None asks for one key.

    With a Jaccard similarity of percent / 100 two sets of n_a and n_b elements differ in
    (100 - percent) * (n_a + n_b) / (100 + percent) elements at most. The keys of a set are
    digests of its cells: all sets are cut alike by element into cells, w of which hold
    one. Every element that differs spoils one cell, and the others are equal in both.
    """

    percent: int | None = None

    def differ(self, n_a: Column, n_b: Column) -> Column:
        return F.floor((100 - self.percent) * (n_a + n_b) / F.lit(100.0 + self.percent) + 1e-9)

    def need(self, n_a: Column, w_a: Column, n_b: Column, w_b: Column) -> Column:
        if self.percent is None:
            return F.lit(1)
        return F.greatest(F.lit(1), F.greatest(w_a, w_b) - self.differ(n_a, n_b))

    def sizes(self, n_a: Column, n_b: Column) -> Column:
        if self.percent is None:
            return F.lit(True)
        return 100 * F.least(n_a, n_b) >= self.percent * F.greatest(n_a, n_b)


def with_shared(post: DataFrame) -> DataFrame:
    """``post`` and ``m``: how many keys of the element a second element carries.

    An element may have keys in several sets of them that differ in ``w``.
    """
    return post.join(post.groupBy("gid", "w").agg(F.count("*").alias("m")), ["gid", "w"])


def leaders(post: DataFrame) -> DataFrame:
    """(h, lead): the leader of each key, an element with few keys of its own, with its n, w and m."""
    rank = F.struct((-F.col("m") / F.col("w")).alias("own"), F.xxhash64("gid").alias("r"), "gid", "n", "w", "m")
    return post.groupBy("h").agg(F.min(rank).alias("lead"))


def leader_pairs(post: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): elements and the leaders of their keys, one leader to a key.

    The leader is an element with few keys of its own, of copies thus the one nearest to
    the original. Leaders are a way to unite large groups in few pairs, not a complete
    search: a pair counts if it meets under half of the keys it needs.
    """
    lead = leaders(post)
    need = rule.need(F.col("n"), F.col("w"), F.col("lead.n"), F.col("lead.w"))
    met = post.join(lead, "h").filter(F.col("gid") != F.col("lead.gid")).withColumn("need", need)
    met = met.filter(rule.sizes(F.col("n"), F.col("lead.n")) & (F.least("m", "lead.m") >= F.col("need")))
    pairs = met.groupBy(F.least("gid", "lead.gid").alias("a"), F.greatest("gid", "lead.gid").alias("b")).agg(
        F.count("*").alias("shared"), F.min("need").alias("need")
    )
    return pairs.filter(2 * F.col("shared") >= F.col("need")).select("a", "b")


def remaining_pairs(held: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): all pairs that share the keys they need and are not yet united.

    ``held`` is (h, id, n, w, m, comp). Components, not members, meet under a key first,
    by the bounds of their members, and only different ones that meet under enough keys
    are expanded; so a large united group costs one row here.
    """
    bounds = [F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("w").alias("w0"), F.max("m").alias("m1")]
    spots = held.groupBy("h", "comp").agg(*bounds)

    def of(table: DataFrame, x: str) -> DataFrame:
        return table.select("h", *[F.col(c).alias(f"{c}_{x}") for c in table.columns if c != "h"])

    met = of(spots, "a").join(of(spots, "b"), "h").filter(F.col("comp_a") < F.col("comp_b"))
    both = ["comp_a", "comp_b"]
    if rule.percent is not None:
        low = F.greatest("w0_a", "w0_b") - rule.differ(F.col("n1_a"), F.col("n1_b"))
        sized = (100 * F.col("n1_a") >= rule.percent * F.col("n0_b")) & (100 * F.col("n1_b") >= rule.percent * F.col("n0_a"))
        met = met.withColumn("low", F.greatest(F.lit(1), low)).filter(sized & (F.least("m1_a", "m1_b") >= F.col("low")))
        # members that share enough keys let their components meet under as many, each of a lower bound
        often = met.groupBy(*both).agg(F.count("*").alias("keys"), F.min("low").alias("least")).filter("keys >= least")
        met = met.join(often.select(*both, "keys"), both).filter("low <= keys")
    met = met.select("h", *both)
    wide = met.join(of(held, "a"), ["h", "comp_a"]).join(of(held, "b"), ["h", "comp_b"])
    need = rule.need(F.col("n_a"), F.col("w_a"), F.col("n_b"), F.col("w_b"))
    wide = wide.filter(rule.sizes(F.col("n_a"), F.col("n_b")) & (F.least("m_a", "m_b") >= need))
    pairs = wide.groupBy(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).agg(
        F.count("*").alias("shared"), F.min(need).alias("need")
    )
    return pairs.filter(F.col("shared") >= F.col("need")).select("a", "b")
