"""Distributed union-find: connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.session import drop_scratch, write_scratch

#: Tasks of a step follow the links that are left, not the partitions of larger steps.
LINKS_PER_TASK = 100_000


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link; the component is its smallest node.

    Alternating large-star and small-star steps: each step hangs neighbours below the
    smallest one they know of, which halves paths instead of walking them, and a hub is
    only ever a key of a minimum (combined before the shuffle) and of a join with one
    row on the other side (split by AQE). Links may repeat, point either way and join a
    node to itself; a null end is ignored. Every round is written to the shared folder
    and the round before it deleted. Without links the result is empty.
    """
    spark = links.sparkSession
    start = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    start = start.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    edges, path = write_scratch(start, "links")
    while (tasks := _open(edges)) is not None:
        following, next_path = write_scratch(_small_star(_large_star(edges, tasks), tasks), "links")
        drop_scratch(spark, path)
        edges, path = following, next_path
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.distinct())


def _open(edges: DataFrame) -> int | None:
    """None if every node hangs below one root; else tasks for the next step, by the links."""
    total, most = edges.groupBy("u").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.max("n")).first()
    tasks = -(-total // LINKS_PER_TASK)
    if not total:
        return None
    if most == 1 and not edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
        return None
    return tasks


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Hang every larger neighbour of a node below the smallest node of its neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")).coalesce(tasks)
    moved = both.filter(F.col("v") > F.col("u")).join(low, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(tasks)


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Hang a node and its smaller neighbours below the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
    moved = edges.join(low, "u").filter(F.col("v") != F.col("m"))
    own = low.select("u", F.col("m").alias("v"))
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(own).distinct().coalesce(tasks)
