"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame expressions.

A source's documents all get the same fractional number of copies. The whole part is
taken as it is; the fractions meet in pairs, and a pair moves words from one to the other
in a random direction until one fraction is 0 or 1, so that the words expected from the
pair never change and every document keeps its inclusion probability. What is left of a
pair goes on: inside a chunk of bounded length first, then the residuals of the chunks
form the items of the next level, a reduction tree whose depth is the logarithm of the
documents of the largest source. A source ends within one document of its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankforge.operators.ordering import row_index
from rankforge.session import write_scratch

#: Items that meet in one fold; the collected arrays are never longer.
CHUNK = 64
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sized: DataFrame, share: float, weights: tuple[int, ...], limit: float) -> DataFrame:
    """Per source: source, source_size, target (double), rank by code point (null last).

    The targets share ``share`` times all words by weight; a target stops at ``limit``
    times its source's size and its excess goes to the others by weight. The fixed point
    is min(limit * size, level * weight) with one level, which lies between two
    neighbours in the order of limit * size / weight. One row per source.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sums.withColumn("rank", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.get(kinds, F.col("rank") % len(weights)))
    ranked = ranked.withColumn("cap", F.lit(float(limit)) * F.col("source_size"))
    filled = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), "rank")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    budget = F.lit(float(share)) * F.sum("source_size").over(whole)
    left = budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levelled = ranked.withColumn("level", left / weight_left)
    # the first source whose cap is not reached fixes the level; if all are full, no level binds
    open_level = F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level"))
    levelled = levelled.withColumn("bound", F.first(open_level, ignorenulls=True).over(filled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.coalesce(F.least(F.col("cap"), F.col("bound") * F.col("weight")), F.col("cap"))
    return levelled.select("source", "source_size", target.alias("target"), "rank")


def _chance(seed: int, *parts: Column) -> Column:
    """Uniform in [0, 1) by the parts alone, whatever the partitioning."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11) / F.lit(float(1 << 53))


def _settle(held: Column, new: Column, seed: int, level: int) -> Column:
    """One pair: the item that becomes integral joins ``out``, the other is held on.

    Moving up gives words of ``new`` to ``held``; each direction is as likely as the
    other one is long, so no expectation changes.
    """
    up = F.least((1 - held["p"]) * held["size"], new["p"] * new["size"])
    down = F.least(held["p"] * held["size"], (1 - new["p"]) * new["size"])
    rises = _chance(seed, held["h"], new["h"], F.lit(level)) * (up + down) < down
    held_first = F.when(rises, (1 - held["p"]) * held["size"] <= new["p"] * new["size"]).otherwise(
        held["p"] * held["size"] <= (1 - new["p"]) * new["size"]
    )
    moved = F.when(rises, up).otherwise(-down)

    def item(x: Column, words: Column) -> Column:
        share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), x["p"] + words / x["size"]))
        return F.struct(x["h"].alias("h"), x["rid"].alias("rid"), x["size"].alias("size"), share.alias("p"))

    settled = F.when(held_first, F.struct(held["rid"].alias("rid"), rises.cast("int").alias("extra"))).otherwise(
        F.struct(new["rid"].alias("rid"), (~rises).cast("int").alias("extra"))
    )
    left = F.when(held_first, item(new, -moved)).otherwise(item(held, moved))
    return F.struct(
        left["h"].alias("h"), left["rid"].alias("rid"), left["size"].alias("size"), left["p"].alias("p"),
        F.array_append(held["out"], settled).alias("out"),
    )


def _round_chunks(items: DataFrame, seed: int, level: int) -> DataFrame:
    """One level of the tree: (rank, at, h, rid, size, p, out) per chunk of items (rank, at, ...)."""
    chunk = F.floor(F.col("at") / CHUNK)
    rows = items.groupBy("rank", chunk.alias("at")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("at").alias("i"), "h", "rid", "size", "p"))).alias("rows")
    )
    first = F.get("rows", F.lit(0))
    nothing = F.array().cast("array<struct<rid:bigint,extra:int>>")
    start = F.struct(*[first[c].alias(c) for c in ("h", "rid", "size", "p")], nothing.alias("out"))
    rest = F.slice("rows", F.lit(2), F.size("rows"))
    folded = F.aggregate(rest, start, lambda held, new: _settle(held, new, seed, level))
    return rows.select("rank", "at", folded.alias("f")).select("rank", "at", "f.*")


def mix_sources(
    docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (3, 1, 2), limit: float = 2.0, seed: int = 42
) -> DataFrame:
    """Per row of ``docs`` (doc_id, source, text): doc_id, digest, size, source_size, target,
    copies (int), taken (bigint, copies * size).

    Size is the number of words, 0 for a null text. Sources are weighted in code point
    order, a null source last, by repeating ``weights``; see ``source_targets``. A
    document of size 0 gets the whole part of the copies only. Decisions depend on the
    seed, doc_id and text, not on partitions; rows alike in both are interchangeable.
    ``digest`` is the hash of doc_id and text. An empty table gives an empty result.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    digest = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    sized = docs.select("doc_id", "source", size.alias("size"), digest.alias("digest"))
    sized, _ = write_scratch(sized.withColumn("rid", F.monotonically_increasing_id()), "sizes")
    targets, _ = write_scratch(source_targets(sized, share, weights, limit), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    rated = rated.withColumn("whole", F.floor(rate).cast("int")).withColumn("p", rate - F.floor(rate))
    rated, _ = write_scratch(rated, "rated")

    h = F.xxhash64(F.lit(seed), "digest")
    items = rated.filter((F.col("size") > 0) & (F.col("p") > 0)).select(
        "rank", h.alias("h"), F.col("rid"), F.col("digest").alias("tie"), F.col("size").cast("double").alias("size"), "p"
    )
    items = row_index(items, ["h", "tie"], by=["rank"], name="at").drop("tie")
    most = items.groupBy("rank").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    settled, level = [], 0
    while most and (most > 1 or not level):
        folded, _ = write_scratch(_round_chunks(items, seed, level), "residuals")
        settled.append(folded.select(F.inline("out")))
        items, most, level = folded.drop("out"), -(-most // CHUNK), level + 1
    last = (_chance(seed, F.col("h"), F.lit(-1)) < F.col("p")).cast("int")
    extra = items.select("rid", last.alias("extra"))
    for part in settled:
        extra = extra.union(part)
    out = rated.join(extra, "rid", "left")
    copies = F.col("whole") + F.coalesce("extra", F.lit(0))
    return out.select(
        "doc_id", "digest", "size", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"),
    )


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix_sources`` says."""
    counted = mix_sources(docs, **parameters).filter("copies > 0").groupBy("digest").agg(F.sort_array(F.collect_list("copies"), asc=False).alias("each"))
    rows = docs.select(F.struct(*docs.columns).alias("whole_row"), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("digest"))
    # rows alike in doc_id and text share out their decisions by number
    alike = Window.partitionBy("digest").orderBy(F.lit(0))
    met = rows.withColumn("nr", F.row_number().over(alike)).join(counted, "digest")
    times = F.coalesce(F.get("each", F.col("nr") - 1), F.lit(0))
    return met.filter(times > 0).select("whole_row", F.explode(F.sequence(F.lit(1), times))).select("whole_row.*")
