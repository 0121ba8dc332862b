"""Pair generation, random pairs, pair sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.functions.hashing import key_hash, order_number, uniform
from rankforge.functions.permutation import pair_of, permutation
from rankforge.functions.verdicts import winner_of
from rankforge.operators.columns import GROUP_KEYS, all_present, digest, require_columns
from rankforge.operators.ordering import lowest_by_hash, row_index
from rankforge.session import cut_lineage, measured, output_partitions

HOT_GROUP_ROWS = 20_000
BLOCK_ROWS = 4_000
PAIRS_PER_TASK = 1_000_000


def _pair_rows(df: DataFrame, keys: list[str], orientation: str | Column) -> DataFrame:
    """Rows that can pair, and the digest ``_g`` of their keys."""
    require_columns(df, ["ID", "response", "label", *keys])
    hashed = isinstance(orientation, str) and orientation == "hash"
    order = key_hash("ID") if hashed else orientation
    if isinstance(order, str):
        order = F.col(order)
    # leading 60 bits of the md5 as a number compare faster than the hex text
    number = order_number(order) if hashed else order
    rows = df.filter(all_present(keys)).select(
        *keys, digest(*keys).alias("_g"), number.alias("_ord"),
        F.coalesce(F.col("ID").cast("string"), F.lit("")).alias("id"),
        F.coalesce("response", F.lit("")).alias("response"),
        F.col("label").cast("double").alias("label"),
    )
    return rows


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("_c"))


def generate_pairs(
    df: DataFrame, keys: list[str] = GROUP_KEYS, orientation: str | Column = "hash",
    hot_group_rows: int = HOT_GROUP_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Every unordered pair of rows that agree on all (non-NULL) keys, once.

    The side that is smaller in the orientation order is response1: ``hash`` orders by
    the md5 of the id, a column or expression orders by that; id, response and label
    break ties. Rows equal in all of these are counted once and their pairs repeated, so
    recurring and NULL ids (shown as the empty id) lose no pair.

    The exchange carries the digest of the keys instead of their texts, and its number
    of partitions follows the number of pairs to come, not the size of the input. Rows move
    once, and only hashes of them before, to count the pairs. A group above
    ``hot_group_rows`` is cut into blocks; its rows are copied once per partner block,
    so that the join key (group, left block, right block) spreads one group over
    blocks**2 tasks. The output is the same with or without blocks.
    """
    rows = _pair_rows(df, keys, orientation)
    # a hash stands for a row: equal hashes only say that rows may recur
    slim = rows.select(F.unhex("_g").alias("_g"), F.xxhash64(*[c for c in rows.columns if c != "label"]).alias("_x"))
    slim = slim.groupBy("_g", "_x").agg(F.count("*").alias("_c"))
    sizes = slim.groupBy("_g").agg(F.sum("_c").alias("_n"), F.max("_c").alias("_most"))
    total, largest, most = sizes.agg(
        F.sum(F.col("_n").cast("double") * (F.col("_n") - 1) / 2), F.max("_n"), F.max("_most")
    ).first()
    parts = output_partitions(df.sparkSession, total or 0, PAIRS_PER_TASK)
    hot_groups = (largest or 0) > hot_group_rows
    # dealt by group, rows are counted and meet where they lie; the join reads one exchange twice
    rows = _counted(rows if hot_groups else rows.repartition(parts, "_g"))
    on = ["_g"]
    right_cols = ["_g", "_ord", "id", "response", "label", "_c"]
    left, right = rows, rows.select(*right_cols)
    if hot_groups:
        hot = measured(
            sizes.filter(F.col("_n") > hot_group_rows)
            .select(F.lower(F.hex("_g")).alias("_g"), F.ceil(F.col("_n") / block_rows).cast("int").alias("_blocks"))
        )
        on = ["_g", "_lb", "_rb"]
        blocks = F.coalesce("_blocks", F.lit(1))
        marked = rows.join(hot, "_g", "left").withColumn("_blocks", blocks).withColumn(
            "_own", F.floor(uniform(key_hash("id", seed="block")) * F.col("_blocks")).cast("int")
        )
        other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
        left = marked.withColumn("_rb", other).withColumnRenamed("_own", "_lb")
        right = marked.withColumn("_lb", other).withColumnRenamed("_own", "_rb").select(
            *on, *right_cols[1:]
        )
    a = left.select(
        *keys, *on, F.col("_ord").alias("_o1"), F.col("response").alias("response1"),
        F.col("id").alias("response1_id"), F.col("label").alias("norm_response1"), F.col("_c").alias("_c1"),
    )
    b = right.select(
        *on, F.col("_ord").alias("_o2"), F.col("response").alias("response2"),
        F.col("id").alias("response2_id"), F.col("label").alias("norm_response2"), F.col("_c").alias("_c2"),
    )
    if hot_groups:
        a, b = a.repartition(parts, *on), b.repartition(parts, *on)
    matched = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in on]
    # the order decides at once where it can; else the structs, which order NULLs too
    apart = F.coalesce(F.col("_o1") != F.col("_o2"), F.lit(False))
    full = [
        F.struct(f"_o{i}", f"response{i}_id", f"response{i}", f"norm_response{i}") for i in (1, 2)
    ]
    tied = ~apart & (full[0] < full[1])
    first = F.coalesce(F.col("_o1") < F.col("_o2"), F.lit(False))
    if (most or 0) > 1:
        same = (full[0] == full[1]) & (F.col("_c1") > 1)
        pairs = a.alias("l").join(b.alias("r"), matched + [first | tied | same])
        own = (F.col("_c1") * (F.col("_c1") - 1) / 2).cast("bigint")
        times = F.when(same, own).otherwise(F.col("_c1") * F.col("_c2"))
        pairs = pairs.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), times)))
    else:
        pairs = a.alias("l").join(b.alias("r"), matched + [first | tied])
    return pairs.select(
        *keys, "response1", "response2", "response1_id", "response2_id", "norm_response1",
        "norm_response2",
    ).withColumn("winner", winner_of(F.col("norm_response1"), F.col("norm_response2")))


def group_sizes(df: DataFrame, keys: list[str] = GROUP_KEYS) -> DataFrame:
    """Rows per group with non-NULL keys."""
    return df.filter(all_present(keys)).groupBy(*keys).agg(F.count("*").alias("n"))


def size_histogram(df: DataFrame, keys: list[str] = GROUP_KEYS) -> DataFrame:
    """How many groups have n rows. Has at most sqrt(2 * rows) rows itself."""
    sizes = df.filter(all_present(keys)).groupBy(digest(*keys).alias("_g")).agg(
        F.count("*").alias("n")
    )
    return sizes.groupBy("n").agg(F.count("*").alias("groups"))


#: Draws of one group and round that a task makes at a time.
DRAWS_PER_RUN = 100_000


def draw_pairs(
    items: DataFrame, rounds: int, num_pairs: int | None = None, by: list[str] | None = None,
    seed: int = 42, key: str = "response_id", first_round: int = 0,
) -> DataFrame:
    """Random distinct pairs of each round: ``by``, round, pair_in_round, response1_id, response2_id.

    A round takes ``num_pairs`` unordered pairs of every group (default: half as many as
    it has items), all of them where there are fewer. The pairs of a group are numbered,
    never enumerated: draw d of a round is pair number p(d) under the permutation that
    group, round and seed name. So draws cannot collide, each stands alone, and the work is
    that of the pairs drawn, whatever their share of all pairs. Items need distinct ids
    within a group; groups of one item have no pairs.
    """
    by = list(by or [])
    indexed = row_index(items.select(*by, key), [key], by, name="_i")
    sizes = indexed.groupBy(*by).agg(F.count("*").alias("_n"))
    possible = F.shiftright(F.col("_n") * (F.col("_n") - 1), 1)
    wanted = F.lit(num_pairs).cast("bigint") if num_pairs is not None else F.floor(F.col("_n") / 2)
    orders = sizes.select(
        *by, F.col("_n"), possible.alias("_all"), F.least(wanted, possible).alias("_m"),
        F.explode(F.sequence(F.lit(first_round), F.lit(first_round + rounds - 1))).alias("round"),
    ).filter(F.col("_m") > 0)
    # a large order is dealt over tasks in runs before it is written out
    runs = orders.withColumn("_run", F.explode(F.sequence(F.lit(0), F.floor((F.col("_m") - 1) / DRAWS_PER_RUN))))
    # an explicit number: runs are small before they are written out, and would be merged into one task
    runs = runs.repartition(output_partitions(items.sparkSession, 0, 1), *by, "round", "_run")
    start = (F.col("_run") * DRAWS_PER_RUN).cast("bigint")
    draws = runs.withColumn(
        "pair_in_round", F.explode(F.sequence(start, F.least(start + DRAWS_PER_RUN, F.col("_m")) - 1))
    )
    named = order_number(key_hash(*by, "round", seed=seed))
    numbered = draws.withColumn("_k", permutation(F.col("pair_in_round"), F.col("_all"), named))
    low, high = pair_of(F.col("_k"))
    pairs = numbered.select(*by, "round", "pair_in_round", low.alias("_lo"), high.alias("_hi"))
    # the planner knows a run by its single row and would broadcast all draws as a small table
    for column, side in (("_lo", "response1_id"), ("_hi", "response2_id")):
        names = indexed.select(*by, F.col("_i").alias(column), F.col(key).alias(side))
        pairs = pairs.hint("merge").join(names, [*by, column])
    return pairs.select(*by, "round", "pair_in_round", "response1_id", "response2_id")


def random_pairs(
    items: DataFrame, num_pairs: int, seed: int = 42, round_number: int = 0,
    key: str = "response_id",
) -> DataFrame:
    """``num_pairs`` distinct unordered pairs of items, one round of ``draw_pairs``.

    More than there are is an error.
    """
    items = cut_lineage(items.select(key))
    n = items.count()
    possible = n * (n - 1) // 2
    if num_pairs > possible:
        raise ValueError(f"{num_pairs} pairs wanted, only {possible} exist")
    return draw_pairs(items, 1, num_pairs, seed=seed, key=key, first_round=round_number)


def sample_pairs(
    pairs: DataFrame, max_samples: int, ratios: tuple[float, float, float] = (0.7, 0.1, 0.2),
    seed: int = 42,
) -> DataFrame:
    """Stratified pair sample under a total budget, untouched if already small.

    Each split over its target gives every (item, task) its proportional share, at
    least one pair; if the floors overshoot, the split is cut to the target. Draws go
    by keyed hash of the two ids, so the sample is the same on any partitioning.
    """
    targets = [int(max_samples * ratios[0]), int(max_samples * ratios[1])]
    targets.append(max_samples - sum(targets))
    by_split = {"train": targets[0], "val": targets[1], "test": targets[2]}
    target = F.lit(None).cast("bigint")
    for name, size in by_split.items():
        target = F.when(F.col("split") == name, F.lit(size).cast("bigint")).otherwise(target)
    strata = measured(pairs.groupBy("split", "item", "task").agg(F.count("*").alias("n")))
    splits = strata.groupBy("split").agg(F.sum("n").alias("split_n"))
    if splits.agg(F.coalesce(F.sum("split_n"), F.lit(0))).first()[0] <= max_samples:
        return pairs
    share = F.floor(target.cast("double") * (F.col("n") / F.col("split_n")))
    quota = F.when(
        F.col("split_n") <= target, F.col("n")
    ).otherwise(F.least(F.col("n"), F.greatest(F.lit(1), share)))
    quotas = strata.join(splits, "split").select(
        "split", "item", "task", quota.cast("bigint").alias("q")
    )
    h = key_hash("response1_id", "response2_id", seed=seed)
    tie = F.concat_ws("_", "response1_id", "response2_id")
    drawn = lowest_by_hash(pairs, ["split", "item", "task"], quotas, "q", h, tie)
    final = quotas.groupBy("split").agg(
        F.least(F.sum("q"), F.first(target)).cast("bigint").alias("q"), F.sum("q").alias("_all")
    )
    over = final.filter(F.col("_all") > F.col("q")).limit(1).count()
    if not over:
        return drawn
    return lowest_by_hash(drawn, ["split"], final.drop("_all"), "q", h, tie)


def paired_items(
    df: DataFrame, keys: list[str] = GROUP_KEYS, orientation: str | Column = "hash", by: list[str] = ["item"],
) -> DataFrame:
    """``first_occurrence_items(generate_pairs(df, keys, orientation), by)`` without making the pairs.

    A row is in a pair if its group has another one. It stands first in one unless it is the
    last of its group in the order of pairing. So the work follows the rows. ``by`` is a part
    of ``keys``.
    """
    rows = _counted(_pair_rows(df, keys, orientation))
    place = F.struct("_ord", "id", "response", "label")
    groups = rows.groupBy("_g").agg(F.max(place).alias("_high"), F.sum("_c").alias("_n")).filter(F.col("_n") > 1)
    first = (place < F.col("_high")) | (F.col("_c") > 1)
    rest = [c for c in ("item", "task", "prompt") if c not in by and c in keys]
    described = F.struct(
        F.when(first, 1).otherwise(2).alias("side"), *rest, "response", F.col("label").alias("norm_response")
    )
    chosen = rows.join(groups, "_g").select(*by, F.col("id").alias("response_id"), described.alias("_r"))
    return chosen.groupBy(*by, "response_id").agg(F.min("_r").alias("_r")).select(*by, "response_id", "_r.*").drop("side")


def first_occurrence_items(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Item table of a pair table: one row per response id (within ``by``).

    The response1 side goes before the response2 side, then the smaller texts decide.
    A distinct comes first: it runs as a hash aggregation before the shuffle, so an id
    that occurs in very many pairs leaves each task once, unsorted.
    """
    keys = list(by if by is not None else [c for c in ("dataset", "item") if c in pairs.columns])

    def side(number: int) -> DataFrame:
        rest = [c for c in ("item", "task", "prompt") if c not in keys and c in pairs.columns]
        return pairs.select(
            *keys, F.col(f"response{number}_id").alias("response_id"),
            F.struct(
                F.lit(number).alias("side"), *rest,
                F.col(f"response{number}").alias("response"),
                F.col(f"norm_response{number}").alias("norm_response"),
            ).alias("_r"),
        )

    both = side(1).unionByName(side(2)).distinct()
    first = both.groupBy(*keys, "response_id").agg(F.min("_r").alias("_r"))
    return first.select(*keys, "response_id", "_r.*").drop("side")

