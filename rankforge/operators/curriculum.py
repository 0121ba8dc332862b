"""Epoch subsets, level filters, schedules and training-set materialisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.functions.hashing import key_hash
from rankforge.functions.prompts import instruction_prompt, pair_prompt
from rankforge.functions.verdicts import encode_label
from rankforge.operators.columns import require_columns
from rankforge.operators.ordering import lowest_by_hash

LEVELS_OF_PHASE = {1: [1], 2: [1, 2], 3: [1, 2, 3, 4]}


def max_phase_of_epoch(epoch: int, total_epochs: int) -> int:
    """Progressive plan: first 40 % of epochs phase 1, up to 70 % phase 2, then all."""
    if epoch <= total_epochs * 0.4:
        return 1
    return 2 if epoch <= total_epochs * 0.7 else 3


def epoch_subset(
    pairs: DataFrame, epoch: int, total_epochs: int = 10, strategy: str = "progressive"
) -> DataFrame:
    """Rows that train in one (1-based) epoch. Unknown strategies keep all rows."""
    if strategy == "progressive":
        return pairs.filter(F.col("curriculum_phase") <= max_phase_of_epoch(epoch, total_epochs))
    if strategy == "gradual":
        top = pairs.select(F.max("difficulty_score")).scalar()
        return pairs.filter(F.col("difficulty_score") <= F.lit(epoch / total_epochs) * top)
    return pairs


def level_filter(pairs: DataFrame, phase: int) -> DataFrame:
    """Cumulative difficulty filter: phase 1 easy, 2 adds medium-easy, 3 all."""
    if phase not in LEVELS_OF_PHASE:
        raise ValueError(f"invalid curriculum phase: {phase}, must be 1, 2 or 3")
    if phase == 3:
        return pairs
    return pairs.filter(F.col("difficulty_level").isin(LEVELS_OF_PHASE[phase]))


def phase_schedule(spark: SparkSession, total_epochs: int) -> DataFrame:
    """(epoch, phase): a third of the epochs each, the remainder in phase 3."""
    third = total_epochs // 3
    epochs = spark.range(1, total_epochs + 1).select(F.col("id").cast("int").alias("epoch"))
    phase = F.when(F.col("epoch") <= third, 1).when(F.col("epoch") <= 2 * third, 2).otherwise(3)
    return epochs.withColumn("phase", phase)


def _epochs_of(total_epochs: int, column: Column, limit_of) -> Column:
    epochs = F.array(
        *[
            F.struct(F.lit(e).alias("epoch"), F.lit(limit_of(e)).alias("limit"))
            for e in range(1, total_epochs + 1)
        ]
    )
    return F.filter(epochs, lambda e: column <= e["limit"])


def expand_epochs(pairs: DataFrame, total_epochs: int, plan: str = "progressive") -> DataFrame:
    """One row per (pair, epoch in which it trains), without a join.

    ``progressive`` uses the 40 / 70 % phase plan, ``schedule`` the level filter of
    the phase that the thirds schedule gives the epoch.
    """
    if plan == "progressive":
        hits = _epochs_of(
            total_epochs, F.col("curriculum_phase"), lambda e: max_phase_of_epoch(e, total_epochs)
        )
    else:
        third = total_epochs // 3

        def top_level(e: int) -> int:
            return max(LEVELS_OF_PHASE[1 if e <= third else 2 if e <= 2 * third else 3])

        hits = _epochs_of(total_epochs, F.col("difficulty_level"), top_level)
    return pairs.withColumn("_e", F.explode(hits)).withColumn("epoch", F.col("_e.epoch")).drop("_e")


def sample_rows(df: DataFrame, n: int, key: list[str], seed: int = 42) -> DataFrame:
    """Exactly n rows (all, if fewer), drawn by keyed hash of a unique key."""
    quotas = df.sparkSession.range(1).select(F.lit(0).alias("_all"), F.lit(n).cast("bigint").alias("_q"))
    tie = F.concat_ws("_", *[F.col(c).cast("string") for c in key])
    marked = df.withColumn("_all", F.lit(0))
    return lowest_by_hash(marked, ["_all"], quotas, "_q", key_hash(*key, seed=seed), tie).drop("_all")


def training_set(
    pairs: DataFrame, phase: int | None = None, template: str = "pair",
    max_rows: int | None = None, seed: int = 42,
) -> DataFrame:
    """Prompt text and label id per row, after level filter and optional row budget."""
    require_columns(pairs, ["task", "prompt", "response1", "response2", "winner"])
    if phase is not None:
        require_columns(pairs, ["difficulty_level"])
        pairs = level_filter(pairs, phase)
    if max_rows is not None:
        pairs = sample_rows(pairs, max_rows, ["response1_id", "response2_id"], seed)
    text = pair_prompt(pairs) if template == "pair" else instruction_prompt()
    carry = [c for c in ("split", "response1_id", "response2_id") if c in pairs.columns]
    return pairs.select(*carry, text.alias("text"), encode_label(F.col("winner")).alias("label"))
