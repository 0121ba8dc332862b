"""Difficulty quartiles and curriculum phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.operators.quantiles import QUARTILES, attach_quantiles, exact_quantiles

CATEGORIES = ("Easy", "Medium-Easy", "Medium-Hard", "Hard")
STRATEGIES = ("progressive", "gradual", "mixed")


def add_difficulty(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Score difference, difficulty and its quartile category.

    Thresholds are exact quartiles of the difference per ``by`` group (the split, if
    there is one); lower bounds are inclusive, a missing difference counts as Hard.
    """
    if by is None:
        by = ["split"] if "split" in pairs.columns else []
    df = pairs.withColumn("norm_diff", F.abs(F.col("norm_response1") - F.col("norm_response2")))
    df = attach_quantiles(df.withColumn("difficulty_score", F.lit(1.0) - F.col("norm_diff")), "norm_diff", by)
    df = grade(df, {c: F.col(c) for c in QUARTILES})
    key = F.concat(
        F.col("difficulty_category"), F.lit("_"), F.col("item"), F.lit("_"), F.col("task")
    )
    return df.withColumn("stratify_key", key).drop("q25", "q50", "q75")


def grade(df: DataFrame, cuts: dict[str, Column]) -> DataFrame:
    """Difficulty score, level and category of ``norm_diff`` against its quartiles."""
    df = df.withColumn("difficulty_score", F.lit(1.0) - F.col("norm_diff"))
    d = F.when(~F.isnan("norm_diff"), F.col("norm_diff"))
    level = F.when(d >= cuts["q75"], 1).when(d >= cuts["q50"], 2).when(d >= cuts["q25"], 3)
    df = df.withColumn("difficulty_level", level.otherwise(4).cast("int"))
    category = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("difficulty_level"))
    return df.withColumn("difficulty_category", category)


def count_of(weight: str | None) -> Column:
    """How many pairs: rows, or the sum of the column that says for how many a row stands."""
    return F.count("*") if weight is None else F.sum(weight)


def add_phases(pairs: DataFrame, strategy: str = "progressive") -> DataFrame:
    """Curriculum phase per pair, or sampling weights per phase for ``mixed``."""
    level, score = F.col("difficulty_level"), F.col("difficulty_score")
    if strategy == "progressive":
        phase = F.when(level == 1, 1).when(level.isin(2, 3), 2).otherwise(3)
        return pairs.withColumn("curriculum_phase", phase)
    if strategy == "gradual":
        # fixed values: bin edges 0.33 and 0.67; score 0 falls into the first bin
        phase = F.when(score <= 0.33, 1).when(score <= 0.67, 2).otherwise(3)
        return pairs.withColumn("curriculum_phase", phase)
    if strategy == "mixed":
        return pairs.withColumns(
            {
                "curriculum_phase": F.lit(1),
                "phase1_weight": F.when(level == 1, 3).otherwise(1),
                "phase2_weight": F.when(level <= 2, 2).otherwise(1),
                "phase3_weight": F.lit(1),
            }
        )
    raise ValueError(f"unknown strategy {strategy!r}, expected one of {STRATEGIES}")


def share_of_total(counts: DataFrame, count: str = "n", by: list[str] | None = None) -> DataFrame:
    """Add ``pct``, the percentage of the (group) total, to a small count table."""
    by = list(by or [])
    if by:
        totals = counts.groupBy(*by).agg(F.sum(count).alias("_total"))
        joined = counts.join(totals, by)
        return joined.withColumn("pct", F.col(count) / F.col("_total") * 100).drop("_total")
    total = counts.select(F.sum(count)).scalar()
    return counts.withColumn("pct", F.col(count) / total * 100)


def difficulty_report(pairs: DataFrame, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Count, share of total and share of Equal winners per category.

    ``weight`` names the column with the number of pairs a row stands for (default: one).
    """
    by = list(by or [])
    each = F.lit(1) if weight is None else F.col(weight)
    equal = F.sum(F.when(F.col("winner") == "Equal", each).otherwise(0)).cast("double")
    counts = pairs.groupBy(*by, "difficulty_category").agg(
        count_of(weight).alias("n"), (equal / count_of(weight) * 100).alias("equal_pct"),
    )
    return share_of_total(counts, by=by)


def phase_report(pairs: DataFrame, weight: str | None = None) -> DataFrame:
    return share_of_total(pairs.groupBy("curriculum_phase").agg(count_of(weight).alias("n")))


def level_report(pairs: DataFrame, weight: str | None = None) -> DataFrame:
    return share_of_total(pairs.groupBy("difficulty_level").agg(count_of(weight).alias("n")))


def winner_report(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("winner").agg(F.count("*").alias("n"))


def norm_diff_stats(pairs: DataFrame) -> DataFrame:
    """Mean, median and quartiles of the score difference, one row."""
    quartiles = exact_quantiles(pairs, "norm_diff")
    mean = pairs.select(F.avg("norm_diff")).scalar()
    return quartiles.select(
        mean.alias("mean"), F.col("q50").alias("median"), F.col("q25"), F.col("q75")
    )


def curriculum_stats(pairs: DataFrame) -> dict[str, DataFrame]:
    """The statistics report as named tables."""
    out = {
        "total": pairs.agg(F.count("*").alias("n")),
        "difficulty": difficulty_report(pairs),
        "norm_diff": norm_diff_stats(pairs),
    }
    if "curriculum_phase" in pairs.columns:
        out["phases"] = phase_report(pairs)
    return out
