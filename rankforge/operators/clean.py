"""Cleaning: duplicate averaging, score shift and scaling, response text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.functions.prompts import response_text
from rankforge.operators.columns import (
    GROUP_KEYS, all_present, digest, keep_present, number_or_null, require_columns,
)

DUP_KEYS = GROUP_KEYS + ["response"]
ID_COLUMNS = ["study_id", "sub_id", "response_id", "ID"]
DUP_ID = "dupe_average"


def duplicate_rows(df: DataFrame, keys: list[str] = DUP_KEYS) -> DataFrame:
    """Rows whose keys occur more than once (all copies).

    Counted by digest with map-side combine, so one heavily repeated response never
    has to fit a window; the repeated digests come back by semi join.
    """
    marked = df.withColumn("_d", digest(*keys))
    repeated = marked.groupBy("_d").agg(F.count("*").alias("_n")).filter("_n > 1")
    return marked.join(repeated, "_d", "left_semi").drop("_d")


def average_duplicates(
    df: DataFrame, keys: list[str] = DUP_KEYS, score: str = "jrt", legacy_dup_id: bool = False
) -> DataFrame:
    """Replace rows sharing all keys by one row with the mean score.

    A single aggregation serves both cases: for a key that occurs once, min and mean
    return the row itself. Repeated keys with a NULL part vanish. The new id is unique
    per key; ``legacy_dup_id`` gives all averaged rows the same bare id instead.
    """
    require_columns(df, keys + [score])
    ids = [c for c in ID_COLUMNS if c in df.columns]
    grouped = df.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        F.avg(number_or_null(F.col(score).cast("double"))).alias(score),
        *[F.min(c).alias(c) for c in ids],
    )
    dup_id = F.lit(DUP_ID)
    if not legacy_dup_id:
        dup_id = F.concat(dup_id, F.lit(":"), digest(*keys))
    once = F.col("_n") == 1
    renamed = {c: F.when(once, F.col(c).cast("string")).otherwise(dup_id) for c in ids}
    return grouped.filter(once | all_present(keys)).withColumns(renamed).drop("_n")


def score_means(df: DataFrame, keys: list[str] = DUP_KEYS, score: str = "jrt") -> DataFrame:
    """Only the averaged scores, grouped by key digest: the cheap input of the scaler."""
    nulls = ~all_present(keys)
    grouped = df.groupBy(digest(*keys).alias("_d")).agg(
        F.count("*").alias("_n"),
        F.max(nulls).alias("_null"),
        F.avg(number_or_null(F.col(score).cast("double"))).alias(score),
    )
    return grouped.filter((F.col("_n") == 1) | ~F.col("_null")).select(score)


def fit_scaler(df: DataFrame, score: str = "jrt", shift: bool = True) -> DataFrame:
    """One-row table (data_min, data_max), by default of ``score + abs(min(score))``."""
    low, high = F.min(number_or_null(F.col(score))), F.max(number_or_null(F.col(score)))
    add = F.abs(low) if shift else F.lit(0.0)
    return df.agg((low + add).alias("data_min"), (high + add).alias("data_max"))


def shift_scores(df: DataFrame, low_of: DataFrame | None = None, score: str = "jrt") -> DataFrame:
    """Add ``abs(min(score))`` to the score; the minimum is a scalar subquery."""
    source = df if low_of is None else low_of
    low = source.select(F.min(number_or_null(F.col(score)))).scalar()
    return df.withColumn(score, F.col(score) + F.abs(low))


def apply_scaler(df: DataFrame, scaler: DataFrame, score: str = "jrt", out: str = "label") -> DataFrame:
    """Min-max transform by fitted parameters. Not clipped; a constant fit gives 0."""
    fit = scaler.select(F.struct("data_min", "data_max")).scalar()
    span = fit["data_max"] - fit["data_min"]
    return df.withColumn(
        out, F.when(span == 0, F.lit(0.0)).otherwise((F.col(score) - fit["data_min"]) / span)
    )


def drop_missing(df: DataFrame) -> DataFrame:
    """Drop rows with any NULL or NaN."""
    return df.na.drop("any")


def clean_responses(
    df: DataFrame, prefix: str = "", connector1: str = ": ", connector2: str = "\n",
    legacy_dup_id: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Cleaned responses and the fitted scaler.

    Order matters and is kept: average duplicates, build text, shift, fit, scale, and
    only then drop incomplete rows (which therefore still influence the scaler).
    """
    require_columns(df, ["ID", *DUP_KEYS, "jrt"])
    means = score_means(df)
    scaler = fit_scaler(means)
    out = average_duplicates(df, legacy_dup_id=legacy_dup_id)
    out = out.withColumn("text", response_text(prefix, connector1, connector2))
    out = apply_scaler(shift_scores(out, means), scaler)
    out = out.select("ID", *GROUP_KEYS, "response", "jrt", "text", "label")
    return drop_missing(out), scaler


def clean_holdout(
    df: DataFrame, scaler: DataFrame | None, prefix: str = "", connector1: str = ": ",
    connector2: str = "\n",
) -> DataFrame:
    """Clean a second dataset with the scaler of the first.

    Text is built with the task, without it, or kept, depending on the columns there.
    Raw scores are shifted by their own minimum, so labels can leave [0, 1].
    """
    if "task" in df.columns:
        df = df.withColumn("text", response_text(prefix, connector1, connector2))
    elif "text" not in df.columns:
        df = df.withColumn("text", response_text(prefix, connector1, connector2, with_task=False))
    if "jrt" in df.columns:
        if scaler is None:
            raise ValueError("raw scores need a fitted scaler")
        df = apply_scaler(shift_scores(df), scaler)
    if "ID" not in df.columns:
        parts = [F.col("study_id").cast("string"), F.lit("-"), F.col("response_id").cast("string")]
        df = df.withColumn("ID", F.concat(*parts))
    wanted = ["ID", *GROUP_KEYS, "response", "text", "label"]
    return drop_missing(keep_present(df, wanted))


def holdout_pairs(cleaned: DataFrame, **options) -> DataFrame:
    """Pairs with difficulty of the cleaned holdout; a missing task becomes 'holdout'."""
    from rankforge.operators.difficulty import add_difficulty
    from rankforge.operators.pairs import generate_pairs

    pairs = generate_pairs(_with_task(cleaned), **options).withColumn("split", F.lit("holdout"))
    return add_difficulty(pairs, by=[])


def _with_task(cleaned: DataFrame) -> DataFrame:
    return cleaned if "task" in cleaned.columns else cleaned.withColumn("task", F.lit("holdout"))


def holdout_classes(cleaned: DataFrame) -> DataFrame:
    """The same pairs, counted: a row per task and class of difficulty, for ``n`` pairs."""
    from rankforge.operators.pair_counts import PairCounts

    counts = PairCounts(_with_task(cleaned), by=["task"])
    if counts.infinite:  # their differences are not numbers
        return holdout_pairs(cleaned).withColumn("n", F.lit(1).cast("bigint"))
    return counts.graded().withColumn("split", F.lit("holdout"))
