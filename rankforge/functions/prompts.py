"""Comparison prompts and response texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col_or(df: DataFrame, name: str, default: str) -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


def response_text(
    prefix: str = "", connector1: str = ": ", connector2: str = "\n", with_task: bool = True
) -> Column:
    """Model input of one response; only the response is lower-cased. NULL if a part is."""
    head = [F.lit(prefix), F.col("task"), F.lit(connector1)] if with_task else [F.lit(prefix)]
    return F.concat(*head, F.col("prompt"), F.lit(connector2), F.lower("response"))


def pair_prompt(df: DataFrame) -> Column:
    """``task: prompt / A: .. / B: ..`` with defaults for absent columns and values."""
    return F.concat(
        _col_or(df, "task", "Unknown Task"), F.lit(": "), _col_or(df, "prompt", ""),
        F.lit("\nA: "), _col_or(df, "response1", ""), F.lit("\nB: "), _col_or(df, "response2", ""),
    )


def item_prompt(pairs: DataFrame, items: DataFrame, key: str = "response_id") -> DataFrame:
    """Prompt of id pairs whose texts live in an item table; task and prompt come from side A."""
    a = items.select(
        F.col(key).alias("response1_id"), F.col("task"), F.col("prompt"),
        F.col("response").alias("response1"),
    )
    b = items.select(F.col(key).alias("response2_id"), F.col("response").alias("response2"))
    drop = [c for c in ("task", "prompt", "response1", "response2") if c in pairs.columns]
    joined = pairs.drop(*drop).join(a, "response1_id").join(b, "response2_id")
    text = F.concat(
        F.coalesce("task", F.lit("Unknown Task")), F.lit(": "),
        F.coalesce("prompt", F.lit("No prompt provided")),
        F.lit("\nA: "), F.coalesce("response1", F.lit("")),
        F.lit("\nB: "), F.coalesce("response2", F.lit("")),
    )
    return joined.withColumn("prompt_text", text)


def instruction_prompt() -> Column:
    """The longer instruction form with a closing question."""
    # fixed value: the closing question of the instruction form
    question = "Which response is more scientifically possible and provable with a hypothesis?"
    return F.concat(
        F.lit("Task: "), F.col("task"), F.lit("\nDescription: "), F.col("prompt"),
        F.lit("\n\nResponse A: "), F.col("response1"), F.lit("\nResponse B: "), F.col("response2"),
        F.lit(f"\n\n{question}"),
    )
