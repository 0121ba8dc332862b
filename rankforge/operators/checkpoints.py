"""Checkpoint registry, per-checkpoint metrics, summary and best checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.functions.verdicts import checkpoint_step
from rankforge.operators.evaluate import pearson

# The default step range.
FIRST_STEP, LAST_STEP = 30000, 43752


def valid_checkpoints(
    names: DataFrame, column: str = "checkpoint", first: int = FIRST_STEP, last: int = LAST_STEP
) -> DataFrame:
    """Checkpoints with a parsable step in range; malformed names are dropped."""
    steps = names.withColumn("steps", checkpoint_step(F.col(column)))
    return steps.filter(F.col("steps").between(first, last))


def checkpoint_metrics(predictions: DataFrame) -> DataFrame:
    """Accuracy and Pearson r of class ids per (checkpoint, split); undefined r is 0.

    Expects ``peft_model_id, steps, split, predictions, ratings``.
    """
    p, t = F.col("predictions").cast("double"), F.col("ratings").cast("double")
    return predictions.groupBy("peft_model_id", "steps", "split").agg(
        F.count("*").alias("n"), F.avg((p == t).cast("double")).alias("accuracy"),
        F.coalesce(pearson(t, p), F.lit(0.0)).alias("pearson"),
    )


def prediction_table(predictions: DataFrame) -> DataFrame:
    """Long prediction rows with the metrics of their (checkpoint, split) repeated."""
    metrics = checkpoint_metrics(predictions).drop("n")
    bare = predictions.drop("accuracy", "pearson")
    return bare.join(metrics, ["peft_model_id", "steps", "split"])


def checkpoint_summary(metrics: DataFrame) -> DataFrame:
    """Validation and test side by side; checkpoints lacking either are dropped.

    Reads a metric table or long predictions with repeated metrics alike: the values
    are constant per (checkpoint, split), so any one of them serves.
    """

    def one(split: str, value: str):
        return F.max(F.when(F.col("split") == split, F.col(value)))

    wide = metrics.groupBy(F.col("peft_model_id").alias("checkpoint")).agg(
        F.max("steps").alias("steps"),
        one("validation", "accuracy").alias("val_accuracy"),
        one("validation", "pearson").alias("val_pearson"),
        one("test", "accuracy").alias("test_accuracy"),
        one("test", "pearson").alias("test_pearson"),
        (F.count_if(F.col("split") == "validation") > 0).alias("_v"),
        (F.count_if(F.col("split") == "test") > 0).alias("_t"),
    )
    return wide.filter("_v and _t").drop("_v", "_t").orderBy(
        F.desc_nulls_last("val_accuracy"), "steps"
    )


def best_checkpoint(summary: DataFrame) -> DataFrame:
    """The row with the best validation accuracy; the earlier step wins a tie."""
    return summary.orderBy(F.desc_nulls_last("val_accuracy"), "steps").limit(1)
