"""The given test tables seen as responses, pairs, verdicts and checkpoints."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.functions.hashing import key_hash, uniform
from rankforge.functions.verdicts import decode_label
from rankforge.operators.clean import apply_scaler, fit_scaler, shift_scores
from rankforge.operators.pairs import generate_pairs, paired_items
from rankforge.operators.score import add_logits, verdict_detail, verdict_table

# Invented checkpoints with the accuracy they are given on the labels table.
CHECKPOINTS = {
    "checkpoint-28000": 0.55, "checkpoint-30000": 0.60, "checkpoint-32000": 0.80,
    "checkpoint-40000": 0.75, "checkpoint-43752": 0.70, "checkpoint-50000": 0.65,
    "checkpoint-x": 0.90, "runs": 0.90,
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _text(col: str) -> Column:
    return F.col(col).cast("string")


def orders_raw(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        _text("o_orderkey").alias("ID"), F.col("o_orderpriority").alias("item"),
        F.col("o_orderstatus").alias("task"), F.date_format("o_orderdate", "yyyy-MM").alias("prompt"),
        F.concat(F.lit("order "), _text("o_orderkey")).alias("response"),
        F.col("o_totalprice").alias("jrt"),
    )


def events_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Scores are floored to steps of 20, so equal scores occur."""
    return table(spark, sf, "events").select(
        _text("event_id").alias("ID"), F.col("event_type").alias("item"), F.lit("use").alias("task"),
        _text("user_id").alias("prompt"),
        F.concat(F.lit("event "), _text("event_id")).alias("response"),
        (F.floor(F.col("value") / 20) * 20).cast("double").alias("jrt"),
    )


def dup_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Events of one user, type and day count as the same response."""
    return table(spark, sf, "events").select(
        _text("event_id").alias("ID"), F.col("event_type").alias("item"), F.lit("day").alias("task"),
        F.date_format("ts", "yyyy-MM-dd").alias("prompt"), _text("user_id").alias("response"),
        F.col("value").alias("jrt"),
    )


def customer_holdout(spark: SparkSession, sf: str) -> DataFrame:
    """No task column; ids are built from study and response id."""
    return table(spark, sf, "customer").select(
        _text("c_nationkey").alias("study_id"), _text("c_custkey").alias("response_id"),
        F.col("c_mktsegment").alias("item"), _text("c_nationkey").alias("prompt"),
        F.col("c_name").alias("response"), F.col("c_acctbal").alias("jrt"),
    )


def documents_raw(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return docs.join(labels, "doc_id", "left").select(
        _text("doc_id").alias("ID"), F.col("lang").alias("item"), F.col("source").alias("task"),
        F.lit("doc").alias("prompt"), F.col("text").alias("response"),
        F.col("quality").cast("double").alias("jrt"),
    )


def labelled(raw: DataFrame) -> DataFrame:
    """Shift and min-max scale the scores, nothing else."""
    return apply_scaler(shift_scores(raw), fit_scaler(raw))


def orders_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return generate_pairs(labelled(orders_raw(spark, sf)))


def by_number() -> Column:
    return F.col("ID").cast("bigint")


def events_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Oriented by event id; val and test are told from train by keyed hash of the user."""
    pairs = generate_pairs(labelled(events_raw(spark, sf)), orientation=by_number())
    u = uniform(key_hash("prompt", seed="split"))
    split = F.when(u < 0.6, "train").when(u < 0.8, "val").otherwise("test")
    return pairs.withColumn("split", split)


def event_logits(pairs: DataFrame) -> list[Column]:
    """Column scorer: the label difference plus noise from id arithmetic."""
    a, b = F.col("response1_id").cast("bigint"), F.col("response2_id").cast("bigint")
    gap = F.col("norm_response1") - F.col("norm_response2")

    def noise(i: int, j: int, m: int) -> Column:
        return F.pmod(a * i + b * j, F.lit(m)).cast("double") / F.lit(float(m)) - F.lit(0.5)

    z = F.lit(8.0) * gap + noise(31, 17, 101)
    return [z, -z, F.lit(0.6) - F.lit(12.0) * F.abs(gap) + noise(13, 7, 97)]


def numbers_scorer():
    """A scorer of prompt texts in numpy: logits from the numbers behind ``A:`` and ``B:``.

    It refuses a whole batch in which any sum of 7 first and second is divisible by 97.
    """

    def score(prompts: list[str]) -> np.ndarray:
        found = [re.search(r"\nA: event (\d+)\nB: event (\d+)", p) for p in prompts]
        a, b = (np.array([int(m.group(i)) for m in found], dtype=np.int64) for i in (1, 2))
        if ((7 * a + b) % 97 == 0).any():
            raise RuntimeError("a batch the model cannot take")
        z = (31 * a + 17 * b) % 101 / 101.0 - 0.5
        return np.stack([z, -z, (13 * a + 7 * b) % 89 / 89.0 - 0.6], axis=1)

    return score


def events_scored(spark: SparkSession, sf: str) -> DataFrame:
    return add_logits(events_pairs(spark, sf), event_logits, native=True)


def events_detail(spark: SparkSession, sf: str) -> DataFrame:
    return verdict_detail(events_pairs(spark, sf), event_logits, native=True)


def events_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    pairs = events_pairs(spark, sf).withColumn("dataset", F.lit("events"))
    return verdict_table(pairs, event_logits, native=True)


def events_items(spark: SparkSession, sf: str) -> DataFrame:
    items = paired_items(labelled(events_raw(spark, sf)), orientation=by_number())
    return items.select(F.lit("events").alias("dataset"), "*")


def lineitem_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Responses with a split whose ids recur: order and line number repeat by chance."""
    rows = table(spark, sf, "lineitem")
    full = key_hash("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", seed="split")
    u = uniform(full)
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("ID"),
        F.col("l_returnflag").alias("item"), F.col("l_linestatus").alias("task"),
        _text("l_partkey").alias("prompt"), _text("l_suppkey").alias("response"),
        (F.col("l_quantity") / F.lit(50.0)).alias("label"), full.alias("_ord"),
        F.when(u < 0.5, "train").when(u < 0.75, "val").otherwise("test").alias("split"),
    )


LINEITEM_KEYS = ["item", "task", "prompt", "split"]


def lineitem_pairs(responses: DataFrame) -> DataFrame:
    return generate_pairs(responses, LINEITEM_KEYS, orientation="_ord")


def checkpoint_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Every labelled document predicted by every checkpoint, the malformed ones too."""
    names = F.array(
        *[F.struct(F.lit(n).alias("peft_model_id"), F.lit(a).alias("acc")) for n, a in CHECKPOINTS.items()]
    )
    rows = table(spark, sf, "labels").select(
        "doc_id", (F.col("quality") + F.col("toxic")).cast("int").alias("ratings"), F.inline(names)
    )
    u = uniform(key_hash("doc_id", "peft_model_id", seed="hit"))
    other = F.floor(uniform(key_hash("doc_id", "peft_model_id", seed="miss")) * 3).cast("int")
    half = uniform(key_hash("doc_id", seed="half"))
    return rows.select(
        "doc_id", "peft_model_id",
        F.when(half < 0.5, "validation").otherwise("test").alias("split"),
        F.when(u < F.col("acc"), F.col("ratings")).otherwise(other).alias("predictions"), "ratings",
        decode_label(F.col("ratings")).alias("winner"),
    )


def verdict_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Judge replies in all shapes, built from the event properties."""
    k = F.get_json_object("props", "$.k")
    body = F.concat(
        F.lit('{"winner": "'), F.when(F.col("value") > 50, "A").otherwise("B"),
        F.lit('", "confidence": 0.'), k, F.lit("}"),
    )
    kind = F.col("event_type")
    raw = (
        F.when(kind == "click", body)
        .when(kind == "view", F.concat(F.lit("My verdict: "), body, F.lit(" as asked")))
        .when(kind == "error", F.lit("no verdict"))
        .otherwise(F.col("props"))
    )
    return table(spark, sf, "events").select("event_id", "event_type", raw.alias("raw"))
