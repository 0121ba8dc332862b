"""Repeated sampled passes over one scoring result, and their analysis."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.functions.hashing import key_hash
from rankforge.functions.verdicts import (
    argmax, decode_label, draw_by_hash, encode_label, hash_edge, softmax, value_of,
)
from rankforge.operators.columns import require_columns
from rankforge.operators.score import LOGITS
from rankforge.schemas import LABELS

PROBS = ["prob_A", "prob_B", "prob_Equal"]
TEXTS = ["task", "prompt", "response1", "response2"]


def pass_table(
    scored: DataFrame, n_passes: int = 60, temperature: float = 0.7, seed: int = 42,
    run_id: str | None = None, timestamp_utc: str | None = None, split_name: str = "",
    include_text: bool = False,
) -> DataFrame:
    """One greedy row (index 0, temperature 1) and ``n_passes`` drawn rows per pair.

    Needs the logits, the true ``winner`` and a ``source_row_index``. Both probability
    triples are computed once per pair, before the expansion; every draw uses a uniform
    keyed by (pair, pass, seed), held against the triple as hex texts. Without them the UTC time of the call is the stamp, to
    the second, and the run id is made of it.
    """
    now = datetime.now(UTC).replace(microsecond=0)
    timestamp_utc = now.isoformat() if timestamp_utc is None else timestamp_utc
    run_id = f"run_{now:%Y%m%d_%H%M%S}" if run_id is None else run_id
    if temperature <= 0:
        raise ValueError("temperature must be above 0")
    require_columns(scored, ["source_row_index", "winner", *LOGITS])
    logits = [F.col(c) for c in LOGITS]
    greedy = softmax(logits)
    scaled = softmax([x / F.lit(float(temperature)) for x in logits])
    base = scored.withColumns(
        {
            "_greedy": F.array(*greedy), "_scaled": F.array(*scaled), "_top": argmax(logits),
            "_true": encode_label(F.col("winner")),
        }
    ).withColumns(
        {
            "_edge_a": hash_edge(F.col("_scaled")[0]), "_edge_b": hash_edge(F.col("_scaled")[0] + F.col("_scaled")[1]),
        }
    ).withColumn("pass_index", F.explode(F.sequence(F.lit(0), F.lit(n_passes))))
    first = F.col("pass_index") == 0
    base = base.withColumn("_p", F.when(first, F.col("_greedy")).otherwise(F.col("_scaled")))
    probs = [F.col("_p")[i] for i in range(3)]
    # the hash is a column, so that its two comparisons share it
    drawn_hash = key_hash("response1_id", "response2_id", "pass_index", seed=seed)
    base = base.withColumn("_h", F.when(~first, drawn_hash))
    drawn = draw_by_hash(F.col("_h"), [F.col("_edge_a"), F.col("_edge_b")])
    base = base.withColumn("pred_winner", F.when(first, F.col("_top")).otherwise(drawn))
    pred = F.col("pred_winner")
    return base.select(
        F.lit(run_id).alias("run_id"), F.lit(timestamp_utc).alias("timestamp_utc"),
        F.lit(split_name).alias("split_name"), "source_row_index", "response1_id",
        "response2_id", F.col("winner").alias("true_winner"),
        F.col("_true").alias("true_label_id"),
        F.when(first, "greedy").otherwise("stochastic").alias("pass_type"), "pass_index",
        F.when(first, 1.0).otherwise(float(temperature)).alias("temperature"),
        F.lit("temperature_logits").alias("stochastic_method"), *LOGITS,
        *[p.alias(n) for p, n in zip(probs, PROBS)],
        (probs[0] + probs[1] + probs[2]).alias("prob_sum"),
        encode_label(pred).alias("pred_label_id"), "pred_winner",
        value_of(pred, probs).alias("confidence"),
        (pred == F.col("winner")).alias("is_correct"),
        *([c for c in TEXTS if c in scored.columns] if include_text else []),
    )


def check_probabilities(passes: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Rows with a missing or infinite probability, rows whose sum drifts, worst drift."""
    finite = F.lit(True)
    for name in PROBS:
        p = F.col(name)
        finite = finite & p.isNotNull() & ~F.isnan(p) & (F.abs(p) != float("inf"))
    drift = F.abs(F.col("prob_A") + F.col("prob_B") + F.col("prob_Equal") - 1)
    return passes.agg(
        F.count("*").alias("rows"), F.count_if(~F.coalesce(finite, F.lit(False))).alias("not_finite"),
        F.count_if(finite & (drift > tolerance)).alias("drifting"),
        F.max(F.when(finite, drift)).alias("max_drift"),
    )


def majority_vote(passes: DataFrame, key: str = "source_row_index") -> DataFrame:
    """Votes of the drawn passes per sample; ties go to A, then B, then Equal.

    A sample without drawn passes has three zero votes and so counts as a tied A.
    """
    drawn = F.col("pass_type") == "stochastic"
    # label numbers instead of names: numeric states keep the aggregation hash-based
    truth = encode_label(F.col("true_winner"))
    votes = passes.groupBy(key).agg(
        decode_label(F.min(truth)).alias("true_winner"),
        (F.min(truth) != F.max(truth)).alias("truth_conflict"),
        *[
            F.count_if(drawn & (F.col("pred_winner") == name)).alias(f"votes_{name}")
            for name in LABELS
        ],
        F.count_if(~drawn).alias("greedy_rows"), F.count_if(drawn).alias("stochastic_rows"),
        F.count_if(drawn & ~F.col("pred_winner").isin(*LABELS)).alias("unknown_votes"),
        F.count_if(~drawn & F.col("is_correct")).alias("greedy_hits"),
        F.count_if(drawn & F.col("is_correct")).alias("drawn_hits"),
    )
    counts = [F.col(f"votes_{name}") for name in LABELS]
    top = F.greatest(*counts)
    tied = sum((c == top).cast("int") for c in counts) > 1
    won = argmax(counts)
    return votes.withColumns(
        {
            "majority_winner": won, "is_tie": tied,
            "majority_correct": F.coalesce(won == F.col("true_winner"), F.lit(False)).cast("int"),
        }
    )


def pass_accuracy(passes: DataFrame) -> DataFrame:
    """Accuracy per pass index; index 0 is the greedy pass."""
    return passes.groupBy("pass_type", "pass_index").agg(
        F.count("*").alias("n"), F.avg(F.col("is_correct").cast("double")).alias("accuracy")
    )


def pass_summary(passes: DataFrame, key: str = "source_row_index", strict: bool = False) -> DataFrame:
    """Summary of a pass table in one row: accuracies, votes, ties, count checks.

    Two aggregations: per sample, then over samples. With ``strict`` a sample with
    conflicting truth or an unknown predicted label fails the job.
    """
    votes = majority_vote(passes, key)
    if strict:
        bad = F.col("truth_conflict") | (F.col("unknown_votes") > 0)
        ok = F.when(bad, F.raise_error(F.lit("conflicting truth or unknown label"))).otherwise(True)
        votes = votes.filter(ok.cast("boolean"))
    drawn_min, drawn_max = F.min("stochastic_rows"), F.max("stochastic_rows")
    greedy, drawn = F.sum("greedy_rows"), F.sum("stochastic_rows")

    def ratio(part, whole):
        return F.when(whole > 0, part / whole)

    common = F.when(drawn_min == drawn_max, drawn_min)
    return votes.agg(
        F.count("*").alias("total_samples"), (greedy + drawn).alias("total_rows"),
        greedy.alias("greedy_rows"), drawn.alias("stochastic_rows"),
        ratio(F.sum("greedy_hits"), greedy).alias("greedy_accuracy"),
        ratio(F.sum("drawn_hits"), drawn).alias("stochastic_accuracy"),
        F.avg("majority_correct").alias("majority_accuracy"),
        F.avg(F.col("is_tie").cast("double")).alias("tie_rate"),
        F.count_if(F.col("stochastic_rows") == 0).alias("samples_without_votes"),
        F.count_if("truth_conflict").alias("truth_conflicts"),
        common.alias("inferred_stochastic_passes"),
        (F.count("*") * (common + 1)).alias("expected_rows"),
        F.count_if(F.col("greedy_rows") > 1).alias("samples_with_extra_greedy"),
    )
