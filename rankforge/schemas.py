"""Explicit schemas of every table that crosses a file boundary."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in cols.items()])


_s, _d, _i, _l, _b = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType()

# The class order of every confusion grid, vote and logit triple.
LABELS = ("A", "B", "Equal")

RESPONSES_RAW = _struct(
    study_id=_s, sub_id=_s, response_id=_s, ID=_s, item=_s, task=_s, prompt=_s, response=_s, jrt=_d
)
CLEANED = _struct(ID=_s, item=_s, task=_s, prompt=_s, response=_s, jrt=_d, text=_s, label=_d)
HOLDOUT_CLEANED = _struct(ID=_s, item=_s, task=_s, prompt=_s, response=_s, text=_s, label=_d)
SCALER = _struct(data_min=_d, data_max=_d)
PAIRS = _struct(
    item=_s, task=_s, prompt=_s, response1=_s, response2=_s, response1_id=_s, response2_id=_s,
    norm_response1=_d, norm_response2=_d, winner=_s, norm_diff=_d, difficulty_score=_d,
    difficulty_category=_s, difficulty_level=_i, stratify_key=_s, split=_s,
)
VERDICTS = _struct(
    dataset=_s, item=_s, response1_id=_s, response2_id=_s, winner=_s, confidence=_d
)
VERDICT_DETAIL = T.StructType(
    PAIRS.fields + _struct(predicted_winner=_s, confidence=_d, correct=_i).fields
)
PASSES = _struct(
    run_id=_s, timestamp_utc=_s, split_name=_s, source_row_index=_l, response1_id=_s,
    response2_id=_s, true_winner=_s, true_label_id=_i, pass_type=_s, pass_index=_i,
    temperature=_d, stochastic_method=_s, logit_A=_d, logit_B=_d, logit_Equal=_d,
    prob_A=_d, prob_B=_d, prob_Equal=_d, prob_sum=_d, pred_label_id=_i, pred_winner=_s,
    confidence=_d, is_correct=_b,
)
CHECKPOINT_PREDICTIONS = _struct(
    peft_model_id=_s, steps=_l, epoch=_d, split=_s, predictions=_i, ratings=_i,
    accuracy=_d, pearson=_d,
)
