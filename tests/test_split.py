import math

import pytest
from pyspark.sql import functions as F

from rankforge.operators import curriculum as Q
from rankforge.operators import leakage as L
from rankforge.operators import split as R
from rankforge.operators.pairs import sample_pairs
from rankforge.plans import testbed as T
from rankforge.plans.build import build_pair_dataset
from rankforge.operators.clean import clean_responses


def test_split_is_total_stratified_and_stable(spark, sf):
    df = T.labelled(T.orders_raw(spark, sf))
    one = R.split_responses(df, response_ratios=(0.6, 0.15))
    rows = one.select("ID", "item", "task", "score_quartile", "split").collect()
    assert len(rows) == len({r.ID for r in rows}) == 1500
    counts = {s: sum(r.split == s for r in rows) for s in ("train", "val", "test")}
    assert counts["test"] == math.ceil(0.25 * 1500)
    assert counts["val"] == math.ceil((1500 - counts["test"]) * 0.15 / 0.75)
    strata = {}
    for r in rows:
        strata.setdefault((r.item, r.task, r.score_quartile), []).append(r.split)
    for members in strata.values():
        assert abs(members.count("test") - 0.25 * len(members)) <= 1
    two = R.split_responses(df.repartition(7), response_ratios=(0.6, 0.15))
    assert {(r.ID, r.split) for r in two.collect()} == {(r.ID, r.split) for r in rows}


def test_ratio_search_meets_pair_targets(spark):
    df = spark.range(6000).select(
        F.lit("i").alias("item"), F.lit("t").alias("task"), (F.col("id") % 40).alias("prompt")
    )
    train, val = R.solve_response_ratios(df, 0.1, 0.2, tol=5e-3)
    row = R.pair_ratio_eval(df, train, val).first()
    assert row.train_ratio == pytest.approx(0.7, abs=0.03)
    assert row.val_ratio == pytest.approx(0.1, abs=0.03)
    assert row.train_ratio + row.val_ratio + row.test_ratio == pytest.approx(1.0)


def test_leakage_hits_later_splits_only(spark):
    resp = spark.createDataFrame(
        [("1", "train"), ("2", "train"), ("2", "val"), ("3", "val"), ("3", "test"), ("4", "test"), ("5", "test")],
        "ID string, split string",
    )
    pairs = spark.createDataFrame(
        [("1", "2", "train"), ("2", "3", "val"), ("3", "9", "val"), ("3", "4", "test"), ("4", "5", "test")],
        "response1_id string, response2_id string, split string",
    )
    kept = {tuple(r) for r in L.remove_leakage(resp, pairs).select(*pairs.columns).collect()}
    assert kept == {("1", "2", "train"), ("3", "9", "val"), ("4", "5", "test")}
    row = L.leakage_report(resp, pairs).first()
    assert (row.train_val_overlap, row.train_test_overlap, row.val_test_overlap) == (1, 0, 1)
    assert (row.val_removed, row.test_removed) == (1, 1)
    assert row.final_train_val_overlap == row.final_val_test_overlap == 0


def test_pair_sample_budget(spark, sf):
    pairs = T.events_pairs(spark, sf).select("response1_id", "response2_id", "item", "task", "split")
    out = sample_pairs(pairs, 500)
    counts = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert counts["train"] <= 350 and counts["val"] <= 50 and counts["test"] <= 100
    assert sum(counts.values()) >= 480
    assert sample_pairs(pairs, 10**6).count() == pairs.count()


def test_built_dataset_keeps_splits_apart(spark, sf):
    cleaned, _ = clean_responses(T.orders_raw(spark, sf))
    built = build_pair_dataset(cleaned, response_ratios=(0.6, 0.15))
    of = {r.ID: r.split for r in built.assignment.collect()}
    rows = built.pairs.collect()
    assert rows and all(of[r.response1_id] == of[r.response2_id] == r.split for r in rows)
    assert all((r.curriculum_phase is not None) == (r.split == "train") for r in rows)
    assert all(r.response1 == f"order {r.response1_id}" for r in rows)


def test_schedules_and_level_filter(spark):
    assert [Q.max_phase_of_epoch(e, 10) for e in range(1, 11)] == [1] * 4 + [2] * 3 + [3] * 3
    got = [r.phase for r in Q.phase_schedule(spark, 10).orderBy("epoch").collect()]
    assert got == [1] * 3 + [2] * 3 + [3] * 4
    df = spark.createDataFrame([(1,), (2,), (3,), (4,)], "difficulty_level int")
    assert [Q.level_filter(df, p).count() for p in (1, 2, 3)] == [1, 2, 4]
    with pytest.raises(ValueError):
        Q.level_filter(df, 4)


def test_split_quotas_hold_for_recurring_ids(spark):
    rows = [("dup", "i", "t", f"r{k}", k % 4 / 4) for k in range(40)]
    df = spark.createDataFrame(rows, "ID string, item string, task string, response string, label double")
    df = df.withColumn("prompt", F.lit("p"))
    got = {r.split: r["count"] for r in R.split_responses(df, response_ratios=(0.6, 0.2)).groupBy("split").count().collect()}
    assert got == {"train": 24, "val": 8, "test": 8}


def test_a_recurring_id_keeps_its_own_text(spark):
    rows = [("dup" if k % 2 else f"u{k}", "i", "t", "p", f"text {k}", k / 40) for k in range(40)]
    df = spark.createDataFrame(
        rows, "ID string, item string, task string, prompt string, response string, label double"
    )
    score = {r.response: r.label for r in df.collect()}
    pairs = build_pair_dataset(df, response_ratios=(0.6, 0.2)).pairs.collect()
    assert pairs and all(score[r.response1] == r.norm_response1 and score[r.response2] == r.norm_response2 for r in pairs)


def test_leakage_of_groups_equals_that_of_written_pairs(spark):
    from rankforge.operators import leakage as L
    from rankforge.operators.pairs import generate_pairs

    rows = [
        (None if i % 19 == 0 else "" if i % 23 == 0 else str(i * 7 % 31), f"i{i % 2}", "t", None if i % 13 == 0 else f"p{i % 9}",
         f"r{i % 5}", float(i % 4), ("train", "val", "test")[i * i % 7 % 3])
        for i in range(120)
    ]
    df = spark.createDataFrame(
        rows, "ID string, item string, task string, prompt string, response string, label double, split string"
    )
    keys = ["item", "task", "prompt", "split"]
    pairs = generate_pairs(df, keys, orientation="label")
    want = L.remove_leakage(df, pairs).select(pairs.columns).collect()
    got = generate_pairs(L.unblocked(df), keys, orientation="label").select(pairs.columns).collect()
    assert want and sorted(map(str, got)) == sorted(map(str, want)) and len(want) < pairs.count()
    report = L.group_leakage_report(df, keys)
    assert report.first().asDict() == L.leakage_report(df, pairs).first().asDict()
    plan = L.unblocked(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") == 1
