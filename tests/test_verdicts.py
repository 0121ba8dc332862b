import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge.functions.hashing import uniform
from rankforge.functions.verdicts import approximate_probs, checkpoint_step, draw, draw_by_hash, hash_edge, parse_verdict_json
from rankforge.operators import evaluate as V
from rankforge.operators import passes as S
from rankforge.operators import score as M

PAIRS = "task string, prompt string, response1 string, response2 string, response1_id string, response2_id string, winner string"


def test_batch_scorer_and_failing_batch(spark):
    rows = [("t", "p", "good" if i % 2 else "bad", "x", str(i), "z", "A") for i in range(10)]
    df = spark.createDataFrame(rows, PAIRS).coalesce(1)

    def factory():
        def score(prompts):
            if any("A: bad" in p for p in prompts):
                raise RuntimeError("no")
            return np.tile([2.0, 1.0, 0.0], (len(prompts), 1))

        return score

    out = M.verdict_detail(df, factory, batch_size=1).collect()
    for r in out:
        if r.response1 == "good":
            assert r.predicted_winner == "A" and r.correct == 1 and r.confidence == pytest.approx(0.66524, abs=1e-5)
        else:
            assert (r.predicted_winner, r.confidence, r.correct) == ("Equal", 0.0, 0)


def test_pending_pairs_by_key(spark):
    pairs = spark.createDataFrame([("1", "2\n\"x\""), ("1", "3"), ("2", "3")], "response1_id string, response2_id string")
    known = pairs.filter("response2_id <> '3'")
    assert M.pending_pairs(pairs, known).count() == 2
    assert tuple(M.completeness(pairs, known).first()) == (3, 1, 2)


def test_verdict_json_and_checkpoint_names(spark):
    texts = ['{"winner": "B", "confidence": 0.5}', 'so {"winner": "A"} it is', "none", "{broken", "{}"]
    df = spark.createDataFrame([(t,) for t in texts], "r string")
    got = [r.v and tuple(r.v) for r in df.select(parse_verdict_json(F.col("r")).alias("v")).collect()]
    assert got == [("B", 0.5), ("A", 0.0), None, None, ("Equal", 0.0)]
    names = spark.createDataFrame([("checkpoint-30000",), ("checkpoint-x",), ("runs",), ("checkpoint-32000x",)], "n string")
    assert [r[0] for r in names.select(checkpoint_step(F.col("n"))).collect()] == [30000, None, None, None]


def test_rebuilt_probabilities(spark):
    df = spark.createDataFrame([("A", 0.8), ("?", 0.8), (None, None)], "w string, c double")
    got = [tuple(r) for r in df.select(*approximate_probs(F.col("w"), F.col("c"))).collect()]
    assert got[0] == pytest.approx((0.8, 0.1, 0.1))
    assert got[1] == got[2] == (0.33, 0.33, 0.34)


def test_classification_with_absent_classes(spark):
    rows = [("A", "A"), ("A", "B"), ("B", "B"), ("B", "B")]
    df = spark.createDataFrame(rows, "winner string, predicted_winner string")
    row = V.classification_metrics(df).first()
    assert row.accuracy == 0.75 and row.f1_Equal == 0.0
    assert row.f1_A == pytest.approx(2 / 3) and row.f1_B == pytest.approx(0.8)
    assert row.f1_macro == pytest.approx((2 / 3 + 0.8) / 3)
    assert row.f1_weighted == pytest.approx((2 / 3 + 0.8) / 2)
    assert V.confusion(df).count() == 9
    report = {r["class"]: r for r in V.class_report(df).collect()}
    assert report["A"].precision == 1.0 and report["A"].recall == 0.5 and report["macro avg"].support == 4


def test_p_values_match_published_tables():
    # two-sided critical values of r from standard tables
    for n, r, p in ((5, 0.878, 0.05), (12, 0.576, 0.05), (22, 0.537, 0.01), (102, 0.254, 0.01)):
        assert V.student_t_tail(r, n) == pytest.approx(p, rel=0.02)
    assert V.student_t_tail(0.3, 2) == 1.0 and V.student_t_tail(0.0, 10) == pytest.approx(1.0)


def test_rating_metrics_edges(spark):
    rows = [("a", 0.0, 0.0), ("a", 1.0, 0.5), ("a", None, 0.1), ("flat", 0.5, 0.5), ("flat", 0.5, 0.5), ("one", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, norm_response double, elo_normalized double")
    got = {r.g: r for r in V.rating_metrics(df, ["g"]).collect()}
    assert got["a"].n == 2 and got["a"].pearson_r == pytest.approx(1.0) and got["a"].mae == 0.25
    assert got["a"].r_squared == pytest.approx(0.5) and got["a"].p_value == 1.0
    assert got["flat"].pearson_r is None and got["flat"].r_squared == 1.0
    assert got["one"].pearson_r is None and got["one"].rmse is None


def votes(spark, rows):
    return spark.createDataFrame(
        rows, "source_row_index bigint, true_winner string, pass_type string, pred_winner string"
    ).withColumn("is_correct", F.col("true_winner") == F.col("pred_winner"))


def test_votes_ties_and_empty_samples(spark):
    rows = [(1, "B", "stochastic", w) for w in ("B", "B", "A")]
    rows += [(2, "B", "stochastic", w) for w in ("B", "Equal")]
    rows += [(3, "A", "stochastic", w) for w in ("Equal", "A", "B")]
    rows += [(4, "Equal", "greedy", "Equal")]
    got = {r.source_row_index: r for r in S.majority_vote(votes(spark, rows)).collect()}
    assert [(got[i].majority_winner, got[i].is_tie) for i in (1, 2, 3, 4)] == [
        ("B", False), ("B", True), ("A", True), ("A", True),
    ]
    row = S.pass_summary(votes(spark, rows)).first()
    assert row.samples_without_votes == 1 and row.inferred_stochastic_passes is None
    assert row.majority_accuracy == 0.75 and row.greedy_accuracy == 1.0


def test_conflicting_truth_fails_when_strict(spark):
    df = votes(spark, [(1, "A", "stochastic", "A"), (1, "B", "stochastic", "A")])
    assert S.pass_summary(df).first().truth_conflicts == 1
    with pytest.raises(Exception, match="conflicting truth"):
        S.pass_summary(df, strict=True).collect()


def test_passes_shape_and_draw_frequencies(spark):
    df = spark.range(400).select(
        F.col("id").alias("source_row_index"), F.col("id").cast("string").alias("response1_id"),
        F.lit("z").alias("response2_id"), F.lit("A").alias("winner"),
        F.lit(1.0).alias("logit_A"), F.lit(0.0).alias("logit_B"), F.lit(-1.0).alias("logit_Equal"),
    )
    out = S.pass_table(df, 10, temperature=2.0)
    assert out.count() == 400 * 11
    drawn = out.filter("pass_type = 'stochastic'")
    want = np.exp([0.5, 0.0, -0.5]) / np.exp([0.5, 0.0, -0.5]).sum()
    share = {r.pred_winner: r["count"] / 4000 for r in drawn.groupBy("pred_winner").count().collect()}
    assert share["A"] == pytest.approx(want[0], abs=0.03) and share["B"] == pytest.approx(want[1], abs=0.03)
    bad = out.withColumn("prob_A", F.when(F.col("pass_index") == 3, float("nan")).otherwise(F.col("prob_A") + 0.01))
    row = S.check_probabilities(bad).first()
    assert row.not_finite == 400 and row.drifting == 400 * 10
    with pytest.raises(ValueError):
        S.pass_table(df, 1, temperature=0.0)


def test_pass_table_stamps_its_run(spark):
    df = spark.range(1).select(
        F.col("id").alias("source_row_index"), F.lit("x").alias("response1_id"), F.lit("y").alias("response2_id"),
        F.lit("A").alias("winner"), *[F.lit(0.0).alias(f"logit_{c}") for c in ("A", "B", "Equal")],
    )
    row = S.pass_table(df, 1).first()
    assert row.run_id.startswith("run_20") and row.timestamp_utc.endswith("+00:00")
    assert S.pass_table(df, 1, run_id="x", timestamp_utc="t").select("run_id", "timestamp_utc").first() == ("x", "t")


def test_native_logits_are_made_once(spark):
    """A filter on the confidence reads the logits; it does not hold their expressions once per use."""
    rows = [("t", "p", "aa", "b", "1", "2", "A"), ("t", "p", "a", "a", "1", "3", "A"), ("t", "p", None, "a", "2", "3", "A")]
    df = spark.createDataFrame(rows, PAIRS)

    def scorer(pairs):
        gap = F.levenshtein("response1", "response2").cast("double")
        return [gap, -gap, F.lit(0.5)]

    verdicts = M.verdict_table(df, scorer, native=True)
    sure = verdicts.filter(F.col("confidence") >= 0.6).select("response1_id", "response2_id")
    plan = sure._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("levenshtein(") <= 2  # once per logit that reads it
    assert {tuple(r) for r in sure.collect()} == {("1", "2")}
    got = {(r.response1_id, r.response2_id): (r.winner, r.confidence) for r in verdicts.collect()}
    assert got["2", "3"] == ("Equal", 0.0) and got["1", "3"][0] == "Equal"
    again = M.add_logits(df.withColumn("logit_A", F.lit(9.0)), scorer, native=True)
    assert sorted(again.columns) == sorted([*df.columns, *M.LOGITS])


def test_draws_by_text_are_the_draws_by_number(spark):
    """A draw that compares hex texts picks what the number of the hash picks, at every edge."""
    low = 1.0 / 2**32
    shares = [0.0, low, 0.25, 0.25 + low / 2, 1 - 2 * low, 1 - low, 1 - low / 2, 1.0, 1.0 + 1e-12, float("nan"), None]
    digits = ["00000000", "00000001", "3fffffff", "40000000", "40000001", "fffffffe", "ffffffff"]
    rows = [(d + "0" * 24, a, b) for d in digits for a in shares for b in shares]
    df = spark.createDataFrame(rows, "h string, a double, b double")
    by_number = draw(uniform(F.col("h")), [F.col("a"), F.col("b") - F.col("a")])
    both = F.col("a") + (F.col("b") - F.col("a"))
    by_text = draw_by_hash(F.col("h"), [hash_edge(F.col("a")), hash_edge(both)])
    # negative shares do not occur in a triple
    got = df.filter("b is null or a is null or isnan(a) or b >= a").select(by_number.alias("n"), by_text.alias("t"))
    assert got.count() > 300 and got.filter("n <> t or n is null or t is null").count() == 0
    scored = spark.createDataFrame([("1", "2", "s", "A", 1.0, 0.0, 0.0)],
        "response1_id string, response2_id string, source_row_index string, winner string, logit_A double, logit_B double, logit_Equal double")
    plan = S.majority_vote(S.pass_table(scored, 5))._jdf.queryExecution().optimizedPlan().toString()
    assert "conv(" not in plan  # no hash is parsed per draw
