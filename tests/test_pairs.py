import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge.operators import pairs as P
from rankforge.operators.difficulty import add_difficulty, add_phases, curriculum_stats, difficulty_report
from rankforge.operators.ordering import lowest_by_hash, row_index
from rankforge.operators.pair_counts import PairCounts
from rankforge.operators.quantiles import exact_quantiles
from rankforge.functions.hashing import key_hash
from rankforge.plans import queries


def responses(spark, n=40):
    rows = [
        (str(i), f"i{i % 2}", "t", "p" if i < n - 3 else None, f"r{i}", (i * 7 % 11) / 10) for i in range(n)
    ]
    return spark.createDataFrame(
        rows, "ID string, item string, task string, prompt string, response string, label double"
    )


def as_set(df):
    return {
        (r.response1_id, r.response2_id, r.winner, r.response1, r.norm_response2) for r in df.collect()
    }


def test_all_pairs_once_in_any_input_order_and_with_blocks(spark):
    df = responses(spark)
    plain = P.generate_pairs(df)
    got = as_set(plain)
    assert len(got) == plain.count()
    keyed = [(r.item, r.ID) for r in df.collect() if r.prompt]
    want = {frozenset((a[1], b[1])) for a, b in itertools.combinations(keyed, 2) if a[0] == b[0]}
    assert {frozenset(x[:2]) for x in got} == want
    assert as_set(P.generate_pairs(df.orderBy(F.desc("ID")).repartition(3))) == got
    assert as_set(P.generate_pairs(df, hot_group_rows=5, block_rows=4)) == got


def test_one_hot_group_beside_small_ones(spark):
    hot = spark.range(300).select(
        F.col("id").cast("string").alias("ID"), F.lit("hot").alias("item"), F.lit("t").alias("task"),
        F.lit("p").alias("prompt"), F.lit("r").alias("response"), (F.col("id") / 300).alias("label"),
    )
    df = hot.unionByName(responses(spark))
    out = P.generate_pairs(df, hot_group_rows=100, block_rows=50, orientation="label")
    assert out.filter("item = 'hot'").count() == 300 * 299 // 2
    assert out.filter("item = 'hot' and winner <> 'B'").count() == 0


def test_random_pairs_are_distinct_known_and_exact_in_number(spark):
    items = spark.range(30).select(F.col("id").cast("string").alias("response_id"))
    for wanted in (10, 200, 400, 435):
        got = P.random_pairs(items, wanted, seed=3).collect()
        sets = {frozenset((r.response1_id, r.response2_id)) for r in got}
        assert len(got) == len(sets) == wanted and all(len(s) == 2 for s in sets)
    with pytest.raises(ValueError):
        P.random_pairs(items, 436)


def test_random_draws_are_no_broadcast_and_no_single_task(spark):
    items = spark.range(3000).select(F.col("id").cast("string").alias("response_id"))
    out = P.draw_pairs(items, 2, 150_000)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [_lo" in plan and "SortMergeJoin [_hi" in plan
    assert "REPARTITION_BY_NUM" in plan
    assert out.count() == out.select("round", "response1_id", "response2_id").distinct().count() == 300_000


def test_row_index_is_dense_and_restarts(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"), (F.col("id") % 3).alias("g"))
    got = row_index(df.repartition(5), ["k"], ["g"]).collect()
    for g in range(3):
        part = sorted((r.k, r.row_index) for r in got if r.g == g)
        assert [i for _, i in part] == list(range(len(part)))


def test_lowest_by_hash_takes_exact_quota_from_a_hot_group(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") < 4000, "hot").otherwise("rest").alias("g"))
    quotas = spark.createDataFrame([("hot", 1234), ("rest", 0)], "g string, q bigint")
    got = {r.id for r in lowest_by_hash(df, ["g"], quotas, "q", key_hash("id", seed=1), F.col("id")).collect()}
    ranked = df.filter("g = 'hot'").orderBy(key_hash("id", seed=1)).limit(1234).collect()
    assert got == {r.id for r in ranked}


def test_lowest_by_hash_reads_its_rows_twice(spark):
    """Rows that cost much are made for the counts and for the draw, and no more often."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.range(5000).withColumn("g", F.col("id") % 2).mapInArrow(counted, "id long, g long")
    quotas = spark.createDataFrame([(0, 700), (1, 9000)], "g long, q bigint")
    drawn = lowest_by_hash(df, ["g"], quotas, "q", key_hash("id", seed=1), F.col("id")).collect()
    # a group of fewer rows than its quota is whole
    assert sum(r.g == 0 for r in drawn) == 700 and sum(r.g == 1 for r in drawn) == 2500
    first = df.filter("g = 0").orderBy(key_hash("id", seed=1)).limit(700)
    assert read.value <= 10_000
    assert {r.id for r in drawn if r.g == 0} == {r.id for r in first.collect()}


def test_quantiles_equal_numpy_for_ties_skew_and_tiny_groups(spark):
    rng = np.random.default_rng(0)
    data = [("big", float(v)) for v in rng.normal(size=3000)]
    data += [("ties", float(v)) for v in rng.integers(0, 3, size=700)]
    data += [("two", 1.0), ("two", 2.0), ("one", 5.0), ("none", None), ("big", float("nan"))]
    df = spark.createDataFrame(data, "g string, v double").repartition(4)
    for direct in (0, 10**6):
        got = {r.g: r for r in exact_quantiles(df, "v", by=["g"], accuracy=500, direct_rows=direct).collect()}
        assert set(got) == {"big", "ties", "two", "one"}
        for g, row in got.items():
            values = [v for k, v in data if k == g and v == v]
            want = np.quantile(values, [0.25, 0.5, 0.75])
            assert np.allclose([row.q25, row.q50, row.q75], want, atol=1e-12)


def test_difficulty_bounds_are_inclusive_and_missing_is_hard(spark):
    rows = [("i", "t", 1.0, x, "A") for x in (0.0, 0.25, 0.5, 0.75, 1.0)] + [("i", "t", 1.0, None, "A")]
    df = spark.createDataFrame(rows, "item string, task string, norm_response1 double, norm_response2 double, winner string")
    got = {r.norm_response2: r for r in add_difficulty(df).collect()}
    assert [got[x].difficulty_level for x in (0.0, 0.25, 0.5, 0.75, 1.0)] == [1, 1, 2, 3, 4]
    assert got[None].difficulty_category == "Hard"
    assert got[0.0].stratify_key == "Easy_i_t"
    same = df.withColumn("norm_response2", F.lit(0.5))
    assert {r.difficulty_level for r in add_difficulty(same).collect()} == {1}


def test_phases(spark):
    df = spark.createDataFrame(
        [(1, 0.0), (2, 0.33), (3, 0.67), (4, 1.0)], "difficulty_level int, difficulty_score double"
    )

    def phases(strategy):
        return [r.curriculum_phase for r in add_phases(df, strategy).orderBy("difficulty_level").collect()]

    assert phases("progressive") == [1, 2, 2, 3]
    assert phases("gradual") == [1, 1, 2, 3]
    mixed = add_phases(df, "mixed").orderBy("difficulty_level").collect()
    assert [(r.phase1_weight, r.phase2_weight, r.phase3_weight) for r in mixed] == [
        (3, 2, 1), (1, 2, 1), (1, 1, 1), (1, 1, 1),
    ]
    with pytest.raises(ValueError):
        add_phases(df, "other")


def test_recurring_and_null_ids_lose_no_pair(spark):
    ids = ["a", "dupe_average", "dupe_average", None, None]
    rows = [(i, "i", "t", "p", "same" if k > 2 else f"r{k}", 0.5) for k, i in enumerate(ids)]
    df = spark.createDataFrame(
        rows, "ID string, item string, task string, prompt string, response string, label double"
    )
    assert P.generate_pairs(df).count() == 10
    assert P.generate_pairs(df, orientation="label", hot_group_rows=2, block_rows=2).count() == 10
    kept = P.sample_pairs(P.generate_pairs(df).withColumn("split", F.lit("train")), 5, (1.0, 0.0, 0.0))
    assert kept.count() == 5


def test_quota_is_exact_among_ties(spark):
    df = spark.createDataFrame([("x", 1)] * 5 + [("y", 2)], "id string, v int").withColumn("g", F.lit(0))
    for n in range(7):
        quotas = spark.createDataFrame([(0, n)], "g int, q bigint")
        assert lowest_by_hash(df, ["g"], quotas, "q", key_hash("id"), F.col("id")).count() == n


def test_statistics_report(spark):
    pairs = add_phases(add_difficulty(P.generate_pairs(responses(spark))))
    out = curriculum_stats(pairs)
    n = pairs.count()
    assert out["total"].first().n == n and sum(r.n for r in out["difficulty"].collect()) == n
    assert set(out) == {"total", "difficulty", "norm_diff", "phases"} and out["norm_diff"].count() == 1


@pytest.mark.parametrize("block_values", [100_000, 3])
def test_counted_pairs_grade_like_written_pairs(spark, block_values):
    rng = np.random.default_rng(5)
    values = [float(v) for v in rng.integers(0, 40, 90) / 39.0] + [None, None, float("nan"), float("nan"), 0.3, 0.1 + 0.2]
    rows = [(str(i), f"i{i % 3}", "t", None if i % 17 == 0 else "p", "r", v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "ID string, item string, task string, prompt string, response string, label double")
    graded = add_difficulty(P.generate_pairs(df), by=[])
    counts = PairCounts(df, by=["item"], block_values=block_values)
    table = counts.graded()
    classes = ["item", "difficulty_category", "difficulty_level"]
    for strategy in ("progressive", "gradual"):
        own = add_phases(graded, strategy).groupBy(*classes, "curriculum_phase", (F.col("winner") == "Equal").alias("e"))
        got = add_phases(table, strategy).groupBy(*classes, "curriculum_phase", F.col("winner").isNotNull().alias("e"))
        assert sorted(map(tuple, own.count().collect())) == sorted(map(tuple, got.agg(F.sum("n")).collect()))
    report = {r.difficulty_category: (r.n, r.pct, r.equal_pct) for r in difficulty_report(graded).collect()}
    assert {r.difficulty_category: (r.n, r.pct, r.equal_pct) for r in difficulty_report(table, weight="n").collect()} == report
    known = df.filter(~F.isnan("label"))
    apart = add_difficulty(P.generate_pairs(known), by=[])
    assert PairCounts(known, block_values=block_values).mean() == pytest.approx(apart.select(F.avg("norm_diff")).first()[0])


def test_counted_quantiles_narrow_to_one_value(spark, monkeypatch):
    monkeypatch.setattr("rankforge.operators.pair_counts._LISTED", 2)
    df = spark.range(300).select(
        F.lit("i").alias("item"), F.lit("t").alias("task"), F.lit("p").alias("prompt"),
        F.pow(F.col("id") % 97 / 96.0, 3.0).alias("label"),
    )
    v = np.array([r.label for r in df.collect()])
    d = np.abs(v[:, None] - v[None, :])[np.triu_indices(300, 1)]
    got = PairCounts(df).quantiles({"a": 0.0, "b": 0.01, "c": 0.5, "d": 0.77, "e": 1.0})
    assert list(got.values()) == pytest.approx(list(np.quantile(d, [0.0, 0.01, 0.5, 0.77, 1.0])), abs=1e-15)


@pytest.mark.parametrize("name", ["difficulty_report", "norm_diff_stats", "level_filter", "epoch_schedule", "holdout_difficulty"])
def test_reports_write_no_pair(spark, sf, name, monkeypatch):
    def refuse(*args, **kwargs):
        raise AssertionError("pairs were written out")

    monkeypatch.setattr("rankforge.plans.testbed.generate_pairs", refuse)
    monkeypatch.setattr("rankforge.operators.pairs.generate_pairs", refuse)
    assert queries.registry()[name](spark, sf).count() > 0


def test_items_of_pairs_without_the_pairs(spark):
    """The item table from the rows alone: twins, NULL and recurring ids, single rows, NULL keys."""
    rows = [
        ("1", "x", "t", "p", "a", 0.1), ("2", "x", "t", "p", "b", 0.2), ("1", "x", "t", "q", "c", 0.3),
        ("3", "x", "t", "q", "d", None), ("9", "x", "t", "q", "z", 0.9), ("9", "x", "t", "r", "y", 0.8),
        ("7", "x", "t", "r", "w", 0.7), (None, "x", "t", "p", None, 0.5), (None, "y", "t", "p", "e", float("nan")),
        ("4", "y", "t", "p", "f", 0.6), ("4", "y", "t", "p", "f", 0.6), ("5", "y", "t", "s", "g", 0.4),
        ("5", "y", "t", "u", "h", 0.4), ("5", "y", "t", "u", "h", 0.4), ("6", None, "t", "p", "i", 0.4), ("8", "z", "t", "p", "j", 0.1),
    ]
    df = spark.createDataFrame(rows, "ID string, item string, task string, prompt string, response string, label double")
    for orientation in ("hash", F.col("ID").cast("bigint")):
        want = P.first_occurrence_items(P.generate_pairs(df, orientation=orientation), ["item"])
        got = P.paired_items(df, orientation=orientation)
        assert got.columns == want.columns and got.count() == 9
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
