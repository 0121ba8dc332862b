"""Keyed permutation, random pairs by number, and ratings from random rounds."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankforge.functions.permutation import pair_of, permuted
from rankforge.operators import pairs as P
from rankforge.operators.elo_rules import EloParams
from rankforge.plans.build import drawn_pairs, rate_random_rounds


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 700), st.integers(0, 2**32 - 1)), min_size=1, max_size=5))
def test_permutation_of_each_row_s_own_size(domains):
    number = np.concatenate([np.arange(n) for n, _ in domains])
    size, key = (np.repeat([d[i] for d in domains], [n for n, _ in domains]) for i in (0, 1))
    got, at = permuted(number, size, key), 0
    for n, _ in domains:
        assert sorted(got[at : at + n].tolist()) == list(range(n))
        at += n


def test_permutation_of_a_huge_size_spreads_evenly():
    n = 3 * 10**14
    got = permuted(np.arange(20_000), np.full(20_000, n), np.full(20_000, 77))
    assert len(set(got.tolist())) == 20_000 and got.min() >= 0 and got.max() < n
    tenths = np.bincount((got * 10 // n).astype(int), minlength=10)
    assert tenths.min() > 1800 and tenths.max() < 2200


def test_pair_numbers(spark):
    low, high = pair_of(F.col("id"))
    rows = spark.range(1000).select("id", low.alias("lo"), high.alias("hi")).collect()
    assert [(r.lo, r.hi) for r in rows] == [(i, j) for j in range(1, 50) for i in range(j)][:1000]
    # at the seams of large triangles, where a double is off by one
    seams = [(j * (j - 1) // 2 + d, j, d) for j in (10**6, 10**8 + 1, 10**9) for d in (-1, 0, 1)]
    df = spark.createDataFrame(seams, "id long, j long, d long").select("j", "d", low.alias("lo"), high.alias("hi"))
    for r in df.collect():
        assert (r.lo, r.hi) == ((r.j - 2, r.j - 1) if r.d < 0 else (r.d, r.j))


def test_rounds_of_groups(spark, monkeypatch):
    """Exact numbers in every group and round, also in runs; groups too small give what they have."""
    monkeypatch.setattr(P, "DRAWS_PER_RUN", 7)
    sizes = {"a": 40, "b": 5, "one": 1, "two": 2}
    items = spark.createDataFrame([(g, f"r{i}") for g, n in sizes.items() for i in range(n)], "item string, response_id string")
    got = P.draw_pairs(items, 4, 30, ["item"], seed=1).collect()
    for g, n in sizes.items():
        for r in range(4):
            rows = [x for x in got if x.item == g and x.round == r]
            assert len(rows) == min(30, n * (n - 1) // 2)
            assert len({frozenset((x.response1_id, x.response2_id)) for x in rows}) == len(rows)
            assert sorted(x.pair_in_round for x in rows) == list(range(len(rows)))
    rounds = [{frozenset((x.response1_id, x.response2_id)) for x in got if x.item == "a" and x.round == r} for r in range(4)]
    assert len({frozenset(r) for r in rounds}) == 4
    again = P.draw_pairs(items.repartition(7), 4, 30, ["item"], seed=1).collect()
    assert sorted(again) == sorted(got)
    half = P.draw_pairs(items, 1, None, ["item"]).groupBy("item").count().collect()
    assert {r.item: r["count"] for r in half} == {"a": 20, "b": 2, "two": 1}
    assert P.draw_pairs(items.filter("false"), 2, 5, ["item"]).count() == 0


def test_every_pair_is_drawn_alike(spark):
    items = spark.range(6).select(F.col("id").cast("string").alias("response_id"))
    got = P.draw_pairs(items, 600, 3).groupBy("response1_id", "response2_id").count().collect()
    assert len(got) == 15 and all(80 < r["count"] < 165 for r in got)  # 120 expected


def test_rating_from_random_rounds(spark):
    """Each round plays its own pairs once, and the ratings find the order of the scores."""
    items = spark.createDataFrame(
        [("d", "x", f"{i:02d}", "t", "p", f"text {i}", i / 29) for i in range(30)],
        "dataset string, item string, response_id string, task string, prompt string, response string, norm_response double",
    )

    def scorer(pairs):
        gap = F.col("norm_response1") - F.col("norm_response2")
        return [8 * gap, -8 * gap, F.lit(0.3) - F.abs(gap)]

    pairs = drawn_pairs(items, 12, 60)
    assert {"task", "prompt", "response1", "response2", "norm_response1"} <= set(pairs.columns) and pairs.count() == 720
    run = rate_random_rounds(items, scorer, 12, EloParams(use_truth=False), num_pairs=60, native=True, comparisons=True)
    assert run.rounds.count() == 12
    played = run.comparisons.groupBy("round").count().collect()
    assert {r.round: r["count"] for r in played} == {i: 60 for i in range(1, 13)}
    elo = [r.elo for r in run.ratings.orderBy("response_id").collect()]
    assert np.corrcoef(elo, range(30))[0, 1] > 0.95
    with pytest.raises(ValueError):
        P.random_pairs(items, 436)
