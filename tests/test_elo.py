import math
import random

import numpy as np
import pytest

from rankforge.operators.elo_replay import elo_replay
from rankforge.operators.elo_rules import (
    GRID_4D, EloParams, StopWatch, grid_params, independent_batches,
)
from rankforge.operators.elo_sync import elo_sync
from rankforge.operators.pairs import first_occurrence_items
from rankforge.operators.sweep import best_setting, elo_sweep

V = "dataset string, item string, response1_id string, response2_id string, winner string"
I = "dataset string, item string, response_id string, norm_response double"
KEY = ["dataset", "item"]


def league(spark, n=14, seed=1, groups=("x", "y")):
    rng = random.Random(seed)
    verdicts, items = [], []
    for g in groups:
        for i in range(n):
            items.append(("d", g, f"r{i:02d}", i / (n - 1)))
            for j in range(i + 1, n):
                p = 1 / (1 + math.exp((j - i) / 3))
                u = rng.random()
                verdicts.append(("d", g, f"r{i:02d}", f"r{j:02d}", "A" if u < p * 0.9 else "B" if u < 0.9 else "Equal"))
    return spark.createDataFrame(verdicts, V), spark.createDataFrame(items, I)


def plain_elo(games, k_of):
    """Independent replay: one game after the other."""
    ratings = {}
    for g in games:
        a, b = (g.item, g.response1_id), (g.item, g.response2_id)
        ra, rb = ratings.get(a, 1500.0), ratings.get(b, 1500.0)
        s = {"A": 1.0, "B": 0.0}.get(g.winner, 0.5)
        e = 1 / (1 + 10 ** ((rb - ra) / 400))
        k = k_of(g.round)
        ratings[a], ratings[b] = ra + k * (s - e), rb + k * ((1 - s) - (1 - e))
    return ratings


@pytest.mark.parametrize(
    ("method", "limit", "inside"),
    [("sequence", 10**6, 10**6), ("blocks", 30, 10**6), ("blocks", 10**6, 10**6), ("blocks", 30, 0)],
)
def test_replay_equals_one_by_one_play(spark, method, limit, inside):
    """Both orders, in both places: each verdict once per round, ratings as in sequential play."""
    verdicts, items = league(spark)
    p = EloParams(max_rounds=3)
    run = elo_replay(
        verdicts, items, p, comparisons=True, group_verdicts=limit, method=method, task_verdicts=inside
    )
    games = sorted(run.comparisons.collect(), key=lambda r: (r.item, r.round, r.pair_in_round))
    played = [(g.item, g.response1_id, g.response2_id, g.winner) for g in games if g.round == 2]
    assert sorted(played) == sorted((r.item, r.response1_id, r.response2_id, r.winner) for r in verdicts.collect())
    orders = [[(g.response1_id, g.response2_id) for g in games if g.round == r and g.item == "x"] for r in (1, 2)]
    assert orders[0] != orders[1]
    want = plain_elo(games, lambda r: p.k_at(r - 1))
    got = {(r.item, r.response_id): r for r in run.ratings.collect()}
    assert set(got) == set(want)
    for key, row in got.items():
        assert row.elo == pytest.approx(want[key], abs=1e-6)
    for g in ("x", "y"):
        elos = [r.elo for k, r in got.items() if k[0] == g]
        assert sum(elos) == pytest.approx(1500 * len(elos))
        norm = sorted(r.elo_normalized for k, r in got.items() if k[0] == g)
        assert norm[0] == 0.0 and norm[-1] == 1.0
    rounds = {(r.item, r.round): r for r in run.rounds.collect()}
    changes = [abs(g.new_a - g.old_a) + abs(g.new_b - g.old_b) for g in games if g.item == "x" and g.round == 1]
    assert rounds[("x", 1)].avg_change == pytest.approx(sum(changes) / (2 * len(changes)))
    truth = [r.norm_response for k, r in sorted(got.items()) if k[0] == "x"]
    final = [r.elo for k, r in sorted(got.items()) if k[0] == "x"]
    assert rounds[("x", 3)].pearson_r == pytest.approx(np.corrcoef(truth, final)[0, 1])


def test_replay_does_not_depend_on_partitions(spark):
    verdicts, items = league(spark)
    a = elo_replay(verdicts, items, EloParams(max_rounds=4)).ratings.collect()
    b = elo_replay(verdicts.repartition(7), items.repartition(3), EloParams(max_rounds=4)).ratings.collect()
    assert {(r.item, r.response_id, r.elo) for r in a} == {(r.item, r.response_id, r.elo) for r in b}


def test_batches_share_no_player_and_cover_all():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 20, 300), rng.integers(20, 40, 300)
    seen, last = [], {}
    for batch in independent_batches(a, b, 40):
        players = np.concatenate((a[batch], b[batch]))
        assert len(set(players)) == len(players)
        for g in batch:
            for p in (a[g], b[g]):
                assert last.get(p, -1) < g
                last[p] = g
        seen += batch.tolist()
    assert sorted(seen) == list(range(300))


def test_stop_rules_in_order():
    w = StopWatch(EloParams(patience=2))
    assert w.check(0, 0.05, 1.0, 0.5) == "avg_change<0.1"
    assert w.check(0, 5.0, 0.96, 0.5) == "95%_small"
    assert w.check(1, 5.0, 0.0, 0.5) is None
    assert w.check(2, 5.0, 0.0, 0.4) == "patience_2"
    w = StopWatch(EloParams(patience=99, min_r_delta_rounds=3))
    got = [w.check(i, 5.0, 0.0, r) for i, r in enumerate((0.5, 0.505, 0.509))]
    assert got == [None, None, "r_delta<0.01_in_3r"]
    w = StopWatch(EloParams(patience=3))
    assert [w.check(i, 5.0, 0.0, float("nan")) for i in range(4)][-1] == "patience_3"
    free = StopWatch(EloParams(use_truth=False, patience=1))
    assert free.check(50, 5.0, 0.0, 0.1) is None


def test_flat_verdicts_stop_at_once_and_empty_groups_are_skipped(spark):
    verdicts = spark.createDataFrame([("d", "x", "a", "b", "Equal"), ("d", "x", "b", "zz", "A")], V)
    items = spark.createDataFrame(
        [("d", "x", "a", 0.1), ("d", "x", "b", 0.9), ("d", "lonely", "c", 0.5)], I
    )
    run = elo_replay(verdicts, items)
    rows = run.ratings.collect()
    assert {r.item for r in rows} == {"x"} and {r.elo_normalized for r in rows} == {0.0}
    last = run.rounds.collect()
    assert len(last) == 1 and last[0].converge_reason == "avg_change<0.1" and last[0].pearson_r is None


def test_round_column_restricts_each_round(spark):
    v = spark.createDataFrame(
        [("d", "x", "a", "b", "A", 0), ("d", "x", "a", "c", "B", 1)], V + ", round int"
    )
    items = spark.createDataFrame([("d", "x", k, s) for k, s in (("a", 0.1), ("b", 0.2), ("c", 0.3))], I)
    run = elo_replay(v, items, EloParams(use_truth=False))
    got = {r.response_id: r.elo for r in run.ratings.collect()}
    assert got["b"] == pytest.approx(1484.0) and got["c"] > 1515
    assert run.rounds.count() == 2


def test_sync_rounds_against_plain_loop(spark):
    verdicts, items = league(spark, n=8)
    run = elo_sync(verdicts, items, EloParams(k_start=20, k_end=5), rounds=2)
    rows = verdicts.collect()
    want = {(r.item, r.response_id): 1500.0 for r in items.collect()}
    for rnd in range(2):
        k = EloParams(k_start=20, k_end=5).k_at(rnd)
        move, games = dict.fromkeys(want, 0.0), dict.fromkeys(want, 0)
        for r in rows:
            a, b = (r.item, r.response1_id), (r.item, r.response2_id)
            d = k * ({"A": 1.0, "B": 0.0}.get(r.winner, 0.5) - 1 / (1 + 10 ** ((want[b] - want[a]) / 400)))
            move[a] += d
            move[b] -= d
            games[a] += 1
            games[b] += 1
        want = {x: want[x] + move[x] / games[x] for x in want}
    for r in run.ratings.collect():
        assert r.elo == pytest.approx(want[(r.item, r.response_id)])


def test_sync_stops_by_rule(spark):
    verdicts, items = league(spark, n=6)
    run = elo_sync(verdicts, items, EloParams(patience=2, decay_rounds=3))
    last = {}
    for r in run.rounds.collect():
        if r.round > last.get(r.item, (0, None))[0]:
            last[r.item] = (r.round, r.converge_reason)
    assert set(last) == {"x", "y"} and all(reason for _, reason in last.values())
    assert run.ratings.count() == 12


def test_sweep_matches_single_runs(spark):
    verdicts, items = league(spark, n=8)
    grid = {"k_start": (4, 32), "k_end": (2, 8), "patience": (3,)}
    swept = elo_sweep(verdicts, items, grid, EloParams(max_rounds=12)).collect()
    assert len(swept) == 3 * 2  # k_end 8 with k_start 4 is not valid
    for k_start, k_end in ((4, 2), (32, 8)):
        p = EloParams(k_start=k_start, k_end=k_end, patience=3, max_rounds=12)
        run = elo_replay(verdicts, items, p)
        row = next(r for r in swept if (r.item, r.k_start, r.k_end) == ("x", k_start, k_end))
        rounds = [r for r in run.rounds.collect() if r.item == "x"]
        assert row.rounds_to_converge == len(rounds)
        elos = [(r.norm_response, r.elo_normalized) for r in run.ratings.collect() if r.item == "x"]
        assert row.pearson_r == pytest.approx(np.corrcoef(*zip(*elos))[0, 1])
    assert best_setting(spark.createDataFrame(swept)).count() == 2
    assert len(grid_params(GRID_4D)) == 384
    two = {"k_start": (8, 16, 24, 32, 48), "k_end": (1, 2, 4, 8, 16)}
    assert all(p.k_end <= p.k_start for p in grid_params(two))


def test_items_prefer_first_side(spark):
    pairs = spark.createDataFrame(
        [("i", "t", "p", "one", "two", "1", "2", 0.1, 0.2), ("i", "t", "p", "TWO", "x", "2", "3", 0.9, 0.3)],
        "item string, task string, prompt string, response1 string, response2 string, response1_id string, "
        "response2_id string, norm_response1 double, norm_response2 double",
    )
    got = {r.response_id: (r.response, r.norm_response) for r in first_occurrence_items(pairs).collect()}
    assert got == {"1": ("one", 0.1), "2": ("TWO", 0.9), "3": ("x", 0.3)}


def test_size_never_picks_the_order(spark):
    verdicts, items = league(spark)
    with pytest.raises(ValueError, match="blocks"):
        elo_replay(verdicts, items, EloParams(max_rounds=1), group_verdicts=3, method="sequence")
    with pytest.raises(ValueError, match="unknown method"):
        elo_replay(verdicts, items, method="auto")


def rows_of(run):
    ratings = {}
    for r in run.ratings.collect():
        ratings[(r.item, r.setting, r.response_id, "elo")] = r.elo
        ratings[(r.item, r.setting, r.response_id, "normalised")] = r.elo_normalized
    rounds = {
        (r.item, r.setting, r.round): (r.k, r.pearson_r, r.avg_change, r.pct_small, r.A, r.B, r.Equal, r.converge_reason)
        for r in run.rounds.collect()
    }
    return ratings, rounds


def test_place_never_changes_a_result(spark):
    """Groups inside tasks, over tasks, and some of each: equal ratings, rounds and reasons.

    The settings stop at different rounds, by different rules, in both groups.
    """
    verdicts, items = league(spark, n=10, groups=("x", "y", "z"))
    more, _ = league(spark, n=10, seed=5, groups=("z",))
    verdicts = verdicts.union(more)  # z has twice the verdicts of the others
    settings = [
        EloParams(max_rounds=4), EloParams(patience=2, k_start=8), EloParams(k_start=1, k_end=1, decay_rounds=5, max_rounds=9),
        EloParams(min_r_delta_rounds=3, patience=50, max_rounds=8), EloParams(use_truth=False, fixed_k=3, max_rounds=6),
    ]
    runs = [
        elo_replay(verdicts, items, settings, fits=True, group_verdicts=20, task_verdicts=inside)
        for inside in (10**6, 0, 60)
    ]
    want_ratings, want_rounds = rows_of(runs[0])
    want_fits = {(r.item, r.setting): r for r in runs[0].fits.collect()}
    reasons = {v[-1] for v in want_rounds.values() if v[-1]}
    assert len(reasons) > 2 and len({k[2] for k, v in want_rounds.items() if v[-1]}) > 2
    for run in runs[1:]:
        ratings, rounds = rows_of(run)
        assert ratings == pytest.approx(want_ratings, abs=1e-7)
        assert set(rounds) == set(want_rounds)
        for key, row in rounds.items():
            assert list(row[:4]) == pytest.approx(list(want_rounds[key][:4]), abs=1e-7)
            assert row[4:] == want_rounds[key][4:]
        for r in run.fits.collect():
            other = want_fits[(r.item, r.setting)]
            assert (r.n, r.pearson_r, r.r_squared) == pytest.approx((other.n, other.pearson_r, other.r_squared), abs=1e-7)


def test_drawn_rounds_in_both_places(spark):
    """A ``round`` column restricts each round, and a group whose rounds run out ends there."""
    rows = [("d", g, "a", "b", "A", 0) for g in "xy"] + [("d", g, "a", "c", "B", 1) for g in "xy"] + [("d", "x", "b", "c", "A", 2)]
    v = spark.createDataFrame(rows, V + ", round int")
    items = spark.createDataFrame([("d", g, k, s) for g in "xy" for k, s in (("a", 0.1), ("b", 0.2), ("c", 0.3))], I)
    one, two = (rows_of(elo_replay(v, items, EloParams(use_truth=False), task_verdicts=n)) for n in (10**6, 0))
    assert one[0] == pytest.approx(two[0]) and len(one[0]) == 12
    assert {k[:1] + k[2:] for k in one[1]} == {k[:1] + k[2:] for k in two[1]} == {("x", 1), ("x", 2), ("x", 3), ("y", 1), ("y", 2)}


def test_groups_are_packed_by_size(spark):
    from rankforge.operators.elo_replay import _units

    rng = random.Random(4)
    sizes = [(f"d{i % 7}", f"i{i}", rng.choice([1, 3, 50, 400])) for i in range(500)]
    df = spark.createDataFrame(sizes, "dataset string, item string, _n long").repartition(5)
    rows = _units(df, KEY, 1000.0).collect()
    assert sorted(r._g for r in rows) == list(range(500))
    held = {}
    for r in rows:
        held[r._unit] = held.get(r._unit, 0) + r._n
    total = sum(n for *_, n in sizes)
    assert sum(held.values()) == total and max(held.values()) <= 1400 and len(held) <= total / 1000 + 1


def test_sweep_queries_run_whole_grids(spark, sf):
    from rankforge.plans import queries

    four = queries.elo_sweep_4d(spark, sf).collect()
    assert len(four) == 384 * len({r.item for r in four})
    assert all(r.rounds_to_converge >= 1 and (r.converge_reason or r.rounds_to_converge == 200) for r in four)
    two = queries.elo_sweep_2d(spark, sf).collect()
    assert len(two) == len({r.item for r in four}) and all(r.k_end <= r.k_start for r in two)


def test_integer_parameters_are_numbers(spark):
    p = EloParams(k_start=64, k_end=16, decay_rounds=1)
    assert [type(p.k_at(r)) for r in range(3)] == [float] * 3 and p.k_at(2) == 16.0


def test_blocks_without_known_items(spark):
    """Verdicts that all name unknown items give no rows; a group of them does not stop the others."""
    verdicts, items = league(spark, n=6)
    p = EloParams(max_rounds=1)
    assert elo_replay(verdicts, items.filter("false"), p, method="blocks").ratings.count() == 0
    run = elo_replay(verdicts, items.filter("item = 'x'"), p, method="blocks")
    assert {r.item for r in run.rounds.collect()} == {r.item for r in run.ratings.collect()} == {"x"}


def classed_league(spark, groups=("x", "y"), classes=5, n=6):
    """Verdicts inside prompts: classes of a group that share no item."""
    rng = random.Random(3)
    verdicts, items = [], []
    for g in groups:
        for c in range(classes):
            ids = [f"{c}-{i}" for i in range(n + c)]
            items += [("d", g, i, rng.random() if rng.random() < 0.9 else None) for i in ids]
            verdicts += [
                ("d", g, "t", f"p{c}", x, y, rng.choice(["A", "A", "B", "Equal"])) for x in ids for y in ids if x < y
            ]
        items.append(("d", g, "alone", 0.5))
        verdicts.append(("d", g, "t", "p0", "0-0", "unheard of", "A"))
    ddl = "dataset string, item string, task string, prompt string, response1_id string, response2_id string, winner string"
    return spark.createDataFrame(verdicts, ddl), spark.createDataFrame(items, I)


def test_cells_play_what_a_task_plays(spark, monkeypatch):
    """Groups parted into classes without a common item: equal results in cells, and cells are what plays them."""
    from rankforge.operators import elo_cells, elo_replay as module

    verdicts, items = classed_league(spark)
    settings = [
        EloParams(max_rounds=4), EloParams(patience=2, k_start=8), EloParams(patience=5, k_start=8),
        EloParams(min_r_delta_rounds=3, patience=50, max_rounds=8), EloParams(use_truth=False, fixed_k=3, max_rounds=6),
    ]
    monkeypatch.setattr(elo_cells, "CELL_VERDICTS", 30)
    monkeypatch.setattr(elo_cells, "FIRST_ROUNDS", 3)
    one = elo_replay(verdicts, items, settings, fits=True, group_verdicts=20)
    monkeypatch.setattr(module, "_replay_large", None)
    two = elo_replay(verdicts, items, settings, fits=True, group_verdicts=20, task_verdicts=0)
    (ratings, rounds), (other_ratings, other_rounds) = rows_of(one), rows_of(two)
    assert other_ratings == pytest.approx(ratings, abs=1e-7) and len({k[2] for k, v in rounds.items() if v[-1]}) > 1
    assert set(rounds) == set(other_rounds)
    for key, row in rounds.items():
        assert list(other_rounds[key][:4]) == pytest.approx(list(row[:4]), abs=1e-7)
        assert other_rounds[key][4:] == row[4:]
    fits, others = ({(r.item, r.setting): r[2:] for r in run.fits.collect()} for run in (one, two))
    assert set(fits) == set(others) and all(others[k] == pytest.approx(fits[k], abs=1e-7) for k in fits)
    games = [
        elo_replay(verdicts, items, EloParams(max_rounds=2), comparisons=True, group_verdicts=20, task_verdicts=n)
        for n in (10**6, 0)
    ]
    order = ["item", "round", "pair_in_round"]
    a, b = (run.comparisons.drop("old_a", "old_b", "new_a", "new_b").orderBy(*order).collect() for run in games)
    assert a == b and len(a) > 100
    a, b = (run.comparisons.select("old_a", "old_b", "new_a", "new_b").orderBy("old_a", "old_b", "new_a").collect() for run in games)
    assert [x for r in a for x in r] == pytest.approx([x for r in b for x in r], abs=1e-7)


def test_classes_with_a_common_item_play_as_one(spark):
    verdicts, items = classed_league(spark)
    crossing = spark.createDataFrame([("d", "x", "t", "p1", "0-0", "1-0", "B")], verdicts.schema)
    verdicts = verdicts.union(crossing)
    one, two = (rows_of(elo_replay(verdicts, items, EloParams(max_rounds=5), group_verdicts=20, task_verdicts=n)) for n in (10**6, 0))
    assert two[0] == pytest.approx(one[0], abs=1e-7)


def test_synchronous_rounds_in_cells(spark, monkeypatch):
    """The same ratings and rounds by joins and in cells, with a fixed number of rounds and by stop rules."""
    from rankforge.operators import elo_cells, elo_sync as module

    verdicts, items = classed_league(spark)
    own = spark.createDataFrame([("d", "x", "t", "p0", "0-0", "0-0", "A"), ("d", "x", "t", "p0", "0-0", "0-1", None)], verdicts.schema)
    verdicts = verdicts.union(own)
    p = EloParams(patience=1, k_start=8, max_rounds=3)
    runs = [(elo_sync(verdicts, items, rounds=1), elo_sync(verdicts, items, p))]
    monkeypatch.setattr(elo_cells, "CELL_VERDICTS", 30)
    monkeypatch.setattr(module, "_by_joins", None)
    runs.append((elo_sync(verdicts, items, rounds=1), elo_sync(verdicts, items, p)))
    for joined, celled in zip(*runs):
        for name, key in (("ratings", "response_id"), ("rounds", "round")):
            a, b = (getattr(r, name).orderBy("item", key).collect() for r in (joined, celled))
            assert len(a) == len(b) and a[0].asDict().keys() == b[0].asDict().keys()
            for x, y in zip(a, b):
                for left, right in zip(x, y):
                    assert left == right if not isinstance(left, float) else right == pytest.approx(left, abs=1e-7)
