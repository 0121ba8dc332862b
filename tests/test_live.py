"""Live metrics and ratings over micro-batches, and the batch scorer."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge.operators import score as M
from rankforge.operators.elo_rules import EloParams
from rankforge.streaming import jobs as X

D = "split string, k long, winner string, predicted_winner string"


def feed(spark, path, rows, schema):
    """One file, so one micro-batch."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_a_report_at_every_nth_row_across_batches(spark, tmp_path):
    """Batches of uneven size, a group that pauses, one too small ever to report."""
    rng = random.Random(3)
    source, sink, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    names, seen, k = ("A", "B", "Equal"), {"x": [], "y": [], "z": []}, 0
    for sizes in ({"x": 13, "y": 4}, {"x": 1}, {"x": 30, "y": 9, "z": 3}, {"y": 2}):
        rows = []
        for split, n in sizes.items():
            for _ in range(n):
                rows.append((split, k, rng.choice(names), rng.choice(names)))
                seen[split].append(rows[-1])
                k += 1
        rng.shuffle(rows)
        feed(spark, source, rows, D)
        schema = spark.read.parquet(source).schema
        X.stream_running_metrics(X.table_stream(spark, source, schema, 1), sink, mark, 7, ["k"])
    got = {(r.split, r.n_samples): r for r in X.running_reports(spark, sink).collect()}
    want = {(s, n) for s, rows in seen.items() for n in range(7, len(rows) + 1, 7)}
    assert set(got) == want and not any(s == "z" for s, _ in want)
    for (split, n), r in got.items():
        part = seen[split][:n]
        assert r.n_correct == sum(t == p for *_, t, p in part)
        assert r.accuracy == pytest.approx(r.n_correct / n)


def test_a_batch_of_ratings_writes_changed_items_only(spark, tmp_path):
    source, sink, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    items = spark.createDataFrame(
        [("d", "x", f"r{i}", i / 20) for i in range(20)], "dataset string, item string, response_id string, norm_response double"
    )
    V = "dataset string, item string, response1_id string, response2_id string, winner string"
    batches = [[(0, 1, "A"), (2, 3, "B")], [(0, 2, "B")], [(5, 6, "A"), (5, 7, "Equal")], [(0, 5, "A")], [(19, 18, "A")]]
    elo = dict.fromkeys(range(20), 1500.0)
    p = EloParams()
    for n, games in enumerate(batches):
        feed(spark, source, [("d", "x", f"r{a}", f"r{b}", w) for a, b, w in games], V)
        stream = X.table_stream(spark, source, spark.read.parquet(source).schema, 1)
        X.stream_ratings(stream, items, sink, mark, p, snapshot_every=3)
        step = {}
        for a, b, w in games:
            d = p.k_at(n) * ({"A": 1.0, "B": 0.0}.get(w, 0.5) - 1 / (1 + 10 ** ((elo[b] - elo[a]) / 400)))
            step.setdefault(a, []).append(d)
            step.setdefault(b, []).append(-d)
        for i, ds in step.items():
            elo[i] += sum(ds) / len(ds)
        written = spark.read.parquet(f"{sink}/version={n}").count()
        assert written == (20 if n % 3 == 0 else len(step))
        got = {int(r.response_id[1:]): r.elo for r in X.latest_ratings(spark, sink, snapshot_every=3).collect()}
        assert got == pytest.approx(elo)
    early = X.ratings_at(spark, sink, 1, snapshot_every=3).filter("response_id = 'r5'").first().elo
    assert early == 1500.0
    with pytest.raises(FileNotFoundError):
        X.ratings_at(spark, sink, 9, snapshot_every=3)


def test_batches_of_texts_are_bounded_in_number_and_bytes():
    sizes = np.array([5, 5, 5, 100, 1, 1, 1, 1, 1, 30, 3])
    got = list(M._cuts(sizes, 4, 12))
    assert [i for a, b in got for i in range(a, b)] == list(range(len(sizes)))
    assert all(b - a <= 4 and (sizes[a:b].sum() <= 12 or b - a == 1) for a, b in got)
    assert list(M._cuts(np.zeros(0, dtype=int), 4, 12)) == []


def test_a_failing_batch_loses_failing_prompts_only(spark):
    """Whatever the partitioning: the same rows lack logits, and all columns come through."""
    rows = [(str(i), str(i + 1), "t", "p", f"left {i}", f"right {i}", None if i % 3 else 1.5) for i in range(300)]
    pairs = spark.createDataFrame(
        rows, "response1_id string, response2_id string, task string, prompt string, response1 string, response2 string, extra double"
    )

    def make():
        def score(prompts):
            if any("left 7" in p for p in prompts):
                raise ValueError("no")
            if len(prompts) > 40:
                raise MemoryError("too many")
            return np.array([[len(p), 0.0, -1.0] for p in prompts])

        return score

    results = []
    for parts in (1, 7):
        out = M.add_logits(pairs.repartition(parts), make, batch_size=64).collect()
        assert len(out) == 300 and sum(r.extra is not None for r in out) == 100
        results.append({(r.response1_id, r.logit_A, r.logit_B) for r in out})
    assert results[0] == results[1]
    lost = {i for i, a, _ in results[0] if a is None}
    assert lost == {str(i) for i in range(300) if str(i).startswith("7")}
    wrong = M.add_logits(pairs.limit(5), lambda: lambda prompts: np.zeros((1, 2)))
    assert wrong.filter(F.col("logit_A").isNotNull()).count() == 0
    verdicts = M.verdict_table(pairs, make)
    assert verdicts.filter("winner = 'Equal' and confidence = 0.0").count() == len(lost)


def test_a_scorer_is_made_once_per_worker(spark, tmp_path):
    folder = str(tmp_path)

    def make():
        import os
        import uuid

        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda prompts: np.zeros((len(prompts), 3))

    pairs = spark.range(400).select(F.col("id").cast("string").alias("response1"), F.lit("x").alias("response2"))
    M.add_logits(pairs.repartition(16), make).count()
    made = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert len(made) == len(set(made)) and 0 < len(made) < 16
