import os

import pytest
from pyspark.sql import functions as F

from rankforge.operators import checkpoints as K
from rankforge.plans import testbed as T
from rankforge.schemas import CLEANED
from rankforge.sources import tables as IO
from rankforge.streaming import jobs as X


def test_csv_keeps_newlines_and_quotes(spark, tmp_path):
    rows = [("1", 'a "quoted"\nline', 0.5), ("2", "comma, and\r\nmore", None)]
    df = spark.createDataFrame(rows, "ID string, response string, label double")
    IO.write_csv(df, str(tmp_path / "c"))
    back = IO.read_csv(spark, str(tmp_path / "c"), CLEANED, required=["ID"])
    got = {r.ID: (r.response.replace("\r\n", "\n"), r.label) for r in back.collect()}
    assert got == {"1": ('a "quoted"\nline', 0.5), "2": ("comma, and\nmore", None)}
    with pytest.raises(ValueError, match="nope"):
        IO.read_csv(spark, str(tmp_path / "c"), required=["nope"])


def test_checked_write_and_latest(spark, tmp_path):
    path = str(tmp_path / "out")
    assert IO.write_checked(spark.range(10), path, expected=10) == 10
    with pytest.raises(RuntimeError):
        IO.write_checked(spark.range(9), str(tmp_path / "bad"), expected=10)
    with pytest.raises(RuntimeError):
        IO.write_checked(spark.range(0), str(tmp_path / "empty"))
    assert IO.latest_file(spark, path).endswith(".parquet")
    assert IO.read_optional(spark, str(tmp_path / "absent")) is None
    assert IO.read_optional(spark, path, required=["other"]) is None


def test_scaler_is_loaded_or_refitted(spark, tmp_path):
    path = str(tmp_path / "scaler")
    earlier = spark.createDataFrame([(2.0,), (6.0,)], "jrt double")
    assert IO.load_scaler(spark, path) is None
    assert tuple(IO.load_scaler(spark, path, earlier).first()) == (2.0, 6.0)
    IO.save_scaler(spark.createDataFrame([(0.0, 9.0)], "data_min double, data_max double"), path)
    assert tuple(IO.load_scaler(spark, path, earlier).first()) == (0.0, 9.0)


def test_refresh_replaces_one_dataset(spark, tmp_path):
    path = str(tmp_path / "t")
    both = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "v int, dataset string")
    IO.write_partitioned(both, path, ["dataset"])
    IO.refresh_dataset(spark.createDataFrame([(9, "b")], "v int, dataset string"), path)
    assert {(r.v, r.dataset) for r in spark.read.parquet(path).collect()} == {(1, "a"), (9, "b")}


def test_verdict_append_resumes_by_key(spark, sf, tmp_path):
    pairs = T.events_pairs(spark, sf).filter("item = 'click'")
    path = str(tmp_path / "verdicts")
    some = IO.extend_verdicts(spark, pairs.filter("winner = 'A'"), path, T.event_logits, native=True)
    rest = IO.extend_verdicts(spark, pairs, path, T.event_logits, native=True)
    assert some > 0 and some + rest == pairs.count() == spark.read.parquet(path).count()
    assert IO.extend_verdicts(spark, pairs, path, T.event_logits, native=True) == 0


def test_stream_restart_is_exactly_once(spark, sf, tmp_path):
    source, sink, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    pairs = T.events_pairs(spark, sf).filter("item = 'view'").persist()
    pairs.filter("split = 'train'").repartition(3).write.parquet(source)

    def run():
        X.stream_verdicts(
            X.table_stream(spark, source, pairs.schema, 1), sink, mark, T.event_logits, native=True
        )

    run()
    first = spark.read.parquet(sink).count()
    pairs.filter("split <> 'train'").repartition(2).write.mode("append").parquet(source)
    run()
    run()
    out = spark.read.parquet(sink)
    assert first < out.count() == pairs.count()
    assert out.select("response1_id", "response2_id").distinct().count() == pairs.count()


def test_live_ratings_conserve_points(spark, sf, tmp_path):
    verdicts = T.events_verdicts(spark, sf)
    source = str(tmp_path / "v")
    verdicts.repartition(2).write.parquet(source)
    stream = X.table_stream(spark, source, spark.read.parquet(source).schema, 1)
    sink = str(tmp_path / "r")
    X.stream_ratings(stream, T.events_items(spark, sf), sink, str(tmp_path / "m"))
    out = X.latest_ratings(spark, sink)
    assert out.count() == T.events_items(spark, sf).count()
    assert spark.read.parquet(sink).select("version").distinct().count() == 2
    assert out.filter(F.col("elo") != 1500.0).count() > 0


def test_checkpoint_summary_drops_incomplete(spark):
    rows = [
        ("checkpoint-30000", 30000, "validation", 1, 1), ("checkpoint-30000", 30000, "validation", 0, 1),
        ("checkpoint-30000", 30000, "test", 1, 1), ("checkpoint-32000", 32000, "validation", 1, 1),
        ("checkpoint-32000", 32000, "test", 0, 1), ("checkpoint-40000", 40000, "validation", 1, 1),
    ]
    df = spark.createDataFrame(rows, "peft_model_id string, steps bigint, split string, predictions int, ratings int")
    summary = K.checkpoint_summary(K.checkpoint_metrics(df))
    assert [(r.steps, r.val_accuracy, r.test_accuracy) for r in summary.collect()] == [
        (32000, 1.0, 0.0), (30000, 0.5, 1.0),
    ]
    assert K.best_checkpoint(K.checkpoint_summary(K.prediction_table(df))).first().steps == 32000


def test_csv_columns_json_and_latest_by_time(spark, tmp_path):
    df = spark.createDataFrame([("1", "a", 0.5), ("2", "b", None)], "ID string, response string, label double")
    IO.write_csv(df, str(tmp_path / "c"))
    only = IO.read_csv(spark, str(tmp_path / "c"), CLEANED, columns=["label", "ID"])
    assert only.columns == ["label", "ID"] and {tuple(r) for r in only.collect()} == {(0.5, "1"), (None, "2")}
    IO.write_json(df.groupBy().count(), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first()["count"] == 2
    folder = tmp_path / "several"
    folder.mkdir()
    for age, name in ((50, "b.parquet"), (10, "a.parquet"), (50, "c.parquet"), (1, "z.txt")):
        (folder / name).write_bytes(b"x")
        os.utime(folder / name, (1_700_000_000 - age, 1_700_000_000 - age))
    assert IO.latest_file(spark, str(folder)).endswith("/a.parquet")
    os.utime(folder / "a.parquet", (1_600_000_000, 1_600_000_000))
    assert IO.latest_file(spark, str(folder)).endswith("/c.parquet")


def test_an_unreadable_table_is_no_absent_table(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    assert IO.read_optional(spark, str(tmp_path / "empty")) is None
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_bytes(b"no parquet at all")
    with pytest.raises(Exception, match="(?i)parquet"):
        IO.read_optional(spark, str(tmp_path / "broken"))


def test_bucketed_cache_is_never_shuffled(spark, sf, tmp_path):
    """Three starts: pairs are judged once; the search for the open ones moves the pairs only."""
    path = str(tmp_path / "cache")
    T.events_pairs(spark, sf).withColumn("dataset", F.lit("events")).write.parquet(str(tmp_path / "pairs"))
    pairs = spark.read.parquet(str(tmp_path / "pairs"))
    n = pairs.count()
    first = pairs.filter("split = 'train'").count()
    assert IO.VerdictTable(spark, path, 8).extend(pairs.filter("split = 'train'"), T.event_logits, native=True) == first
    spark.sql(f"DROP TABLE {IO.VerdictTable(spark, path, 8).name}")  # a new session knows nothing of it
    cache = IO.VerdictTable(spark, path, 8)
    assert cache.extend(pairs, T.event_logits, native=True) == n - first
    assert cache.extend(pairs, T.event_logits, native=True) == 0
    assert cache.read().count() == cache.read().select(*IO.VERDICT_KEY).distinct().count() == n
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        todo = cache.pending(pairs)
        assert todo.count() == 0
        plan = todo._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning") == 1, final  # the pairs'


def test_refreshed_summary_reads_sums_only(spark, tmp_path):
    from rankforge.operators.evaluate import metrics_of_sums, rating_metrics, rating_sums

    rng = __import__("random").Random(5)
    schema = "dataset string, item string, response_id string, norm_response double, elo_normalized double"

    def rows(name, seed):
        return [(name, f"i{i % 3}", f"r{i}", None if i % 11 == 0 else rng.random(), rng.random()) for i in range(60)]

    one, two, again = (spark.createDataFrame(rows(n, s), schema) for n, s in (("a", 1), ("b", 2), ("a", 3)))
    path, sums = str(tmp_path / "ratings"), str(tmp_path / "sums")
    IO.refresh_ratings(one.unionByName(two), path, sums)
    IO.refresh_ratings(again, path, sums)
    now = again.unionByName(two)
    assert spark.read.parquet(path).count() == 120
    for by in (["dataset", "item"], ["dataset"], ["item"]):
        got = {tuple(r[c] for c in by): r for r in IO.rating_summary_of(spark, sums, by).collect()}
        want = {tuple(r[c] for c in by): r for r in rating_metrics(now, by, with_p=False).collect()}
        assert set(got) == set(want)
        for k, r in got.items():
            assert list(r)[len(by):] == pytest.approx(list(want[k])[len(by):])
    odd = spark.createDataFrame(
        [("flat", 0.5, 0.1), ("flat", 0.5, 0.4), ("same", 0.3, 0.3), ("same", 0.3, 0.3), ("one", 0.1, 0.2), ("none", None, 0.2),
         ("level", 0.2, 0.7), ("level", 0.9, 0.7)], "g string, norm_response double, elo_normalized double",
    )
    got = {r.g: r for r in metrics_of_sums(rating_sums(odd, ["g"]), ["g"]).collect()}
    assert got["flat"].pearson_r is None and got["flat"].r_squared == 0.0 and got["same"].r_squared == 1.0
    assert got["level"].pearson_r is None and got["one"].mae is None and "none" not in got


def test_first_rows_of_a_folder_come_from_its_first_files(spark, tmp_path):
    path = str(tmp_path / "ordered csv")
    df = spark.range(1000).select(F.col("id").alias("k"), F.repeat(F.lit("x\n"), (F.col("id") / 100).cast("int")).alias("t"))
    IO.write_csv(df.repartitionByRange(8, "k").sortWithinPartitions("k"), path)
    for n in (0, 100, 700):
        back = IO.read_csv(spark, path, df.schema, columns=["k"], rows=n)
        assert [r.k for r in back.collect()] == list(range(n))
    assert len(IO.read_csv(spark, path, df.schema, rows=300).inputFiles()) < 8


def test_no_single_task_writes_the_ordered_csv(spark, sf, monkeypatch):
    from rankforge.plans import queries

    seen = []
    write = IO.write_csv
    monkeypatch.setattr(queries.IO, "write_csv", lambda df, path: (seen.append(df), write(df, path)))
    queries.csv_first_rows(spark, sf).count()
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "SinglePartition" not in plan
