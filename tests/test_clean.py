import pytest
from pyspark.sql import functions as F

from rankforge.operators import clean as C
from rankforge.operators.columns import label_sources, require_columns

RAW = "ID string, item string, task string, prompt string, response string, jrt double"


def test_duplicates_are_averaged_and_null_key_duplicates_vanish(spark):
    rows = [
        ("1", "i", "t", "p", "x", 1.0), ("2", "i", "t", "p", "x", 3.0), ("3", "i", "t", "p", "y", 5.0),
        ("4", None, "t", "p", "z", 1.0), ("5", None, "t", "p", "z", 2.0), ("6", None, "t", "p", "w", 9.0),
        ("7", "i", "t", "q", "x", None), ("8", "i", "t", "q", "x", 4.0),
    ]
    df = spark.createDataFrame(rows, RAW)
    got = {(r.prompt, r.response): (r.ID, r.jrt) for r in C.average_duplicates(df).collect()}
    assert set(got) == {("p", "x"), ("p", "y"), ("p", "w"), ("q", "x")}
    assert got[("p", "x")][1] == 2.0 and got[("p", "x")][0].startswith("dupe_average:")
    assert got[("p", "y")] == ("3", 5.0) and got[("p", "w")] == ("6", 9.0)
    assert got[("q", "x")][1] == 4.0
    legacy = C.average_duplicates(df, legacy_dup_id=True)
    assert legacy.filter("ID = 'dupe_average'").count() == 2
    assert C.duplicate_rows(df).count() == 6


def test_clean_shifts_fits_then_drops(spark):
    rows = [("1", "i", "t", "p", "A b", -2.0), ("2", "i", "t", "p", "C", 2.0), ("3", "i", "t", None, "D", 8.0)]
    cleaned, scaler = C.clean_responses(spark.createDataFrame(rows, RAW), prefix="> ")
    got = {r.ID: r for r in cleaned.collect()}
    assert set(got) == {"1", "2"}  # the row without prompt is gone, but it set the maximum
    assert got["1"].label == 0.0 and got["2"].label == pytest.approx(0.4)
    assert got["2"].jrt == 4.0 and got["1"].text == "> t: p\na b"
    assert tuple(scaler.first()) == (0.0, 10.0)


def test_positive_minimum_shifts_up_and_constant_scores_give_zero(spark):
    rows = [("1", "i", "t", "p", "a", 3.0), ("2", "i", "t", "p", "b", 3.0)]
    cleaned, scaler = C.clean_responses(spark.createDataFrame(rows, RAW))
    assert {r.jrt for r in cleaned.collect()} == {6.0}
    assert {r.label for r in cleaned.collect()} == {0.0}


def test_holdout_branches(spark):
    scaler = spark.createDataFrame([(0.0, 10.0)], "data_min double, data_max double")
    rows = [("s", "1", "i", "p", "R", -5.0), ("s", None, "i", "p", "S", 10.0)]
    df = spark.createDataFrame(
        rows, "study_id string, response_id string, item string, prompt string, response string, jrt double"
    )
    got = C.clean_holdout(df, scaler).collect()
    assert [(r.ID, r.text, r.label) for r in got] == [("s-1", "p\nr", 0.0)]
    full = df.withColumns({"ID": F.lit("k"), "text": F.lit("kept"), "label": F.lit(0.3)}).drop("jrt")
    assert {(r.text, r.label) for r in C.clean_holdout(full, None).collect()} == {("kept", 0.3)}
    above = C.clean_holdout(df.na.fill("2", ["response_id"]), scaler)
    assert above.agg(F.max("label")).first()[0] == pytest.approx(1.5)


def test_missing_columns_are_named_and_absent_sources_skipped(spark):
    df = spark.range(1)
    with pytest.raises(ValueError, match="winner"):
        require_columns(df, ["id", "winner"])
    both = label_sources({"a": df, "b": None, "c": df.withColumn("x", F.lit(1))})
    assert {(r.dataset, r.x) for r in both.collect()} == {("a", None), ("c", 1)}
