"""Special functions as columns, the ratio search and rank quality with p-values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge.functions.special import incomplete_beta, log_gamma, pearson_p_value
from rankforge.operators.evaluate import rating_metrics, student_t_tail
from rankforge.operators.split import response_ratios


def test_log_gamma(spark):
    values = [1e-3, 0.1, 0.5, 1.0, 1.5, 2.0, 7.3, 50.0, 1e4, 3e8]
    for r in spark.createDataFrame([(v,) for v in values], "z double").select("z", log_gamma(F.col("z")).alias("g")).collect():
        assert r.g == pytest.approx(math.lgamma(r.z), rel=1e-12, abs=1e-12)


def test_p_values_equal_the_scalar_form(spark):
    rng = random.Random(1)
    sizes = [2, 3, 4, 5, 10, 100, 10**5, 10**7]
    rows = [(rng.uniform(-1, 1) * rng.choice([1, 0.1, 0.001]), rng.choice(sizes)) for _ in range(400)]
    rows += [(0.0, 5), (1.0, 9), (-1.0, 4), (0.5, 1), (float("nan"), 5), (None, 5), (0.5, None)]
    df = spark.createDataFrame(rows, "r double, n long")
    for r in df.select("r", "n", pearson_p_value(F.col("r"), F.col("n")).alias("p")).collect():
        want = student_t_tail(r.r, r.n)
        assert (math.isnan(r.p) and math.isnan(want)) or r.p == pytest.approx(want, rel=1e-6, abs=1e-12)


def test_incomplete_beta_by_its_closed_forms(spark):
    """I_x(a, 1) is x**a and I_x(1, b) is 1 - (1 - x)**b."""
    rows = [(a, x) for a in (0.5, 1.0, 3.0, 40.0, 3000.0) for x in (0.0, 1e-9, 0.2, 0.5, 0.999, 1.0)]
    df = spark.createDataFrame(rows, "a double, x double")
    one, rest = F.lit(1.0), 1 - F.col("x")
    got = df.select("a", "x", incomplete_beta(F.col("a"), one, F.col("x"), rest).alias("p"), incomplete_beta(one, F.col("a"), F.col("x"), rest).alias("q"))
    for r in got.collect():
        assert r.p == pytest.approx(r.x**r.a, rel=1e-10, abs=1e-300)
        assert r.q == pytest.approx(1 - (1 - r.x) ** r.a, rel=1e-6, abs=1e-15)


def test_metrics_with_p_values_need_no_python_worker(spark):
    df = spark.createDataFrame([("a", i / 9, (i * 7 % 10) / 9) for i in range(10)], "g string, norm_response double, elo_normalized double")
    out = rating_metrics(df, ["g"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    row = out.first()
    assert row.p_value == pytest.approx(student_t_tail(row.pearson_r, 10))


def plain_ratios(sizes, val_ratio, test_ratio, tol):
    """The two bisections as plain loops."""
    n = np.array(sizes, dtype=np.int64)
    goals = np.array([1 - val_ratio - test_ratio, val_ratio, test_ratio])

    def shares(train, val):
        a, b = (n * train).astype(np.int64), (n * val).astype(np.int64)
        counts = np.array([float((m * (m - 1) // 2).sum()) for m in (a, b, n - a - b)])
        return counts / counts.sum() if counts.sum() else np.zeros(3)

    low, high = 0.40, 0.85
    for _ in range(30):
        train, vlow, vhigh = (low + high) / 2, 0.05, 0.25
        for _ in range(30):
            val = (vlow + vhigh) / 2
            got = shares(train, val)
            if abs(got[1] - val_ratio) < tol:
                break
            vlow, vhigh = (val, vhigh) if got[1] < val_ratio else (vlow, val)
        if (np.abs(got - goals) < tol).all():
            break
        low, high = (train, high) if got[0] < goals[0] else (low, train)
    return train, val


@pytest.mark.parametrize(("val", "test", "tol"), [(0.1, 0.2, 1e-3), (0.05, 0.3, 5e-3), (0.2, 0.2, 1e-9)])
def test_ratio_search_equals_plain_loops(spark, val, test, tol):
    sizes = [random.Random(3).choice([2, 5, 17, 60, 333]) + i % 4 for i in range(200)]
    rows = [(str(g), "t", "p") for g, n in enumerate(sizes) for _ in range(n)]
    df = spark.createDataFrame(rows, "item string, task string, prompt string")
    got = response_ratios(df, val, test, tol).first()
    assert tuple(got) == pytest.approx(plain_ratios(sizes, val, test, tol), abs=1e-12)


def test_ratio_search_without_pairs(spark):
    df = spark.createDataFrame([], "item string, task string, prompt string")
    assert response_ratios(df).count() == 1
    one = spark.createDataFrame([("a", "t", "p")], df.schema)
    assert tuple(response_ratios(one).first()) == pytest.approx(plain_ratios([1], 0.1, 0.2, 1e-3))
