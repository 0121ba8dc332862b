"""Rows move once on their way to their pairs."""

import re

from rankforge.operators.pairs import generate_pairs


def test_rows_move_once(spark, tmp_path):
    rows = [(f"id{i % 97}", f"item{i % 3}", "t", f"p{i % 7}", f"text {i % 89}", i % 5 / 4) for i in range(400)]
    df = spark.createDataFrame(rows, "ID string, item string, task string, prompt string, response string, label double")
    df.write.parquet(str(tmp_path / "rows"))
    pairs = generate_pairs(spark.read.parquet(str(tmp_path / "rows")))
    sizes = {}
    for r in rows:
        sizes[r[1:4]] = sizes.get(r[1:4], 0) + 1
    assert len(pairs.collect()) == sum(n * (n - 1) // 2 for n in sizes.values())
    plan = pairs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    moved = [x for x in plan.splitlines() if re.search(r"(?<!Reused)Exchange hashpartitioning", x) and "ReusedExchange" not in x]
    assert len(moved) == 1 and "ReusedExchange" in plan, plan
