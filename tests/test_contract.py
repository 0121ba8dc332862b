"""The registered queries against their SQL, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_module

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
QUICK = [
    "dup_average", "doc_dedupe", "minmax_label", "holdout_label", "pairs_events", "difficulty_report",
    "split_assign", "pair_ratio_eval", "pair_sample", "leakage_removed", "prompt_text", "verdict_parse",
    "classification_summary", "running_metrics", "pass_summary", "items_from_pairs",
    "elo_sync_3rounds", "checkpoint_summary", "csv_roundtrip", "elo_replay_2rounds", "elo_sweep_2rounds",
    "elo_random_rounds", "rating_p_values", "response_ratios", "stream_running_metrics", "stream_ratings",
    "refreshed_summary", "verdict_python_scorer", "latest_written", "passes_stamp",
]


def test_registry_and_oracles_agree():
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    assert set(oracles) <= set(queries) and set(QUICK) <= set(oracles)


def test_entry(spark):
    assert entry_module.entry(spark).count() == 4


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = entry_module.queries()[name](spark, sf)
    cols = sorted(df.columns)
    want = con.execute(entry_module.oracle_sql()[name]).df()
    assert sorted(want.columns) == cols

    def rows(pdf):
        out = []
        for r in pdf[cols].itertuples(index=False, name=None):
            out.append(tuple(None if v is None or v != v else v for v in r))
        return sorted(out, key=str)

    got, ref = rows(df.toPandas()), rows(want)
    assert len(got) == len(ref)
    for g, w in zip(got, ref):
        for x, y in zip(g, w):
            same = x == y or (isinstance(x, float) and math.isclose(x, y, abs_tol=2e-6))
            assert same, (name, g, w)
