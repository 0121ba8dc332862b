"""Sharding: the permutation, its inverse, the law of the shards, and odd rows."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankforge.llm import oracles, queries, sharding


@settings(max_examples=60, deadline=None)
@given(n=st.integers(1, 3000), seed=st.integers(0, 2**40))
def test_permutation_and_its_inverse(n, seed):
    rows = np.arange(n)
    places = sharding.permute(rows, n, seed)
    assert np.array_equal(np.sort(places), rows)
    assert np.array_equal(sharding.invert(places, n, seed), rows)


def test_places_of_single_numbers_and_large_tables():
    n, shards = 1000, 7
    for i in range(0, n, 13):
        shard, slot = sharding.locate(i, n, shards, 5)
        assert sharding.row_at(shard, slot, n, shards, 5) == i
    big = 10**15 + 7
    some = np.random.default_rng(1).integers(0, big, 2000)
    places = sharding.permute(some, big, 9)
    assert places.min() >= 0 and places.max() < big
    assert np.array_equal(sharding.invert(places, big, 9), some)
    # a shuffle: neighbours part, and shards take from everywhere
    near = sharding.permute(np.arange(100_000), 100_000, 3)
    assert abs(np.corrcoef(near[:-1], near[1:])[0, 1]) < 0.02
    with pytest.raises(ValueError):
        sharding.row_at(0, n, n, shards)


def check_law(rows, shards):
    n = len(rows)
    counts = Counter(r.shard for r in rows)
    assert all(n // shards <= counts[s] <= -(-n // shards) for s in range(shards))
    for s, c in counts.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(c))


def test_query_against_sql_and_zlib(spark, sf, texts):
    got = queries.op11_sharding(spark, sf).collect()
    check_law(got, 16)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw) and r.law == "rows" and r.grown_shard is None
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    found = con.execute(oracles.all_sql()["op11_sharding"])
    names = [c[0] for c in found.description]
    want = {tuple(sorted(zip(names, row))) for row in found.fetchall()}
    assert {tuple(sorted(r.asDict().items())) for r in got} == want


def test_same_on_any_partitioning(spark, documents):
    one = sharding.shard_documents(documents.repartition(7, "lang"), 5, 1).collect()
    two = sharding.shard_documents(documents.coalesce(1), 5, 1).collect()
    assert sorted(one) == sorted(two)
    other = sharding.shard_documents(documents, 5, 2).collect()
    assert sorted(one) != sorted(other)


def test_odd_rows(spark, odd, nothing):
    got = sharding.shard_documents(odd, 4).collect()
    check_law(got, 4)
    assert len(got) == odd.count() and [r for r in got if r.doc_id is None]
    nulls = [r for r in got if r.text_md5 is None]
    assert all(r.size == 1 and r.text_crc32 == 0 for r in nulls)
    assert sharding.shard_documents(nothing, 4).collect() == []
    check_law(sharding.shard_documents(odd.limit(3), 16).collect(), 16)
    with pytest.raises(ValueError):
        sharding.shard_rows(odd.select("doc_id", F.lit(1).alias("slot")), ["doc_id"], 3)


def test_one_row_repeated_is_split(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES_PER_RUN", 10)
    rows = spark.range(1000).select(F.when(F.col("id") < 700, F.lit(-1)).otherwise(F.col("id")).alias("doc_id"), F.lit("t").alias("text"))
    got = sharding.shard_documents(rows, 8).collect()
    check_law(got, 8)
    assert Counter(r.doc_id for r in got)[-1] == 700
    assert sorted(r.row_number for r in got) == list(range(1000))
    # copies of a text are spread like any other rows
    shares = Counter(r.shard for r in got if r.doc_id == -1)
    assert all(60 < c < 115 for c in shares.values())
