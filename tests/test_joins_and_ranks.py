from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from recordloom.functions import joins
from recordloom.functions.ranking import number_rows, rank_in_group


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_is_the_same_beyond_the_broadcast_bound(spark, how):
    rng = random.Random(1)
    rows = [(i, "hot" if i % 3 == 0 else f"k{rng.randrange(50)}") for i in range(600)]
    left = spark.createDataFrame(rows, "id long, key string")
    right = spark.createDataFrame(
        [("hot", 0)] + [(f"k{i}", i) for i in range(30)], "key string, value long"
    )
    small = joins.lookup_join(left, right, ["key"], how, spread_by=["id"])
    large = joins.lookup_join(left, right, ["key"], how, spread_by=["id"], max_rows=5)
    plain = left.join(right, ["key"], how)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    assert sorted(small.collect()) == sorted(plain.collect())
    assert sorted(large.select(*plain.columns).collect()) == sorted(plain.collect())


def test_broadcast_check_counts_rows_and_bytes(spark):
    df = spark.range(100).withColumn("text", F.repeat(F.lit("x"), 1000))
    assert joins.fits_broadcast(df, 100, 200_000)
    assert not joins.fits_broadcast(df, 99, 200_000)
    assert not joins.fits_broadcast(df, 100, 50_000)


def test_hot_key_is_spread_by_the_salt(spark):
    left = spark.range(9_000).withColumn("key", F.lit("hot"))
    right = spark.createDataFrame([("hot", 1)], "key string, value long")
    joined = joins.lookup_join(left, right, ["key"], spread_by=["id"], max_rows=0)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in plan
    assert joined.count() == 9_000


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_beyond_the_bound_is_never_broadcast(spark, how):
    """Stored files are far smaller than the rows read from them."""
    left = spark.range(2_000).withColumn("key", F.col("id") % 50)
    right = spark.range(100).select(F.col("id").alias("key"), F.lit("x").alias("value"))
    for spread_by in ([], ["id"]):
        joined = joins.lookup_join(left, right, ["key"], how, spread_by=spread_by, max_rows=10)
        plan = joined._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=merge" in plan
        joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan


def test_only_right_rows_of_hot_keys_are_copied(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_ROWS", 100)
    hot = "CASE WHEN id < 3000 THEN NULL WHEN id < 6000 THEN 'hot' ELSE concat('k', id % 500) END"
    left = spark.range(9_000).withColumn("key", F.expr(hot))
    right = spark.sql("SELECT 'hot' AS key, 1L AS value UNION ALL SELECT concat('k', id), id FROM range(400)")
    copied = []
    explode = F.explode
    monkeypatch.setattr(joins.F, "explode", lambda array: copied.append(array) or explode(array))
    joined = joins.lookup_join(left, right, ["key"], "left", spread_by=["id"], max_rows=5)
    plain = left.join(right, ["key"], "left").select(*joined.columns)
    assert joined.exceptAll(plain).isEmpty() and plain.exceptAll(joined).isEmpty()
    keys = joins._marked(right, joins._hot_keys(left, ["key"]), ["key"])
    assert len(copied) == 1 and keys.select(explode(copied[0])).count() == 400 + joins.SALTS


def test_number_rows_is_a_total_order(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(20) if i % 3 else 7, i) for i in range(3_000)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(16)
    found = number_rows(df, ["a", "b"]).orderBy("row_no").collect()
    assert [(r.a, r.b) for r in found] == sorted(rows)
    assert [r.row_no for r in found] == list(range(1, len(rows) + 1))


def test_rank_in_group_with_one_dominant_group(spark):
    rng = random.Random(3)
    rows = [("hot", i) for i in rng.sample(range(5_000), 900)]
    rows += [(f"g{i % 40}", i) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, seq long")
    expected = {}
    for g in {r[0] for r in rows}:
        for rank, seq in enumerate(sorted(s for k, s in rows if k == g), 1):
            expected[(g, seq)] = rank
    for block in (7, 100, 100_000):
        found = rank_in_group(df, "g", "seq", block=block).collect()
        assert {(r.g, r.seq): r.rank_no for r in found} == expected
