from __future__ import annotations

from recordloom.plans import queries
from recordloom.plans.derived import view
from recordloom.sources import documents


def test_narrow_rows_are_dealt_to_tasks_by_their_number(spark):
    rows = spark.range(1_000, numPartitions=spark.sparkContext.defaultParallelism)
    assert documents.spread(rows, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    dealt = documents.spread(rows, "id", rows=10)
    assert dealt.rdd.getNumPartitions() == 100
    assert dealt.count() == 1_000


def test_records_to_validate_are_dealt_by_their_number(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(queries, "RECORDS_A_TASK", 50)
    found = queries.e7_bounds(spark, sf_dir)
    assert found.rdd.getNumPartitions() >= view(spark, sf_dir, "bounded_records").count() // 50


def test_one_large_split_among_many_is_dealt_out(spark):
    """Splits without rows do not make up for one that has all of them."""
    rows = spark.range(1_000, numPartitions=1).union(spark.range(0, numPartitions=200))
    dealt = documents.spread(rows, "id", rows=50)
    assert max(dealt.rdd.glom().map(len).collect()) < 200


def test_results_are_sorted_in_tasks_of_bounded_size(spark, sf_dir, monkeypatch):
    plain = sorted(queries.m8_harvest(spark, sf_dir).collect())
    monkeypatch.setattr(queries, "RESULTS_A_TASK", 20)
    rows = queries._results(spark, sf_dir)
    assert rows.rdd.getNumPartitions() >= rows.count() // 20
    assert sorted(queries.m8_harvest(spark, sf_dir).collect()) == plain
