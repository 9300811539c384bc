from __future__ import annotations

from datetime import datetime, timedelta

from recordloom.operators import delivery, states

T0 = datetime(2024, 1, 1, 12)
STATES = "request_id string, status string, created_at timestamp_ntz"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def log(spark, *rows):
    return spark.createDataFrame([(r, s, at(t)) for r, s, t in rows], STATES)


def test_latest_state(spark):
    df = log(
        spark,
        ("a", "QUEUED", 0),
        ("b", "RUNNING", 5),
        ("b", "QUEUED", 1),
        ("c", "RUNNING", 1),
        ("c", "FAILED", 2),
        ("c", "RUNNING", 3),
        ("c", "COMPLETED", 4),
        ("d", "RUNNING", 9),
        ("d", "COMPLETED", 9),
    )
    found = {r.request_id: r.status for r in states.latest_states(df).collect()}
    assert found == {"a": "QUEUED", "b": "RUNNING", "c": "COMPLETED", "d": "COMPLETED"}


def results(spark, *rows):
    return spark.createDataFrame(
        rows,
        "request_id string, result string, error struct<error_name:string,error_message:string>, "
        "written_at timestamp_ntz",
    )


def test_results_by_status_and_unknown_ids(spark):
    df = log(spark, ("a", "QUEUED", 0), ("b", "COMPLETED", 1), ("c", "FAILED", 1))
    stored = states.latest_results(
        results(
            spark,
            ("b", '{"n":1}', None, at(1)),
            ("b", '{"n":2}', None, at(2)),
            ("c", None, ("InvalidData", "Data does not match schema"), at(2)),
        )
    )
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("z",), ("b",)], "request_id string")
    found = {r.request_id: r for r in states.results_for(asked, df, stored).collect()}
    assert found["b"].data == '{"n":2}' and found["b"].error is None
    assert found["c"].error.error_name == "InvalidData" and found["c"].data is None
    assert found["a"].status == "QUEUED" and found["a"].error is None
    assert found["z"].error.error_name == "RequestDoesNotExist"
    harvest = {r.request_id: (r.data, r.reason) for r in states.harvest(asked, df, stored).collect()}
    assert harvest == {
        "a": (None, "QUEUED"),
        "b": ('{"n":2}', None),
        "c": (None, "InvalidData"),
        "z": (None, "RequestDoesNotExist"),
    }


def test_stuck_after_the_visibility_timeout(spark):
    df = log(spark, ("a", "RUNNING", 0), ("b", "RUNNING", -1), ("c", "RUNNING", -50), ("c", "FAILED", 0))
    found = [r.request_id for r in delivery.stuck(df, at(300)).collect()]
    assert found == ["b"]


def test_dead_letters(spark):
    rows = [("a", "FAILED", t) for t in range(3)] + [("b", "FAILED", t) for t in range(4)]
    rows += [("b", "COMPLETED", 9), ("c", "FAILED", 0)]
    (row,) = delivery.dead_letters(log(spark, *rows)).collect()
    assert (row.request_id, row.failures) == ("a", 3)


def test_retention_bound(spark):
    day = 24 * 3600
    df = log(spark, ("old", "QUEUED", -14 * day - 1), ("edge", "QUEUED", -14 * day))
    assert [r.request_id for r in delivery.expired(df, T0).collect()] == ["old"]
    assert [r.request_id for r in delivery.retained(df, T0).collect()] == ["edge"]


def test_groups_of_ten(spark):
    df = log(spark, *[(f"e{i:02d}", "QUEUED", i) for i in range(21)])
    sizes = {}
    for r in delivery.invocations(df).collect():
        sizes.setdefault(r.invocation, []).append(r.request_id)
    assert {k: len(v) for k, v in sizes.items()} == {0: 10, 1: 10, 2: 1}
    assert sizes[2] == ["e20"]


def test_first_delivery_wins(spark):
    df = log(spark, ("a", "late", 5), ("a", "first", 1), ("b", "only", 2))
    found = {r.request_id: (r.status, r.deliveries) for r in delivery.first_deliveries(df).collect()}
    assert found == {"a": ("first", 2), "b": ("only", 1)}
