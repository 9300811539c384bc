from __future__ import annotations

import json

import pytest

from recordloom.operators import recordtypes

ROWS = "schema_name string, schema_version string, schema_definition string"


def registry(spark, *rows):
    return spark.createDataFrame(
        [(n, str(v), json.dumps({"type": "object", "properties": p})) for v, (n, p) in enumerate(rows)],
        ROWS,
    )


def of(kind):
    return {"type": kind}


def test_types_are_the_least_above_all_versions(spark):
    tree = {"o": {"type": "object", "properties": {"l": {"type": "array", "items": of("integer")}}}}
    wider = {"o": {"type": "object", "properties": {"l": {"type": "array", "items": of("number")},
                                                    "new": of(["boolean", "null"])}}}
    rows = registry(
        spark,
        ("tree", tree),
        ("tree", wider),
        ("tree", wider),
        ("mixed", {"a": of("string"), "b": of("null"), "c": {}, "d/e`~": of("integer")}),
        ("mixed", {"a": of(["integer", "null"])}),
        ("cases", {"x": {"type": "object", "properties": {"k": of("string"), "K": of("string")}}}),
        ("bare", {"x": of("object"), "y": of("array")}),
        ("nothing", {}),
    )
    found = {r.schema_name: r.record_type for r in recordtypes.record_types(rows).collect()}
    assert found == {
        "tree": "struct<`o`:struct<`l`:array<decimal(38,9)>,`new`:boolean>>",
        "mixed": "struct<`a`:variant,`b`:variant,`c`:variant,`d/e``~`:bigint>",
        "cases": "struct<`x`:variant>",
        "bare": "struct<`x`:variant,`y`:array<variant>>",
    }
    assert recordtypes.record_types(rows.limit(0)).count() == 0


def test_results_are_written_once_per_type(spark, tmp_path):
    rows = registry(
        spark,
        ("a", {"n": of("integer"), "t": {"type": "array", "items": of("string")}}),
        ("b", {"n": of("integer"), "t": {"type": "array", "items": of("string")}}),
        ("c", {"n": of("number"), "v": {}}),
    )
    types = recordtypes.record_types(rows)
    results = spark.createDataFrame(
        [
            ("r1", "a", '{"n":1,"t":["x"]}'),
            ("r1", "a", '{"n":1,"t":["x"]}'),
            ("r2", "b", '{"n":2,"t":[]}'),
            ("r3", "c", '{"n":2.5,"v":{"k":1}}'),
            ("r4", "a", None),
            (None, "b", "no record"),
            ("r5", "unknown", "{}"),
            ("r6", None, "{}"),
        ],
        "request_id string, schema_name string, result string",
    )
    with pytest.raises(ValueError):
        recordtypes.write_typed(results, types, str(tmp_path / "few"), most=1)
    out = str(tmp_path / "typed")
    found = recordtypes.write_typed(results, types, out)
    assert found == ["struct<`n`:bigint,`t`:array<string>>", "struct<`n`:decimal(38,9),`v`:variant>"]
    shared = spark.read.parquet(f"{out}/type=0").selectExpr("request_id", "record.n", "record.t")
    assert sorted(map(tuple, shared.collect()), key=repr) == sorted(
        [("r1", 1, ["x"]), ("r1", 1, ["x"]), ("r2", 2, []), ("r4", None, None), (None, None, None)],
        key=repr,
    )
    other = spark.read.parquet(f"{out}/type=1").selectExpr("record.n", "to_json(record.v) as v")
    assert [(str(r.n), r.v) for r in other.collect()] == [("2.500000000", '{"k":1}')]
