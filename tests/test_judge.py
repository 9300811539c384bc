"""Judging of combined schemas: work in proportion to the records, results as before."""

from __future__ import annotations

import json
import os
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from recordloom.functions import jsontree, judge, rules
from recordloom.plans import queries
from recordloom.plans.derived import _COMBINED
from tests.test_keywords import judged

SECONDS = 30  # for one large record; two or three are enough


def schema_of(spark, definition):
    compiled = rules.compile_rules(spark.createDataFrame([(definition,)], "schema_definition string"), None, ())
    return judge.Schema(compiled.selectExpr("rules['']['program'] AS p").first().p)


def value_of(x):
    if isinstance(x, dict):
        return "object", {k: value_of(y) for k, y in x.items()}
    if isinstance(x, list):
        return "array", [value_of(y) for y in x]
    names = {bool: "boolean", int: "integer", float: "number", str: "string", type(None): "null"}
    return names[type(x)], x


def found_in_time(spark, definition, record):
    judged(spark, [(0, definition, "{}")]).collect()
    begun = time.monotonic()
    (row,) = judged(spark, [(0, definition, json.dumps(record))]).collect()
    assert time.monotonic() - begun < SECONDS
    return sorted((v.path, v.check, v.detail) for v in row.violations)


@pytest.mark.parametrize("name", ["e7_ref", "e7_patterns", "e7_combinators", "e7_positions"])
def test_records_are_judged_in_one_arrow_step(spark, sf_dir, name):
    """Rows bring a text of their rules; no loop over a record is left in the plan."""
    plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert "lambdafunction" not in plan and "aggregate(" not in plan


def chain(length):
    record = {"value": "s"}
    for depth in range(length):
        record = {"value": 81 if depth % 100 == 0 else 1, "child": record}
    return record


def test_a_deep_record_is_followed_through_its_references_once(spark, monkeypatch):
    """e7_ref: members of a schema that refers to itself."""
    schema, visits = schema_of(spark, _COMBINED), []
    parts = judge.Rule.parts
    monkeypatch.setattr(judge.Rule, "parts", lambda r, *value: visits.append(r) or parts(r, *value))
    found = judge.violations(schema.root, *value_of(chain(900)))
    assert [w for w in found if w[1] == "type"] == [("/child" * 900 + "/value", "type", "string")]
    assert len([w for w in found if w[1] == "maximum"]) == 9
    assert len(visits) < 2 * 900 + 10


def test_a_deep_record_comes_through_whole(spark):
    found = found_in_time(spark, _COMBINED, chain(900))
    high = [path for path, check, _ in found if check == "maximum"]
    assert sorted(map(len, high)) == [len("/child" * n + "/value") for n in range(99, 900, 100)]
    assert ("/child" * 900 + "/value", "type", "string") in found


def test_a_definition_is_measured_once_for_all_rows_it_was_taken_from(spark):
    rows = spark.range(1_000).selectExpr("id % 5 AS k", "concat('{\"properties\":{\"a\":', id % 5, '}}') AS schema_definition")
    assert jsontree.measured_levels(rows.distinct()) == 1
    plan = jsontree._measured(rows.distinct(), "schema_definition")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2  # the rows are made distinct before


class Counted:
    def __init__(self, pattern, searched):
        self.pattern, self.searched = pattern, searched

    def search(self, name):
        self.searched.append(name)
        return self.pattern.search(name)


def test_a_name_is_searched_once_for_each_pattern(spark):
    """e7_patterns: members that patterns, names and nothing apply to."""
    definition = {"patternProperties": {"^x[0-9]+$": {"maximum": 2}, "9$": {"minimum": 1}},
                  "propertyNames": {"pattern": "^[a-z0-9]+$"}}
    schema, searched = schema_of(spark, json.dumps(definition)), []
    schema.root.fitting = [(Counted(p, searched), rule) for p, rule in schema.root.fitting]
    record = {f"{'x' if i % 2 else 'Y'}{i}": i % 4 for i in range(1_000)}
    found = judge.violations(schema.root, *value_of(record))
    assert len(searched) == 2 * len(record)
    want = {(f"/{k}", "maximum") for k, v in record.items() if k[0] == "x" and v > 2}
    want |= {(f"/{k}", "minimum") for k, v in record.items() if k[-1] == "9" and v < 1}
    want |= {(f"/{k}", "pattern") for k in record if k[0] == "Y"}
    assert {w[:2] for w in found} == want


@pytest.mark.parametrize("pattern, fits, fails", [
    (r"\b*x$", "y x", "y"), (r"\\b*", "\\bb", "b"), (r"[\w.]+@", "ünï.x@", "@"), (r"^\S+$", "a-b", "a b"),
    (".", "é", "\n"), ("^(?:a|b){2,3}$", "aba", "a"),
])
def test_patterns_mean_the_same_in_a_worker(pattern, fits, fails):
    assert judge.expression(pattern).search(fits) and not judge.expression(pattern).search(fails)


def test_values_come_back_as_the_canonical_text_of_spark(spark):
    texts = ["5", "5.0", "-0.0", "1.50", "1e5", "1E-7", "1e7", "0.001e0", "-1.5e300", "4.9e-324", "1e400", "1" + "0" * 40,
             "100000000000000000000", "12345678901234567890.0", "0.00000000001", "-129", "40000", "-9223372036854775808",
             r'"\u0001\u001f\b\n\"\\é"', '"' + "long" * 40 + '"', '{"b":[1,null,{"z":0.50}],"a":true,"":[]}',
             json.dumps({f"k{i}": [i] * 3 for i in range(400)}), json.dumps(list(range(300)))]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("v", F.try_parse_json("t"))
    for row in df.select("t", "v", F.to_json("v").alias("j"), F.expr(jsontree.kind("v")).alias("k")).collect():
        value = judge.value_at(bytes(row.v.value), 0, judge._names(bytes(row.v.metadata)))
        assert (value[0], judge.json_text(value)) == (row.k, row.j), row.t


def test_reals_are_compared_as_numbers_whatever_their_text():
    assert judge._same_reals('[1.9999999999999998E23,"2E5",{"a":null,"b":1.0E-7}]') == '[2.0E23,"2E5",{"a":null,"b":1.0E-7}]'
    assert judge.real_text(2e23) == "2.0E23" and judge.real_text(1.5e-5) == "1.5E-5"


def test_a_failing_combinator_of_many_items_costs_each_item_once(spark):
    """e7_combinators: ten thousand values, each with three branches."""
    definition = {"properties": {"a": {"items": {"anyOf": [{"maximum": 20}, {"minimum": 60}, {"multipleOf": 10}]}}}}
    numbers = [i % 100 for i in range(10_000)]
    found = found_in_time(spark, json.dumps(definition), {"a": numbers})
    assert found == sorted((f"/a/{i}", "anyOf", "0") for i, x in enumerate(numbers) if 20 < x < 60 and x % 10)


def test_positions_in_many_lists_cost_each_item_once(spark):
    """e7_positions: five thousand lists, in each the items by place and how many fit."""
    tags = {"prefixItems": [{"const": 1}, {"enum": [1, 2]}], "items": False, "contains": {"const": 1}, "maxContains": 1}
    lists = [[1, 1 + i % 3, 5][: 1 + i % 3] for i in range(5_000)]
    found = found_in_time(spark, json.dumps({"properties": {"a": {"items": tags}}}), {"a": lists})
    want = [(f"/a/{i}/1", "enum", "3") for i, x in enumerate(lists) if len(x) > 1 and x[1] > 2]
    want += [(f"/a/{i}/2", "never", "integer") for i, x in enumerate(lists) if len(x) > 2]
    want += [(f"/a/{i}", "contains", "2") for i, x in enumerate(lists) if x.count(1) > 1]
    assert found == sorted(want) and want


def test_leftovers_of_a_deep_record_are_not_asked_twice_at_each_level(spark):
    tree = {"anyOf": [{"properties": {"next": {"$ref": "#"}}}], "properties": {"v": {"maximum": 1}},
            "unevaluatedProperties": False}
    record = {"v": 1, "odd": 1}
    for _ in range(40):
        record = {"v": 1, "next": record, "odd": 1}
    found = found_in_time(spark, json.dumps(tree), record)
    assert found == [("", "anyOf", "0"), ("", "unevaluatedProperties", "next"), ("", "unevaluatedProperties", "odd")]


def test_workers_need_not_have_the_package(spark):
    """The function is pickled without a reference to this package."""
    from pyspark import cloudpickle

    column = []
    wrapped = judge.F.arrow_udf
    try:
        judge.F.arrow_udf = lambda kind: lambda f: column.append(f) or wrapped(kind)(f)
        judge.judged(F.lit(None), F.lit(None), rules.VIOLATIONS)
    finally:
        judge.F.arrow_udf = wrapped
    code = "import sys, pickle; f = pickle.load(sys.stdin.buffer); import pyarrow as pa; " \
        "v = pa.StructArray.from_arrays([pa.array([b'\\x0c\\x01']), pa.array([b'\\x01\\x00\\x00'])], ['value', 'metadata']); " \
        "p = pa.array(['{\"\":{\"types\":[\"string\"],\"checks\":[\"type\"]}}']); print(f(v, p).to_pylist())"  # fmt: skip
    done = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(column[0]), capture_output=True,
                          cwd="/", env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.stdout.decode().strip() == "[[{'path': '', 'check': 'type', 'detail': 'integer'}]]", done.stderr
