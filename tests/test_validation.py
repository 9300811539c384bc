"""Parsing and validation against a plain brute-force checker."""

from __future__ import annotations

import json
import random
from decimal import Decimal

from pyspark.sql import functions as F

from recordloom.functions import jsontree, rules, text


def kinds(value):
    if value is None:
        return {"null"}
    if isinstance(value, bool):
        return {"boolean"}
    if isinstance(value, int):
        return {"integer", "number"}
    if isinstance(value, Decimal | float):
        return {"number"}
    if isinstance(value, str):
        return {"string"}
    return {"array"} if isinstance(value, list) else {"object"}


def violations(schema, value, path=""):
    out = set()
    if not isinstance(schema, dict):
        return out
    types = schema.get("type")
    if types is not None:
        types = [types] if isinstance(types, str) else types
        if not kinds(value) & set(types):
            out.add((path, "type"))
    if "enum" in schema and not any(
        type(value) is type(option) and value == option for option in schema["enum"]
    ):
        out.add((path, "enum"))
    if isinstance(value, dict):
        properties = schema.get("properties", {})
        out |= {(path, "required", k) for k in schema.get("required", []) if k not in value}
        if schema.get("additionalProperties") is False:
            out |= {(path, "extra", k) for k in value if k not in properties}
        for k, sub in properties.items():
            if k in value:
                out |= violations(sub, value[k], f"{path}/{k.replace('~', '~0').replace('/', '~1')}")
    if isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            out |= violations(schema["items"], item, f"{path}/{i}")
    return out


NAMES = ["a", "b", "c/d", "e~f", "g h"]


def random_schema(rng, depth):
    kind = rng.choice(["string", "integer", "number", "boolean", "object", "array", None])
    if depth == 0 and kind in ("object", "array"):
        kind = "string"
    schema = {}
    if kind:
        schema["type"] = rng.choice([kind, [kind, "null"], ["null", kind]])
    if kind == "string" and rng.random() < 0.4:
        schema["enum"] = rng.choice([["x", "y"], ["x", None]])
    if kind == "object":
        picked = rng.sample(NAMES, rng.randrange(1, 4))
        schema["properties"] = {k: random_schema(rng, depth - 1) for k in picked}
        schema["required"] = rng.sample(picked, rng.randrange(0, len(picked) + 1))
        if rng.random() < 0.5:
            schema["additionalProperties"] = False
    if kind == "array" and rng.random() < 0.8:
        schema["items"] = random_schema(rng, depth - 1)
    return schema


def random_value(rng, schema, depth):
    if rng.random() < 0.25 or not isinstance(schema, dict):
        return rng.choice(["x", "z", 1, 2.5, True, None, {"a": 1}, [1, "x"], 0, False])
    types = schema.get("type")
    kind = types if isinstance(types, str) else rng.choice(types or ["string"])
    if kind == "object":
        value = {
            k: random_value(rng, s, depth - 1)
            for k, s in schema.get("properties", {}).items()
            if rng.random() < 0.8
        }
        if rng.random() < 0.2:
            value["zz"] = 1
        return value
    if kind == "array":
        items = schema.get("items", {})
        return [random_value(rng, items, depth - 1) for _ in range(rng.randrange(0, 3))]
    return {"string": "x", "integer": 7, "number": 1.25, "boolean": True, "null": None}[kind]


def test_violations_match_brute_force(spark):
    rng = random.Random(7)
    rows, expected = [], {}
    for i in range(400):
        schema = {"type": "object", "properties": {}}
        while not schema["properties"]:
            schema = random_schema(rng, 4)
            if schema.get("type") != "object":
                schema = {"type": "object", "properties": {"a": schema}, "required": ["a"]}
        value = random_value(rng, schema, 4)
        if not isinstance(value, dict):
            value = {"a": value}
        rows.append((i, json.dumps(schema), json.dumps(value)))
        expected[i] = {v[:2] if v[1] in ("type", "enum") else v for v in violations(schema, value)}
    df = spark.createDataFrame(rows, "id long, schema_definition string, record string")
    levels = jsontree.measured_levels(df)
    compiled = rules.compile_rules(df, levels, ("id", "record"))
    compiled = compiled.withColumn("_r", text.parse_object(F.col("record")))
    judged = rules.with_violations(compiled, "_r", levels)
    for row in judged.select("id", "violations").collect():
        found = {
            (v.path, v.check) if v.check in ("type", "enum") else (v.path, v.check, v.detail)
            for v in row.violations
        }
        assert found == expected[row.id], rows[row.id]


def test_measured_levels_reach_the_deepest_rule(spark):
    inner: dict = {"type": "integer"}
    for _ in range(12):
        inner = {"type": "object", "properties": {"n": inner}, "required": ["n"]}
    value: object = "no integer"
    for _ in range(12):
        value = {"n": value}
    df = spark.createDataFrame(
        [(json.dumps(inner), json.dumps(value))], "schema_definition string, record string"
    )
    levels = jsontree.measured_levels(df)
    assert levels >= 12
    compiled = rules.compile_rules(df, levels, ("record",))
    compiled = compiled.withColumn("_r", text.parse_object(F.col("record")))
    (row,) = rules.with_violations(compiled, "_r", levels).select("violations").collect()
    assert [(v.path, v.check) for v in row.violations] == [("/n" * 12, "type")]


def lenient(content: str):
    start, end = content.find("{"), content.rfind("}")
    span = content[start : end + 1] if 0 <= start < end else ""
    try:
        value = json.loads(span, strict=False, parse_float=Decimal)
    except ValueError:
        return None
    return value


CASES = [
    'Sure:\n```json\n{"a": 1}\n```',
    "nothing here",
    '{"a":1} and {"a":2}',
    '{"a":1},{"a":2}',
    '{"a":\n1}',
    '{"a":"x\ty"}',
    '{"a":1,"a":2}',
    '{"a":{"b":{"c":{"d":{"e":1}}}}}',
    '{"a":12345678901234567890.12345678901234567}',
    "{'a':1}",
    "{a:1}",
    '{"a":01}',
    '{"a":[1,2,]}',
    '{"a":"\\u00e9\\n"}',
    '{"a":tru}',
    "{}",
    "} {",
    '{"a":"{"}',
]


def test_parsing_matches_the_reader_it_replaces(spark):
    rng = random.Random(11)
    cases = list(CASES)
    alphabet = '{}[]",:a1 \n\t'
    cases += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(2, 14))) for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(cases)), "id long, content string")
    span = text.json_span(F.trim("content"))
    parsed = df.select("id", F.to_json(text.parse_object(span)).alias("value")).collect()
    for row in parsed:
        expected = lenient(cases[row.id])
        if expected is None:
            assert row.value is None, cases[row.id]
        else:
            assert json.loads(row.value, parse_float=Decimal) == expected, cases[row.id]


def test_constants_that_are_no_json_are_refused(spark):
    df = spark.createDataFrame([('{"a":NaN}',), ('{"a":-Infinity}',)], "content string")
    assert df.filter(text.parse_object(F.col("content")).isNotNull()).count() == 0
