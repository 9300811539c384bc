"""Combinators, references, patterns and positions against a plain checker."""

from __future__ import annotations

import json
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from recordloom.functions import jsontree, rules, text
from recordloom.operators import registry
from tests.test_validation import kinds


def step(key):
    return str(key).replace("~", "~0").replace("/", "~1")


def resolved(root, ref):
    if ref.startswith("#") and (ref == "#" or ref[1] == "/"):
        node = root
        for part in ref[2:].split("/") if ref != "#" else []:
            part = part.replace("~1", "/").replace("~0", "~")
            node = node[int(part)] if isinstance(node, list) else node[part]
        return node
    return root["$defs"]["other"]  # the only anchor


def equal(a, b):
    return type(a) is type(b) and a == b


def broken(root, schema, value, path=""):
    """(path, keyword) of everything wrong, as the keywords are published."""
    out = set()
    if schema is False:
        return {(path, "never")}
    if schema is True:
        return out

    def at(sub, item=value, where=path):
        return broken(root, sub, item, where)

    types = schema.get("type")
    if types is not None and not kinds(value) & set([types] if isinstance(types, str) else types):
        out.add((path, "type"))
    if "enum" in schema and not any(equal(value, o) for o in schema["enum"]):
        out.add((path, "enum"))
    if "const" in schema and not equal(value, schema["const"]):
        out.add((path, "const"))
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        out.add((path, "pattern"))
    if isinstance(value, int | float) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            out.add((path, "minimum" if value < schema.get("minimum", value) else "maximum"))
        if "exclusiveMinimum" in schema and value <= schema["exclusiveMinimum"]:
            out.add((path, "exclusiveMinimum"))
        of = schema.get("multipleOf")
        if of and Fraction(str(value)) % Fraction(str(of)):
            out.add((path, "multipleOf"))
    if isinstance(value, dict):
        named, by = schema.get("properties", {}), schema.get("patternProperties", {})
        out |= {(path, "required") for k in schema.get("required", []) if k not in value}
        for k, needed in schema.get("dependentRequired", {}).items():
            if k in value and any(n not in value for n in needed):
                out.add((path, "dependentRequired"))
        if len(value) < schema.get("minProperties", 0):
            out.add((path, "minProperties"))
        for k, item in value.items():
            where = f"{path}/{step(k)}"
            hits = [s for p, s in by.items() if re.search(p, k)]
            if k in named:
                out |= at(named[k], item, where)
            for sub in hits:
                out |= at(sub, item, where)
            if k not in named and not hits and "additionalProperties" in schema:
                other = schema["additionalProperties"]
                out |= {(path, "extra")} if other is False else at(other, item, where)
            if "propertyNames" in schema:
                out |= at(schema["propertyNames"], k, where)
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0):
            out.add((path, "minItems"))
        if schema.get("uniqueItems") and len({json.dumps(item) for item in value}) < len(value):
            out.add((path, "uniqueItems"))
        first = schema.get("prefixItems", [])
        for i, item in enumerate(value):
            if i < len(first):
                out |= at(first[i], item, f"{path}/{i}")
            elif "items" in schema:
                out |= at(schema["items"], item, f"{path}/{i}")
        if "contains" in schema:
            n = sum(not at(schema["contains"], item) for item in value)
            if not schema.get("minContains", 1) <= n <= schema.get("maxContains", n):
                out.add((path, "contains"))
    if "$ref" in schema:
        out |= at(resolved(root, schema["$ref"]))
    for sub in schema.get("allOf", []):
        out |= at(sub)
    if "anyOf" in schema and all(at(s) for s in schema["anyOf"]):
        out.add((path, "anyOf"))
    if "oneOf" in schema and sum(not at(s) for s in schema["oneOf"]) != 1:
        out.add((path, "oneOf"))
    if "not" in schema and not at(schema["not"]):
        out.add((path, "not"))
    if "if" in schema:
        branch = "else" if at(schema["if"]) else "then"
        out |= at(schema.get(branch, True))
    if isinstance(value, dict):
        for k, sub in schema.get("dependentSchemas", {}).items():
            out |= at(sub) if k in value else set()
    for keyword, kind in (("unevaluatedProperties", dict), ("unevaluatedItems", list)):
        if keyword in schema and isinstance(value, kind):
            seen = evaluated(root, {k: v for k, v in schema.items() if k != keyword}, value)
            rest = value.items() if kind is dict else enumerate(value)
            if any(k not in seen and at(schema[keyword], item) for k, item in rest):
                out.add((path, keyword))
    return out


def evaluated(root, schema, value):
    """Names or places that a schema and those combined in it speak of, a failing
    ``allOf`` or reference included, since the value fails with it."""
    if not isinstance(schema, dict) or not isinstance(value, dict | list):
        return set()

    def below(sub):
        return evaluated(root, sub, value)

    seen = set()
    if isinstance(value, dict):
        by = schema.get("patternProperties", {})
        seen |= {k for k in value if k in schema.get("properties", {}) or any(re.search(p, k) for p in by)}
        if "additionalProperties" in schema or "unevaluatedProperties" in schema:
            seen |= set(value)
        for k, sub in schema.get("dependentSchemas", {}).items():
            seen |= below(sub) if k in value else set()
    else:
        seen |= set(range(min(len(schema.get("prefixItems", [])), len(value))))
        if "items" in schema or "unevaluatedItems" in schema:
            seen |= set(range(len(value)))
        if "contains" in schema:
            seen |= {i for i, item in enumerate(value) if not broken(root, schema["contains"], item)}
    for sub in schema.get("allOf", []):
        seen |= below(sub)
    if "$ref" in schema:
        seen |= below(resolved(root, schema["$ref"]))
    for sub in [*schema.get("anyOf", []), *schema.get("oneOf", [])]:
        seen |= set() if broken(root, sub, value) else below(sub)
    if "if" in schema:
        if broken(root, schema["if"], value):
            seen |= below(schema.get("else", True))
        else:
            seen |= below(schema["if"]) | below(schema.get("then", True))
    return seen


KEYS = ["a", "b", "c/d", "x1", "x2"]
REFS = ["#", "#/$defs/leaf", "#/$defs/tree", "#marked", "#/$defs/c~1d", "#/properties/a"]


def random_schema(rng, depth):
    roll = rng.random()
    if depth == 0 or roll < 0.15:
        return rng.choice([
            {"type": "integer"}, {"type": ["string", "null"]}, {"enum": ["x", 1, None]}, True, False,
            {"const": 2}, {"pattern": "^x[0-9]*$"}, {"minimum": 1}, {"multipleOf": 2}, {"type": "object"},
        ])
    if roll < 0.25:
        return {"$ref": rng.choice(REFS)}

    def sub():
        return random_schema(rng, depth - 1)

    schema = {}
    for keyword in rng.sample(["anyOf", "oneOf", "allOf", "not", "if", "object", "array", "type"], rng.randrange(1, 4)):
        if keyword in ("anyOf", "oneOf", "allOf"):
            schema[keyword] = [sub() for _ in range(rng.randrange(1, 4))]
        elif keyword == "not":
            schema["not"] = sub()
        elif keyword == "if":
            schema |= {"if": sub()} | {k: sub() for k in ("then", "else") if rng.random() < 0.7}
        elif keyword == "type":
            schema["type"] = rng.choice(["object", "array", "string", ["integer", "object"]])
        elif keyword == "object":
            schema["properties"] = {k: sub() for k in rng.sample(KEYS, 2)}
            if rng.random() < 0.5:
                schema["patternProperties"] = {rng.choice(["^x", "[12]$"]): sub()}
            if rng.random() < 0.5:
                schema["additionalProperties"] = rng.choice([False, sub()])
            if rng.random() < 0.3:
                schema["propertyNames"] = {"pattern": "^[a-x0-9/]+$"}
            if rng.random() < 0.3:
                schema["dependentRequired"] = {"a": ["b"]}
            if rng.random() < 0.3:
                schema |= {"required": ["a"], "minProperties": 2}
        else:
            schema["prefixItems"] = [sub()]
            if rng.random() < 0.6:
                schema["items"] = sub()
            if rng.random() < 0.5:
                schema["contains"] = sub()
                if rng.random() < 0.4:
                    schema |= {"minContains": rng.randrange(3), "maxContains": 2}
    return schema


def random_value(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice(["x", "x1", "z", 1, 2, 3, 2.5, True, None])
    if rng.random() < 0.4:
        return [random_value(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {k: random_value(rng, depth - 1) for k in rng.sample(KEYS, rng.randrange(4))}


def circular(root, schema, met=()):
    """Whether a schema refers to itself without going into a value; a plain checker
    would not end."""
    if not isinstance(schema, dict):
        return False
    if id(schema) in met:
        return True
    met = (*met, id(schema))
    below = [*schema.get("allOf", []), *schema.get("anyOf", []), *schema.get("oneOf", [])]
    below += [schema[k] for k in ("not", "if", "then", "else") if k in schema]
    below += schema.get("dependentSchemas", {}).values()
    below += [resolved(root, schema["$ref"])] if "$ref" in schema else []
    return any(circular(root, s, met) for s in below)


def anything_circular(root, node):
    if isinstance(node, dict) and circular(root, node):
        return True
    below = node.values() if isinstance(node, dict) else node if isinstance(node, list) else []
    return any(anything_circular(root, x) for x in below)


def judged(spark, rows):
    df = spark.createDataFrame(rows, "id long, schema_definition string, record string")
    compiled = rules.compile_rules(df, None, ("id", "record"))
    compiled = compiled.withColumn("_r", text.parse_object(F.col("record")))
    return rules.with_violations(compiled, "_r").select("id", "violations")


def test_random_combinations_match_the_plain_checker(spark):
    rng = random.Random(21)
    rows, expected = [], {}
    while len(rows) < 500:
        root = {
            "type": "object",
            "properties": {k: random_schema(rng, 3) for k in ["a", *rng.sample(KEYS[1:], 2)]},
            "$defs": {
                "leaf": random_schema(rng, 1), "tree": random_schema(rng, 2), "c/d": random_schema(rng, 1),
                "other": {"$anchor": "marked", "type": ["integer", "string"]},
            },
        }
        if anything_circular(root, root):
            continue
        value = {k: random_value(rng, 3) for k in rng.sample(KEYS, 3)}
        expected[len(rows)] = broken(root, root, value)
        rows.append((len(rows), json.dumps(root), json.dumps(value)))
    for row in judged(spark, rows).collect():
        assert {(v.path, v.check) for v in row.violations} == expected[row.id], rows[row.id]
    assert sum(map(bool, expected.values())) > 100 and sum(not x for x in expected.values()) > 50


def with_leftovers(rng, schema):
    """Some of the objects of a schema get keywords for what nothing else speaks of."""
    if isinstance(schema, list):
        return [with_leftovers(rng, s) for s in schema]
    if not isinstance(schema, dict):
        return schema
    out = {k: with_leftovers(rng, v) if k not in ("enum", "required", "const") else v for k, v in schema.items()}
    named = {"anyOf", "oneOf", "allOf", "if", "prefixItems", "properties", "dependentRequired", "minProperties"}
    if out.keys() & named and not isinstance(schema.get("properties"), list) and rng.random() < 0.5:
        out["unevaluatedProperties"] = rng.choice([False, False, {"type": "integer"}])
        if rng.random() < 0.5:
            out["dependentSchemas"] = {rng.choice(KEYS): {"properties": {k: True for k in rng.sample(KEYS, 2)}}}
    if out.keys() & named and rng.random() < 0.5:
        out["unevaluatedItems"] = rng.choice([False, {"type": "string"}])
    return out


def test_random_leftovers_match_the_plain_checker(spark):
    rng = random.Random(5)
    rows, expected = [], {}
    while len(rows) < 500:
        a = [random_schema(rng, 2) for _ in range(3)]
        lists = {"type": "array", "anyOf": [{"prefixItems": [a[0]]}, {"contains": a[1]}, {"items": a[2]}]}
        root = {
            "properties": {"a": random_schema(rng, 3), "x1": lists},
            "allOf": [random_schema(rng, 2), {"patternProperties": {"^c": True}}],
            "$defs": {
                "leaf": random_schema(rng, 1), "tree": random_schema(rng, 2), "c/d": random_schema(rng, 1),
                "other": {"$anchor": "marked", "type": ["integer", "string"]},
            },
        }
        root = with_leftovers(rng, root)
        root.setdefault("unevaluatedProperties", {"type": ["integer", "array"]})
        if anything_circular(root, root):
            continue
        value = {k: random_value(rng, 3) for k in rng.sample(KEYS, 3)} | {"x1": random_value(rng, 2)}
        expected[len(rows)] = broken(root, root, value)
        rows.append((len(rows), json.dumps(root), json.dumps(value)))
    for row in judged(spark, rows).collect():
        assert {(v.path, v.check) for v in row.violations} == expected[row.id], rows[row.id]
    for keyword in ("unevaluatedProperties", "unevaluatedItems"):
        assert sum(any(c == keyword for _, c in found) for found in expected.values()) > 40


def test_leftovers_are_named(spark):
    schema = {"properties": {"a": True}, "dependentSchemas": {"a": {"properties": {"b/c": {"type": "integer"}}}},
              "unevaluatedProperties": False}
    cases = [('{"a":1,"b/c":1}', []), ('{"a":1,"b/c":"x"}', [("/b~1c", "type", "string")]),
             ('{"b/c":1,"~d":2}', [("", "unevaluatedProperties", "b/c"), ("", "unevaluatedProperties", "~d")])]
    rows = [(i, json.dumps(schema), record) for i, (record, _) in enumerate(cases)]
    found = {r.id: sorted((v.path, v.check, v.detail) for v in r.violations) for r in judged(spark, rows).collect()}
    assert found == {i: want for i, (_, want) in enumerate(cases)}


def test_a_tree_schema_follows_a_deep_record(spark):
    tree = {
        "$defs": {"node": {
            "type": "object", "required": ["value"], "additionalProperties": False,
            "properties": {"value": {"type": "integer"}, "next": {"$ref": "#/$defs/node"},
                           "more": {"type": "array", "items": {"$ref": "#/$defs/node"}}},
        }},
        "$ref": "#/$defs/node",
    }
    deep = {"value": "no integer"}
    for _ in range(60):
        deep = {"value": 1, "next": deep}
    wide = {"value": 1, "more": [{"value": i, "more": [{"value": 1}, {}]} for i in range(20)]}
    rows = [(0, json.dumps(tree), json.dumps(deep)), (1, json.dumps(tree), json.dumps(wide))]
    found = {r.id: sorted((v.path, v.check) for v in r.violations) for r in judged(spark, rows).collect()}
    assert found[0] == [("/next" * 60 + "/value", "type")]
    assert found[1] == sorted((f"/more/{i}/more/1", "required") for i in range(20))


def test_references_in_a_circle_and_lost_ones_end(spark):
    circle = {"allOf": [{"$ref": "#"}, {"$ref": "#/$defs/a"}], "$defs": {"a": {"anyOf": [{"$ref": "#"}, {"$ref": "#/$defs/a"}]}}, "required": ["x"]}
    lost = {"properties": {"a": {"$ref": "#/$defs/none"}}}
    rows = [(0, json.dumps(circle), '{"y":1}'), (1, json.dumps(lost), '{"a":1}'), (2, json.dumps(lost), "{}")]
    found = {r.id: [(v.path, v.check) for v in r.violations] for r in judged(spark, rows).collect()}
    assert ("", "required") in found[0]
    assert found[1] == [("/a", "$ref")] and found[2] == []


def test_bounds_of_integers_are_exact(spark):
    schema = json.dumps({"properties": {"a": {"maximum": 9007199254740992, "multipleOf": 1}, "b": {"multipleOf": 0.1}, "c": {"maximum": 1.5}}})
    cases = [('{"a":9007199254740993}', ["maximum"]), ('{"a":9007199254740992}', []), ('{"b":0.3}', []),
             ('{"b":0.35}', ["multipleOf"]), ('{"c":2}', ["maximum"]), ('{"c":1.5}', [])]
    rows = [(i, schema, record) for i, (record, _) in enumerate(cases)]
    found = {r.id: [v.check for v in r.violations] for r in judged(spark, rows).collect()}
    assert found == {i: want for i, (_, want) in enumerate(cases)}


GOOD = ["^x[0-9]{2,3}$", "a|b(c|(?:d|e)+)?", r"\d+\.\d*", "[^a-z_-]", "(?=x)x.*", "", "^$", "ünï", "a{0,4}?", r"[\w.]+@[\w]+"]
BAD = ["(", "a)", "[a", "[z-a]", "a{3,2}", "(?P<n>a)", r"(a)\1", "a++", "[a&&b]", "(?i)a", "*a", r"\p{L}", "a**", "[[a]]", r"[a-\.]"]


@pytest.mark.parametrize("place", ["pattern", "patternProperties"])
def test_patterns_that_would_differ_are_refused(spark, place):
    rows = []
    for pattern in GOOD + BAD:
        body = {"pattern": pattern} if place == "pattern" else {"patternProperties": {pattern: True}}
        rows.append((pattern, json.dumps({"properties": {"a": body}})))
    df = spark.createDataFrame(rows, "p string, schema_definition string")
    found = {r.p: r.problems for r in registry.check_definitions(df).collect()}
    assert {p for p, problems in found.items() if problems} == set(BAD)


def test_definitions_records_cannot_be_held_against_are_refused(spark):
    rows = [
        ('{"properties":{"a":{"dependencies":{}}}}', "/a: dependencies is not supported"),
        ('{"properties":{"a":{"dependentSchemas":[]}}}', "/a: dependentSchemas must be an object"),
        ('{"allOf":[{"anyOf":[]}]}', "/~allOf/0: anyOf must be a list of schemas"),
        ('{"not":{"minimum":"1"}}', "/~not: minimum must be a number"),
        ('{"$defs":{"x":{"minItems":-1}}}', "/~$defs/x: minItems must be a count"),
        ('{"x-own":1,"$ref":"#"}', None),
        ("[" * 600, "nested deeper than 500 brackets"),
    ]
    df = spark.createDataFrame(rows, "schema_definition string, want string")
    for row in registry.check_definitions(df).collect():
        assert row.problems == ([row.want] if row.want else []), row


def test_one_deep_definition_costs_the_others_nothing(spark):
    deep = '{"properties":{"a":' * 90 + "{}" + "}}" * 90
    flat = '{"properties":{"a":{"type":"text"}}}'
    df = spark.createDataFrame([(flat,), (deep,)], "schema_definition string")
    plan = registry.check_definitions(df)._jdf.queryExecution().executedPlan().toString()
    same = registry.check_definitions(df.limit(1))._jdf.queryExecution().executedPlan().toString()
    assert len(plan) < 1.2 * len(same)  # the plan does not grow with the depth
    found = [r.problems for r in registry.check_definitions(df).collect()]
    assert found == [["/a: type must be a name or a list of distinct names"], []]


def test_rules_ask_for_their_own_checks_only(spark):
    schema = {"properties": {"a": {"type": "string", "maxLength": 3}, "b": {"minimum": 2}}, "items": True}
    compiled = spark.createDataFrame([("s", json.dumps(schema))], "k string, schema_definition string")
    found = rules.compile_rules(compiled, 1, ("k",)).first()["rules"]
    names = [name for name, *_ in rules._CHECKS]
    asked = {place: [names[c] for c in rule["checks"]] for place, rule in found.items()}
    assert asked == {"": [], "/a": ["type", "maxLength"], "/b": ["minimum"], "/~i": []}


def test_blocks_of_rounds_end_where_the_bound_says(spark):
    grow = "array(named_struct('no', n.no + 1))"
    for rounds in range(1, 20):
        loop = jsontree._loop("array(named_struct('no', 0))", grow, str(rounds))
        assert spark.sql(f"SELECT size({loop}) AS n").first()["n"] == rounds + 1


def test_a_bound_far_beyond_the_last_node_is_not_worked_off(spark):
    """A state of a thousand nodes that is copied in each of a million rounds never ends."""
    wide = "transform(sequence(1, 1000), i -> named_struct('no', i))"
    loop = jsontree._loop(wide, "filter(array(n), m -> false)", "1000000")
    assert spark.sql(f"SELECT size({loop}) AS n FROM range(20)").agg({"n": "sum"}).first()[0] == 20_000
