"""Definitions against the published meta-schema, by the plain checker of records."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from recordloom import model
from recordloom.operators import metaschema, registry
from tests.test_keywords import broken, random_schema

WRONG = [1, "x", None, [], [1], ["a", "a"], {}, {"a": 1}, -1, 0, 2.5, True, {"a": {"type": "text"}}, "a#b"]


def spoiled(rng, node):
    """A definition in which some keyword at some depth has another value."""
    names = [*metaschema.META_SCHEMA["properties"], "x-own"]
    if isinstance(node, dict) and node and rng.random() < 0.7:
        key = rng.choice(list(node))
        return node | {key: spoiled(rng, node[key])}
    return node | {rng.choice(names): rng.choice(WRONG)} if isinstance(node, dict) else rng.choice(WRONG)


def found(spark, definitions):
    df = spark.createDataFrame(list(enumerate(definitions)), "id long, schema_definition string")
    rows = metaschema.meta_violations(df).collect()
    return {r.id: {(v.path, v.check) for v in r.violations} for r in rows}


def test_random_definitions_match_the_plain_checker(spark):
    rng = random.Random(4)
    definitions = [random_schema(rng, 3) for _ in range(120)]
    definitions += [spoiled(rng, random_schema(rng, 3)) for _ in range(400)]
    meta = json.loads(json.dumps(metaschema.META_SCHEMA))
    wanted = {i: broken(meta, meta, d) for i, d in enumerate(definitions)}
    assert found(spark, map(json.dumps, definitions)) == wanted
    assert sum(map(bool, wanted.values())) > 150 and sum(not w for w in wanted.values()) > 150


def test_the_meta_schema_holds_for_itself_and_odd_texts_have_a_result(spark):
    cases = [json.dumps(metaschema.META_SCHEMA), "true", "[]", "no json", None, "", "[" * 600]
    result = found(spark, cases)
    assert result == {
        0: set(), 1: set(), 2: {("", "type")}, 3: {("", "json")}, 4: {("", "json")}, 5: {("", "json")},
        6: {("", "depth")},
    }


def test_no_definitions(spark):
    df = spark.createDataFrame([], "schema_definition string, path string")
    assert metaschema.meta_violations(df).collect() == []


def test_registration_holds_definitions_against_it_on_request(spark):
    texts = ['{"examples":1}', '{"type":"text"}', '{"type":"object"}', None, "[]"]
    rows = [(f"schema {i}", "A description of data.", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "schema_name string, schema_description string, schema_definition string")
    df = df.withColumn("created_at", F.lit("2024-01-01"))
    plain = {r.schema_name: r for r in registry.register(df).collect()}
    strict = {r.schema_name: r for r in registry.register(df, published=True).collect()}
    assert plain["schema 0"].error_name is None and strict["schema 0"].error_name == model.SCHEMA_ERROR
    for i in range(1, 5):
        assert strict[f"schema {i}"].error_name == plain[f"schema {i}"].error_name
    assert plain.keys() == strict.keys() and strict["schema 2"].error_name is None
    assert list(strict["schema 0"].asDict()) == list(plain["schema 0"].asDict())
