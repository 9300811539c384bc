from __future__ import annotations

import base64
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom import model
from recordloom.functions import text
from recordloom.operators import registry
from recordloom.sources import tables

AT = datetime(2024, 1, 5)
# --- fixed values: two published schemas whose token counts are known (102 and 234) ---
ONE_FIELD = {
    "$id": "https://example.com/test_loe.schema.json",
    "$schema": "https://json-schema.org/draft/2020-12/schema",
    "title": "Employment Letter",
    "description": "A schema that represents data extracted from an employment letter",
    "type": "object",
    "properties": {
        "employer_name": {"description": "The name of the employer", "type": ["null", "string"]}
    },
    "required": ["employer_name"],
    "additionalProperties": False,
}
THREE_FIELDS = {
    "description": "Schema to extract the employer name, employee name, and employee salary from a letter of employment",
    "additionalProperties": False,
    "$schema": "http://json-schema.org/draft/2020-12/schema",
    "type": "object",
    "properties": {
        "employer_name": {
            "type": ["string", "null"],
            "description": "The name of the employer in the letter of employment",
        },
        "employee_name": {
            "type": ["string", "null"],
            "description": "The name of the employee in the letter of employment",
        },
        "employee_salary": {
            "description": "The salary information of the employee in the letter of employment",
            "type": "object",
            "properties": {
                "amount": {"type": ["number", "null"], "description": "The amount of the salary"},
                "frequency": {
                    "type": ["string", "null"],
                    "description": "The frequency of the salary payment",
                    "enum": ["annually", "monthly", "biweekly", "weekly", "hourly"],
                },
            },
            "required": ["amount", "frequency"],
        },
    },
    "required": ["employer_name", "employee_name", "employee_salary"],
}
# --- end of fixed values ---


def submissions(spark, *rows):
    return spark.createDataFrame(
        [(n, d, x if isinstance(x, str) else json.dumps(x), AT) for n, d, x in rows],
        "schema_name string, schema_description string, schema_definition string, "
        "created_at timestamp_ntz",
    )


@pytest.mark.parametrize(("definition", "tokens"), [(ONE_FIELD, 102), (THREE_FIELDS, 234)])
def test_estimate_is_near_the_published_counts(spark, definition, tokens):
    df = submissions(spark, ("test_loe", "description", definition))
    (row,) = registry.count_tokens(df).collect()
    assert row.is_estimate
    assert abs(row.number_of_tokens - tokens) <= 0.06 * tokens
    spaced = submissions(spark, ("test_loe", "description", json.dumps(definition, indent=4)))
    assert registry.count_tokens(spaced).first().number_of_tokens == row.number_of_tokens


@pytest.mark.parametrize(("count", "error"), [(2047, None), (2048, None), (2049, model.TOO_LARGE)])
def test_token_limit(spark, count, error):
    df = submissions(spark, ("test_loe", "description", ONE_FIELD))
    row = registry.register(df, counter=lambda c: F.lit(count)).first()
    assert row.error_name == error
    if error:
        assert row.error_message == (
            "Schema definition is too large (i.e. limit 2048). Number of tokens: 2049"
        )


def test_exact_counter_over_a_local_vocabulary(spark, tmp_path):
    ranks = tmp_path / "bytes.tiktoken"
    ranks.write_text(
        "".join(f"{base64.b64encode(bytes([i])).decode()} {i}\n" for i in range(256))
    )
    df = submissions(spark, ("test_loe", "description", '{"type":"object"}'))
    counter = text.exact_tokens(str(ranks), r".+|\n")
    row = registry.count_tokens(df, counter).first()
    assert not row.is_estimate
    assert row.number_of_tokens == len('{"type": "object"}')


@pytest.mark.parametrize(
    ("name", "description", "definition", "error"),
    [
        ("abc", "long enough", ONE_FIELD, "ValidationError"),
        ("abcd", "long enough", ONE_FIELD, None),
        ("a" * 64, "long enough", ONE_FIELD, None),
        ("a" * 65, "long enough", ONE_FIELD, "ValidationError"),
        ("abcd", "1234567", ONE_FIELD, "ValidationError"),
        ("abcd", "x" * 1028, ONE_FIELD, None),
        ("abcd", "x" * 1029, ONE_FIELD, "ValidationError"),
        ("abcd", "long enough", "[1]", "ValidationError"),
        ("abcd", "long enough", "no json", "ValidationError"),
        ("abcd", "long enough", {"type": "text"}, "SchemaError"),
        ("abcd", "long enough", {"properties": {"a": {"enum": 1}}}, "SchemaError"),
        ("abcd", "long enough", {"properties": {"a": True}}, None),
        ("abcd", "long enough", {"required": ["a", 1]}, "SchemaError"),
        ("abcd", "long enough", {"type": []}, "SchemaError"),
    ],
)
def test_registration_verdicts(spark, name, description, definition, error):
    row = registry.register(submissions(spark, (name, description, definition))).first()
    assert row.error_name == error
    assert (row.schema_version is None) == (error is not None)
    if error is None:
        assert row.schema_version.isalnum() and len(row.schema_version) == 10


def test_random_versions(spark):
    df = submissions(spark, ("test_loe", "description", ONE_FIELD))
    version = registry.register(df, random_versions=True).first().schema_version
    assert len(version) == 10 and version.isalnum()


def test_log_lookup_and_soft_delete(spark, tmp_path):
    path = str(tmp_path / "schemas")
    df = registry.register(
        submissions(
            spark,
            ("test_loe", "description", ONE_FIELD),
            ("test_loe", "description", THREE_FIELDS),
            ("abc", "description", ONE_FIELD),
        )
    )
    assert registry.rejected(df).count() == 1
    tables.append_schemas(registry.accepted(df), path)
    schemas = registry.current(tables.read_schemas(spark, path))
    versions = [r.schema_version for r in registry.list_versions(schemas, "test_loe").collect()]
    assert versions == sorted(versions) and len(versions) == 2
    keys = spark.createDataFrame(
        [("test_loe", versions[0]), ("test_loe", "unknown000")],
        "schema_name string, schema_version string",
    )
    gone, unknown = registry.delete(schemas, keys, F.lit(datetime(2024, 1, 6)).cast("timestamp_ntz"))
    assert [r.error_name for r in unknown.collect()] == ["SchemaDoesNotExist"]
    tables.append_schemas(gone, path)
    schemas = registry.current(tables.read_schemas(spark, path))
    found = {r.schema_version: r.error_name for r in registry.get_schemas(schemas, keys).collect()}
    assert found == {versions[0]: "SchemaDoesNotExist", "unknown000": "SchemaDoesNotExist"}
    left = [r.schema_version for r in registry.list_page(schemas).collect()]
    assert left == versions[1:]
    again, unknown = registry.delete(schemas, keys, F.lit(AT).cast("timestamp_ntz"))
    assert again.count() == 0 and unknown.count() == 2


@pytest.mark.parametrize(("number", "size"), [(0, 10), (1, 0), (1, 101)])
def test_page_bounds(spark, number, size):
    with pytest.raises(ValueError):
        registry.list_page(spark.createDataFrame([], model.SCHEMA_ROW), number, size)


def test_record_type():
    kind = registry.record_type(THREE_FIELDS)
    assert kind["employee_salary"].dataType["amount"].dataType == T.DecimalType(38, 9)
    assert kind["employer_name"].dataType == T.StringType()
    assert registry.record_type({"type": "array", "items": {"type": "integer"}}) == T.ArrayType(
        T.LongType()
    )


def test_tool_spec_drops_two_members_only(spark):
    df = submissions(spark, ("test_loe", "Reads letters", ONE_FIELD)).withColumn(
        "schema_version", F.lit("v")
    )
    spec = json.loads(registry.tool_specs(df).first().tool_spec)
    assert spec["function"]["name"] == "get_test_loe_data"
    assert spec["function"]["parameters"] == {
        k: v for k, v in ONE_FIELD.items() if k not in ("description", "$schema")
    }


def test_lint_of_a_schema_that_requires_what_it_does_not_declare(spark):
    schema = {
        "type": "object",
        "properties": {
            "name": {"type": ["string", "null"], "description": "Name"},
            "birthDay": {"type": "string", "format": "date"},
        },
        "required": ["name", "date"],
    }
    df = submissions(spark, ("resume", "Reads resumes", schema)).withColumn(
        "schema_version", F.lit("v")
    )
    found = {(r.path, r.finding) for r in registry.lint(df).collect()}
    assert found == {
        ("", "schema has no description"),
        ("/birthDay", "field has no description"),
        ("/birthDay", "field does not admit null"),
        ("/birthDay", "field is not snake case"),
        ("/birthDay", "field is not required"),
    }


def test_definitions_beyond_the_bound_are_not_broadcast(spark, sf_dir, monkeypatch):
    from recordloom.functions import joins
    from recordloom.plans.derived import view

    current = registry.current(view(spark, sf_dir, "schema_log"))
    keys = view(spark, sf_dir, "schema_keys")
    small = registry.get_schemas(current, keys)
    monkeypatch.setattr(joins, "fits_broadcast", lambda *_: False)
    large = registry.get_schemas(current, keys)
    assert "strategy=merge" in large._jdf.queryExecution().optimizedPlan().toString()
    shown = ["schema_name", "schema_version", "schema_definition", "error_name"]
    assert sorted(map(str, large.select(*shown).collect())) == sorted(map(str, small.select(*shown).collect()))
