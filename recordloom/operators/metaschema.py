"""S2 by the validator itself: definitions are records of the published meta-schema.

The meta-schema is one definition that refers to itself, compiled like any other; a
definition is followed as deep as it goes, and what breaks it comes out as paths and
keywords, the same as for records.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom import model
from recordloom.functions import jsontree, rules
from recordloom.functions.joins import lookup_join

# What the published meta-schema (draft 2020-12) says of each keyword, its
# vocabularies in one definition.
_SCHEMA = {"$ref": "#"}
_TEXT = {"type": "string"}
_FLAG = {"type": "boolean"}
_NUMBER = {"type": "number"}
_COUNT = {"$ref": "#/$defs/nonNegativeInteger"}
_TEXTS = {"$ref": "#/$defs/stringArray"}
_SCHEMAS = {"$ref": "#/$defs/schemaArray"}
_BY_NAME = {"type": "object", "additionalProperties": _SCHEMA}
_ANCHOR = {"type": "string", "pattern": "^[A-Za-z_][-A-Za-z0-9._]*$"}
META_SCHEMA = {
    "type": ["object", "boolean"],
    "properties": {
        "$id": {"type": "string", "pattern": "^[^#]*#?$"},
        "$anchor": _ANCHOR,
        "$dynamicAnchor": _ANCHOR,
        "$vocabulary": {"type": "object", "additionalProperties": _FLAG},
        "$defs": _BY_NAME,
        "definitions": _BY_NAME,
        "properties": _BY_NAME,
        "patternProperties": _BY_NAME,
        "dependentSchemas": _BY_NAME,
        "dependencies": {"type": "object", "additionalProperties": {"anyOf": [_SCHEMA, _TEXTS]}},
        "dependentRequired": {"type": "object", "additionalProperties": _TEXTS},
        "type": {"anyOf": [
            {"$ref": "#/$defs/simpleTypes"},
            {"type": "array", "items": {"$ref": "#/$defs/simpleTypes"}, "minItems": 1, "uniqueItems": True},
        ]},
        "enum": {"type": "array"},
        "examples": {"type": "array"},
        "required": _TEXTS,
        "multipleOf": {"type": "number", "exclusiveMinimum": 0},
    }
    | dict.fromkeys(("$schema", "$ref", "$dynamicRef", "$comment", "title", "description", "format", "pattern",
                     "contentEncoding", "contentMediaType"), _TEXT)
    | dict.fromkeys(("uniqueItems", "deprecated", "readOnly", "writeOnly"), _FLAG)
    | dict.fromkeys(("maximum", "exclusiveMaximum", "minimum", "exclusiveMinimum"), _NUMBER)
    | dict.fromkeys(("maxLength", "minLength", "maxItems", "minItems", "maxContains", "minContains",
                     "maxProperties", "minProperties"), _COUNT)
    | dict.fromkeys(("allOf", "anyOf", "oneOf", "prefixItems"), _SCHEMAS)
    | dict.fromkeys(("items", "contains", "additionalProperties", "propertyNames", "if", "then", "else", "not",
                     "unevaluatedItems", "unevaluatedProperties", "contentSchema"), _SCHEMA),
    "$defs": {
        "simpleTypes": {"enum": list(model.JSON_TYPES)},
        "nonNegativeInteger": {"type": "integer", "minimum": 0},
        "stringArray": {"type": "array", "items": _TEXT, "uniqueItems": True},
        "schemaArray": {"type": "array", "minItems": 1, "items": _SCHEMA},
    },
}


def meta_violations(
    schemas: DataFrame, definition: str = "schema_definition", most_nested: int = 500
) -> DataFrame:
    """Add ``violations``, where and by which keyword each definition breaks the
    published meta-schema; none where it holds.

    Text that is no JSON, or nested deeper than ``most_nested`` brackets, gets one
    violation, ``json`` or ``depth``, at the root; a null definition ``json``. Rows are
    judged in place; the compiled meta-schema, one row, is looked up by a constant key.
    """
    spark = schemas.sparkSession
    meta = spark.range(1).select(
        F.lit("meta").alias("_meta"), F.lit(json.dumps(META_SCHEMA)).alias("schema_definition")
    )
    compiled = rules.compile_rules(meta, None, ("_meta",)).withColumnRenamed("rules", "_rules")
    deep = F.coalesce(F.expr(jsontree.nesting(definition)) > most_nested, F.lit(False))
    rows = schemas.withColumn("_meta", F.lit("meta")).withColumn("_deep", deep)
    rows = rows.withColumn("_definition", F.when(~F.col("_deep"), F.try_parse_json(definition)))
    rows = lookup_join(rows, compiled, ["_meta"], "left", [definition])
    judged = rules.with_violations(rows, "_definition", rules="_rules")
    whole = f"""CASE WHEN _deep THEN array(named_struct('path', '', 'check', 'depth', 'detail', '{most_nested}'))
        WHEN _definition IS NULL THEN array(named_struct('path', '', 'check', 'json', 'detail', ''))
        ELSE violations END"""
    judged = judged.withColumn("violations", F.expr(whole).cast(rules.VIOLATIONS))
    return judged.drop("_meta", "_deep", "_definition", "_rules")
