"""Versioned schema registry: registration, lookup, listing, deletion, fields.

The registry is an append-only log of schema rows; ``current`` reads the latest
row of each (schema_name, schema_version). A deletion appends a tombstone.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom import model
from recordloom.functions import jsontree, rules, text
from recordloom.functions.joins import lookup_join
from recordloom.functions.ranking import number_rows
from recordloom.functions.rows import first_rows, one_row_each
from recordloom.operators import metaschema

KEY = ("schema_name", "schema_version")
MOST_NESTED = 500
TagRules = dict[str, str]


def length_problem(column: str, bounds: tuple[int, int]) -> Column:
    """Name of the broken length rule of ``column``, NULL when it holds."""
    size = F.char_length(column)
    return (
        F.when(F.col(column).isNull(), f"{column}: missing")
        .when(size < bounds[0], f"{column}: too short")
        .when(size > bounds[1], f"{column}: too long")
    )


def _member_is(name: str, *kinds: str) -> str:
    member = f"try_variant_get(n.v, '${name if name[0] == '[' else '.' + name}', 'variant')"
    wanted = ", ".join(f"'{k}'" for k in kinds)
    return f"({member} IS NULL OR {jsontree.kind(member)} IN ({wanted}))"


_PATTERN = "try_variant_get(n.v, '$.pattern', 'string')"
_BY_PATTERN = jsontree.members("n.v", "$.patternProperties")
_TYPE_NAMES = "array(" + ", ".join(f"'{t}'" for t in model.JSON_TYPES) + ")"
_TYPES = jsontree.types("n.v")
_REQUIRED = jsontree.elements("n.v", "$.required")

# Meta-schema rules: message -> condition under which a (sub-)schema ``n`` breaks it.
_META_RULES = {
    "schema must be an object or a boolean": f"{jsontree.kind('n.v')} NOT IN ('object', 'boolean')",
    "type must be a name or a list of distinct names": (
        f"{_TYPES} IS NOT NULL AND (size({_TYPES}) = 0 "
        f"OR size(array_distinct({_TYPES})) != size({_TYPES}) "
        f"OR size(array_except({_TYPES}, {_TYPE_NAMES})) > 0)"
    ),
    "required must be a list of distinct strings": (
        f"NOT {_member_is('required', 'array')} OR ({_REQUIRED} IS NOT NULL AND ("
        f"exists({_REQUIRED}, q -> {jsontree.kind('q')} != 'string') "
        f"OR size(array_distinct(transform({_REQUIRED}, q -> to_json(q)))) != size({_REQUIRED})))"
    ),
    "enum must be a list": f"NOT {_member_is('enum', 'array')}",
    "properties must be an object": f"NOT {_member_is('properties', 'object')}",
    "items must be a schema": f"NOT {_member_is('items', 'object', 'boolean')}",
    "additionalProperties must be a schema": (
        f"NOT {_member_is('additionalProperties', 'object', 'boolean')}"
    ),
    "title must be a string": f"NOT {_member_is('title', 'string')}",
    "description must be a string": f"NOT {_member_is('description', 'string')}",
    "format must be a string": f"NOT {_member_is('format', 'string')}",
    "$ref must be a string": f"NOT {_member_is('[\"$ref\"]', 'string')}",
    **{
        f"{name} must be a list of schemas": (
            f"NOT {_member_is(name, 'array')} OR size({jsontree.elements('n.v', f'$.{name}')}) = 0"
        )
        for name in ("allOf", "anyOf", "oneOf", "prefixItems")
    },
    **{
        f"{name} must be a schema": f"NOT {_member_is(name, 'object', 'boolean')}"
        for name in ("not", "if", "then", "else", "contains", "propertyNames", "unevaluatedItems",
                     "unevaluatedProperties")
    },
    **{
        f"{name} must be a number": f"NOT {_member_is(name, 'integer', 'number')}"
        for name in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf")
    },
    **{
        f"{name} must be a count": (
            f"NOT {_member_is(name, 'integer')} OR coalesce(try_variant_get(n.v, '$.{name}', 'bigint') < 0, false)"
        )
        for name in ("minLength", "maxLength", "minItems", "maxItems", "minProperties", "maxProperties",
                     "minContains", "maxContains")
    },
    "multipleOf must be above zero": (
        "coalesce(try_variant_get(n.v, '$.multipleOf', 'double') <= 0, false)"
    ),
    "uniqueItems must be true or false": f"NOT {_member_is('uniqueItems', 'boolean')}",
    "patternProperties must be an object": f"NOT {_member_is('patternProperties', 'object')}",
    "dependentSchemas must be an object": f"NOT {_member_is('dependentSchemas', 'object')}",
    "pattern must be a string": f"NOT {_member_is('pattern', 'string')}",
    "a pattern is not supported": (
        f"NOT coalesce({rules.plain_pattern(_PATTERN)}, true) OR exists("
        f"coalesce(map_keys({_BY_PATTERN}), cast(array() AS array<string>)), "
        f"p -> NOT {rules.plain_pattern('p')})"
    ),
    **{
        f"{name} is not supported": f"try_variant_get(n.v, '$.{name}', 'variant') IS NOT NULL"
        for name in rules.UNSUPPORTED
    },
}
_NODE_PROBLEMS = (
    "array_compact(array("
    + ", ".join(
        f"CASE WHEN {broken} THEN concat(n.path, ': {rule}') END"
        for rule, broken in _META_RULES.items()
    )
    + "))"
)


def check_definitions(schemas: DataFrame, levels: int | None = None) -> DataFrame:
    """Add ``problems``, the broken meta-schema rules of each definition.

    Every definition is followed to its own depth. Keywords and patterns records could
    not be held against are problems, too. One nested deeper than MOST_NESTED brackets
    is refused without being read.
    """
    deep = F.expr(jsontree.nesting("schema_definition")) > MOST_NESTED
    df = schemas.withColumn("_deep", F.coalesce(deep, F.lit(False)))
    df = df.withColumn("_v", F.when(~F.col("_deep"), F.try_parse_json("schema_definition")))
    df = jsontree.with_definition_nodes(df, "_v", levels, "_nodes", others=True)
    problems = f"""CASE
        WHEN _deep THEN array('nested deeper than {MOST_NESTED} brackets')
        WHEN _v IS NULL THEN array(': definition is not JSON')
        WHEN {jsontree.kind("_v")} != 'object' THEN array(': definition must be an object')
        ELSE flatten(transform(_nodes, n -> {_NODE_PROBLEMS})) END"""
    return df.withColumn("problems", F.expr(problems)).drop("_deep", "_v", "_nodes")


def count_tokens(
    schemas: DataFrame, counter: Callable[[Column], Column] | None = None
) -> DataFrame:
    """S3: add ``number_of_tokens`` and whether it is the built-in estimate."""
    count = (counter or text.estimated_tokens)(F.col("schema_definition"))
    return schemas.withColumn("number_of_tokens", count).withColumn(
        "is_estimate", F.lit(counter is None)
    )


def register(
    submissions: DataFrame,
    counter: Callable[[Column], Column] | None = None,
    limit: int = model.SCHEMA_TOKEN_LIMIT,
    random_versions: bool = False,
    levels: int | None = None,
    published: bool = False,
) -> DataFrame:
    """Judge submissions and give the good ones a version.

    Expects schema_name, schema_description, schema_definition, created_at.
    Rejected rows carry error_name and error_message; no row fails the job. With
    ``published`` a definition without other problems is held against the published
    meta-schema, too, which takes ten times as long.
    """
    df = count_tokens(check_definitions(submissions, levels), counter)
    if published:
        judged = metaschema.meta_violations(df.withColumn("_text", F.when(
            F.size("problems") == 0, F.col("schema_definition"))), "_text", MOST_NESTED)
        broken = F.transform("violations", lambda v: F.concat(v["path"], F.lit(": breaks "), v["check"]))
        problems = F.when(F.col("_text").isNotNull(), broken).otherwise(F.col("problems"))
        df = judged.withColumn("problems", problems).drop("_text", "violations")
    lengths = F.array_compact(
        F.array(
            length_problem("schema_name", model.NAME_LENGTH),
            length_problem("schema_description", model.DESCRIPTION_LENGTH),
            F.when(F.col("schema_definition").isNull(), "schema_definition: missing"),
            # A body that is no JSON object never becomes a definition.
            F.when(
                F.get(F.col("problems"), F.lit(0)).startswith(": definition"),
                F.lit("schema_definition: not an object"),
            ),
        )
    )
    tokens = F.col("number_of_tokens")
    error_name = (
        F.when(F.size("_lengths") > 0, model.VALIDATION_ERROR)
        .when(F.size("problems") > 0, model.SCHEMA_ERROR)
        .when(tokens > limit, model.TOO_LARGE)
    )
    error_message = (
        F.when(F.size("_lengths") > 0, F.array_join("_lengths", "; "))
        .when(F.size("problems") > 0, F.array_join("problems", "; "))
        .when(
            tokens > limit,
            F.format_string(
                f"Schema definition is too large (i.e. limit {limit}). Number of tokens: %d",
                tokens,
            ),
        )
    )
    version = (
        F.randstr(F.lit(model.VERSION_LENGTH))
        if random_versions
        else text.short_id(
            F.col("schema_name"), F.col("schema_definition"), F.col("created_at").cast("string")
        )
    )
    return (
        df.withColumn("_lengths", lengths)
        .withColumn("error_name", error_name)
        .withColumn("error_message", error_message)
        .withColumn("schema_version", F.when(F.col("error_name").isNull(), version))
        .withColumn("schema_status", F.when(F.col("error_name").isNull(), model.ACTIVE))
        .withColumn("written_at", F.col("created_at"))
        .drop("_lengths", "problems")
    )


def accepted(registered: DataFrame) -> DataFrame:
    """Rows to append to the registry log."""
    return registered.filter(F.col("error_name").isNull()).select(*model.SCHEMA_ROW.fieldNames())


def rejected(registered: DataFrame) -> DataFrame:
    return registered.filter(F.col("error_name").isNotNull()).select(
        "schema_name", "created_at", "error_name", "error_message"
    )


def current(log: DataFrame) -> DataFrame:
    """Latest row per (name, version); at equal times a deletion wins."""
    gone = F.col("schema_status") == model.DELETED
    return first_rows(log, KEY, [F.col("written_at").desc(), gone.desc()])


def available(schemas: DataFrame) -> DataFrame:
    return schemas.filter(F.col("schema_status") != model.DELETED)


def get_schemas(schemas: DataFrame, keys: DataFrame) -> DataFrame:
    """Definition for each requested key, or an error row.

    A version belongs to one row, so the lookup is an equality join; a single
    key given as a filter on ``schemas`` is pushed into the scan instead.
    """
    found = available(schemas)
    # The same key may be asked for very often; a serial number deals it out.
    asked = keys.withColumn("_asked", F.monotonically_increasing_id())
    df = lookup_join(asked, found, KEY, "left", spread_by=("_asked",)).drop("_asked")
    missing = F.col("schema_status").isNull()
    name, message = model.SCHEMA_DOES_NOT_EXIST
    return df.withColumn("error_name", F.when(missing, name)).withColumn(
        "error_message", F.when(missing, message)
    )


def list_versions(schemas: DataFrame, schema_name: str) -> DataFrame:
    """All versions of one name in key order."""
    return (
        available(schemas).filter(F.col("schema_name") == schema_name).orderBy("schema_version")
    )


def version_counts(schemas: DataFrame) -> DataFrame:
    """S5, M9 in bulk: number of listed versions per name."""
    return available(schemas).groupBy("schema_name").agg(F.count("*").alias("version_count"))


def list_page(schemas: DataFrame, page_number: int = 1, page_size: int = model.LIST_PAGE_SIZE):
    """One page of everything that is not deleted, filtered before paging."""
    if not 1 <= page_size <= model.LIST_PAGE_SIZE_LIMIT:
        raise ValueError(f"page_size must be 1..{model.LIST_PAGE_SIZE_LIMIT}")
    if page_number < 1:
        raise ValueError("page_number starts at 1")
    return (
        available(schemas)
        .orderBy(*KEY)
        .offset((page_number - 1) * page_size)
        .limit(page_size)
    )


def list_pages(schemas: DataFrame, page_size: int = model.LIST_PAGE_SIZE) -> DataFrame:
    """S6 for all pages at once: add ``page_number`` to every listed row."""
    numbered = number_rows(available(schemas), KEY)
    return numbered.withColumn(
        "page_number", F.floor((F.col("row_no") - 1) / page_size).cast("long") + 1
    )


def delete(schemas: DataFrame, keys: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(tombstones to append, keys that do not exist or were deleted)."""
    keys = keys.select(*KEY).distinct()
    live = available(schemas)
    tombstones = (
        lookup_join(live, keys, KEY, "left_semi")
        .withColumn("schema_status", F.lit(model.DELETED))
        .withColumn("written_at", at)
    )
    unknown = lookup_join(keys, live.select(*KEY), KEY, "left_anti")
    name, message = model.SCHEMA_DOES_NOT_EXIST
    return tombstones, unknown.select(
        *KEY, F.lit(name).alias("error_name"), F.lit(message).alias("error_message")
    )


def schema_fields(schemas: DataFrame, levels: int | None = None) -> DataFrame:
    """One row per declared field, nested ones included."""
    if levels is None:
        levels = jsontree.measured_levels(schemas)
    df = jsontree.with_definition_nodes(
        schemas, "try_parse_json(schema_definition)", levels, "_nodes"
    )
    types = jsontree.types("n.v")
    below_root = F.expr("filter(_nodes, n -> n.depth > 0)")
    fields = one_row_each(df, below_root, "n", *KEY)
    return fields.selectExpr(
        *KEY,
        "n.path AS path",
        "n.name AS field_name",
        "n.depth AS depth",
        f"{types} AS types",
        f"coalesce(array_contains({types}, 'null'), false) AS nullable",
        "try_variant_get(n.v, '$.format', 'string') AS format",
        f"{jsontree.options('n.v')} AS options",
        "n.needed AS required",
        "try_variant_get(n.v, '$.description', 'string') AS description",
    )


# --- fixed values: tag colour by format or type ---
FIELD_TAGS: TagRules = {
    "string": "blue",
    "number": "green",
    "date": "purple",
    "object": "high-contrast",
    "email": "red",
    "array": "magenta",
    "null": "cyan",
}
# --- end of fixed values ---


def field_tags(fields: DataFrame) -> DataFrame:
    """First type other than "null"; a format wins over the type."""
    first = F.get(F.filter("types", lambda t: t != "null"), F.lit(0))
    tag = F.coalesce("format", "field_type")
    colour = F.lit(None).cast("string")
    for name, value in FIELD_TAGS.items():
        colour = F.when(F.col("tag") == name, value).otherwise(colour)
    return (
        fields.withColumn("field_type", first)
        .withColumn("tag", tag)
        .withColumn("tag_colour", colour)
    )


SNAKE_CASE = "^[a-z][a-z0-9]*(_[a-z0-9]+)*$"


def lint(schemas: DataFrame, levels: int | None = None) -> DataFrame:
    """One row per broken authoring rule."""
    fields = schema_fields(schemas, levels)
    named = F.col("field_name") != jsontree.ITEM_STEP
    checks = F.array_compact(
        F.array(
            F.when(
                named & (F.coalesce(F.trim("description"), F.lit("")) == ""),
                "field has no description",
            ),
            F.when(
                named
                & F.col("types").isNotNull()
                & ~F.array_contains("types", "object")
                & ~F.col("nullable"),
                "field does not admit null",
            ),
            F.when(named & ~F.col("field_name").rlike(SNAKE_CASE), "field is not snake case"),
            F.when(named & ~F.col("required"), "field is not required"),
            F.when(F.col("types").isNull(), "field has no type"),
        )
    )
    by_field = one_row_each(fields, checks, "finding", *KEY, "path")
    described = F.trim(
        F.coalesce(
            F.try_variant_get(F.try_parse_json("schema_definition"), "$.description", "string"),
            F.lit(""),
        )
    )
    overall = schemas.filter(described == "").select(
        *KEY, F.lit("").alias("path"), F.lit("schema has no description").alias("finding")
    )
    return by_field.unionByName(overall)


def record_type(definition: str | dict) -> T.DataType:
    """Spark type of the records one definition describes."""
    node = json.loads(definition) if isinstance(definition, str) else definition
    if not isinstance(node, dict):
        return T.VariantType()
    declared = node.get("type")
    names = [declared] if isinstance(declared, str) else list(declared or [])
    names = [n for n in names if n != "null"]
    if len(names) != 1:
        return T.VariantType()
    match names[0]:
        case "object":
            return T.StructType(
                [
                    T.StructField(name, record_type(sub), True)
                    for name, sub in node.get("properties", {}).items()
                ]
            )
        case "array":
            return T.ArrayType(record_type(node.get("items", {})))
        case "number":
            return T.DecimalType(38, 9)
        case "integer":
            return T.LongType()
        case "boolean":
            return T.BooleanType()
        case _:
            return T.StringType()


def typed_records(results: DataFrame, definition: str | dict, column: str = "result") -> DataFrame:
    """Results of one schema as typed columns."""
    return results.withColumn("record", F.from_json(column, record_type(definition)))


def tool_specs(schemas: DataFrame) -> DataFrame:
    """Function-calling specification of each schema."""
    members = F.expr(
        f"map_filter({jsontree.members('try_parse_json(schema_definition)')}, "
        "(k, v) -> k NOT IN ('description', '$schema'))"
    )
    spec = F.struct(
        F.lit("function").alias("type"),
        F.struct(
            F.concat(F.lit("get_"), F.col("schema_name"), F.lit("_data")).alias("name"),
            F.col("schema_description").alias("description"),
            F.to_variant_object(members).alias("parameters"),
        ).alias("function"),
    )
    return schemas.select(*KEY, F.to_json(spec).alias("tool_spec"))
