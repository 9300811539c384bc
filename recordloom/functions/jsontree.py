"""Flatten JSON schema definitions into arrays of nodes.

Places are JSON pointers (``/a/b``); the steps into array items and to members
that are not named are written ``~i`` and ``~o`` for rules, which no property name
can produce because ``~`` is escaped, and so are those into the sub-schemas of other
keywords (``~allOf/0``, ``~$defs/name``).
Trees are expanded breadth-first by a loop inside the row, as many rounds as the row
is deep: the plan has one size, and a deep row costs no other row anything.
Everything here stays inside one row: no shuffle and no Python worker. The
expressions are SQL texts, which the session parses in one go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ITEM_STEP = "~i"
OTHER_STEP = "~o"  # to members a definition does not name

_DEFINITION_NODES = (
    "array<struct<path:string,name:string,needed:boolean,depth:int,at:string,v:variant>>"
)


def kind(v: str) -> str:
    """JSON Schema type of a variant.

    A number written with a fraction is a ``number`` even when the fraction is
    zero, because records keep their reals as exact decimals; integers too long
    for 64 bits arrive as decimals of scale zero.
    """
    return f"""get(transform(array(schema_of_variant({v})), t -> CASE
        WHEN t = 'STRING' THEN 'string'
        WHEN t = 'BIGINT' THEN 'integer'
        WHEN t = 'BOOLEAN' THEN 'boolean'
        WHEN t = 'VOID' THEN 'null'
        WHEN startswith(t, 'OBJECT') THEN 'object'
        WHEN startswith(t, 'ARRAY') THEN 'array'
        WHEN t rlike '^DECIMAL[(](19|2[0-9]|3[0-8]),0[)]$' THEN 'integer'
        WHEN t IS NOT NULL THEN 'number' END), 0)"""


def members(v: str, path: str = "$") -> str:
    """Members of a variant object, NULL when it is something else."""
    return f"try_variant_get({v}, '{path}', 'map<string,variant>')"


def elements(v: str, path: str = "$") -> str:
    """Elements of a variant array, NULL when it is something else."""
    return f"try_variant_get({v}, '{path}', 'array<variant>')"


def step(name: str) -> str:
    return f"replace(replace({name}, '~', '~0'), '/', '~1')"


def types(v: str) -> str:
    """``type`` of a schema node as a list, NULL when any type is allowed."""
    one = f"try_variant_get({v}, '$.type', 'string')"
    return f"""coalesce(try_variant_get({v}, '$.type', 'array<string>'),
        CASE WHEN {one} IS NOT NULL THEN array({one}) END)"""


def options(v: str) -> str:
    """``enum`` of a schema node as canonical JSON texts."""
    return f"transform({elements(v, '$.enum')}, o -> to_json(o))"


# Brackets are read outside strings. The deepest point is a running maximum.
_NESTING = r"""aggregate(
    split(regexp_replace(regexp_replace({definition},
        r'"[^"\\]*(?:\\.[^"\\]*)*"', ''), r'[^\[\]{{}}]', ''), ''),
    named_struct('now', 0, 'top', 0),
    (acc, mark) -> named_struct(
        'now', acc.now + CASE WHEN mark IN ('{{', '[') THEN 1 WHEN mark = '' THEN 0 ELSE -1 END,
        'top', greatest(acc.top, acc.now + CASE WHEN mark IN ('{{', '[') THEN 1 ELSE 0 END))
).top"""


def nesting(json: str) -> str:
    """How deep the brackets of a JSON text are nested."""
    return _NESTING.format(definition=json)


def field_levels(definition: str) -> str:
    """Upper bound for the depth of fields a definition declares: each level of
    ``properties`` opens two brackets, each level of ``items`` or of a schema for
    other members one."""
    top = _NESTING.format(definition=definition)
    return f"""CASE WHEN contains({definition}, '"items"')
            OR contains({definition}, '"additionalProperties"') AND
                {definition} rlike '"additionalProperties"[ \t\r\n]*:[ \t\r\n]*[{{]'
            THEN {top} - 2
        ELSE cast(floor(({top} - 1) / 2) AS int) END"""


def measured_levels(schemas: DataFrame, definition: str = "schema_definition") -> int:
    """Depth needed for every definition of a registry: one number, one pass.

    Templates then unroll exactly that many levels, so no nested field is cut. The rows
    are counted, too: without it Spark leaves out a ``DISTINCT`` below the maximum and
    measures a definition once for each row it was taken from.
    """
    deepest, _ = _measured(schemas, definition).first()
    return max(int(deepest or 0), 1)


def _measured(schemas: DataFrame, definition: str) -> DataFrame:
    return schemas.agg(F.expr(f"max({field_levels(definition)})"), F.count("*"))


_DECLARED = f"""concat(
    coalesce(transform(map_entries({members('n.v', '$.properties')}), e -> named_struct(
        'path', concat(n.path, '/', {step('e.key')}),
        'name', e.key,
        'needed', array_contains(
            coalesce(try_variant_get(n.v, '$.required', 'array<string>'),
                cast(array() AS array<string>)), e.key),
        'depth', n.depth + 1,
        'at', concat(n.at, '/properties/', {step('e.key')}),
        'v', e.value)), cast(array() AS {_DEFINITION_NODES})),
    coalesce(transform(
        filter(array(try_variant_get(n.v, '$.items', 'variant')), i -> i IS NOT NULL),
        i -> named_struct(
            'path', concat(n.path, '/{ITEM_STEP}'),
            'name', '{ITEM_STEP}',
            'needed', false,
            'depth', n.depth + 1,
            'at', concat(n.at, '/items'),
            'v', i)), cast(array() AS {_DEFINITION_NODES})))"""

#: Keywords whose value is a schema, a list of schemas, or an object of schemas.
_ONE = ("not", "if", "then", "else", "contains", "propertyNames", "unevaluatedItems",
        "unevaluatedProperties")
_MANY = ("allOf", "anyOf", "oneOf", "prefixItems")
_NAMED = ("patternProperties", "$defs", "definitions", "dependentSchemas")
_NO_NODES = f"cast(array() AS {_DEFINITION_NODES})"


def _below(step_: str, at: str, v: str) -> str:
    return f"""named_struct('path', concat(n.path, '/~', {step_}), 'name', concat('~', {step_}),
        'needed', false, 'depth', n.depth + 1, 'at', concat(n.at, '/', {at}), 'v', {v})"""


def _listed(names: tuple[str, ...]) -> str:
    words = ", ".join(f"'{name}'" for name in names)
    return f"filter(array({words}), k -> map_contains_key(m, k))"


# Every sub-schema of a node: declared members and items, the schema for members it
# does not name, and those of the other keywords, most of which a definition lacks.
_WITH_OTHERS = f"""concat({_DECLARED},
    transform(
        filter(array(try_variant_get(n.v, '$.additionalProperties', 'variant')),
            o -> {kind('o')} = 'object'),
        o -> named_struct(
            'path', concat(n.path, '/{OTHER_STEP}'),
            'name', '{OTHER_STEP}',
            'needed', false,
            'depth', n.depth + 1,
            'at', concat(n.at, '/additionalProperties'),
            'v', o)),
    coalesce(flatten(transform(
        filter(array({members('n.v')}), m -> arrays_overlap(map_keys(m),
            array({", ".join(f"'{k}'" for k in (*_ONE, *_MANY, *_NAMED))}))),
        m -> concat(
            transform({_listed(_ONE)}, k -> {_below('k', 'k', 'm[k]')}),
            flatten(transform({_listed(_MANY)}, k -> coalesce(transform({elements('m[k]')},
                (x, i) -> {_below("concat(k, '/', i)", "concat(k, '/', i)", 'x')}), {_NO_NODES}))),
            flatten(transform({_listed(_NAMED)}, k -> coalesce(transform(map_entries({members('m[k]')}),
                e -> {_below(f"concat(k, '/', {step('e.key')})", f"concat(k, '/', {step('e.key')})",
                             'e.value')}), {_NO_NODES})))
        ))), {_NO_NODES}))"""


def _loop(root: str, grow: str, rounds: str) -> str:
    """Breadth-first expansion of ``root`` by ``grow``, at most ``rounds`` levels down."""
    grown = f"flatten(transform(acc.now, n -> {grow}))"
    # An aggregate copies its state every round, with all nodes found so far. So rounds come
    # in blocks, each twice as long as the one before, and blocks after the last node are
    # skipped whole: a row pays for about as many rounds as it is deep, not for its bound.
    block = f"""aggregate(sequence(1, block.n), tree, (acc, round) -> CASE WHEN size(acc.now) = 0 THEN acc
        ELSE get(transform(array({grown}),
            new -> named_struct('now', new, 'every', concat(acc.every, new))), 0) END)"""
    blocks = f"""flatten(transform(array(greatest(1, {rounds})), most -> transform(
        sequence(0, length(bin(most)) - 1), i -> named_struct('n',
            cast(least(shiftleft(1, i), most - shiftleft(1, i) + 1) AS int)))))"""
    return f"""aggregate({blocks}, named_struct('now', {root}, 'every', {root}),
        (tree, block) -> CASE WHEN size(tree.now) = 0 THEN tree ELSE {block} END).every"""


def with_definition_nodes(
    df: DataFrame, v: str, levels: int | None, out: str, others: bool = False
) -> DataFrame:
    """Add every (sub-)schema of the definition ``v``, the root first; with
    ``others`` also those of members that are not named and of combinators.

    ``levels`` bounds the depth; without it every row is followed to its own.
    """
    root = f"""cast(array(named_struct('path', '', 'name', '', 'needed', true, 'depth', 0,
        'at', '', 'v', {v})) AS {_DEFINITION_NODES})"""
    rounds = nesting(f"to_json({v})") if levels is None or others else str(levels)
    return df.withColumn(out, F.expr(_loop(root, _WITH_OTHERS if others else _DECLARED, rounds)))
