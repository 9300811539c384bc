"""Turn a registry into per-schema rules, and judge records against them.

A schema row carries its rules as one map column. After a single key lookup
each record meets its rules inside its own row, so validation adds no shuffle (it runs
in Python workers, see ``judge``),
and a schema that owns a third of all records costs nothing extra.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.functions import jsontree, judge

VIOLATIONS = "array<struct<path:string,check:string,detail:string>>"

#: Keywords that bound a number, a text, an array or an object, and how a bound is read.
_BOUNDS = dict.fromkeys(("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf"),
                        "variant") | dict.fromkeys(("minLength", "maxLength", "minItems", "maxItems",
                                                    "minProperties", "maxProperties"), "bigint")


def _as(value: str, kind: str) -> str:
    return f"try_variant_get({value}, '$', '{kind}')"


#: Keywords that records are held against; ``format``, ``title`` and the like only
#: describe. ``unchecked_keywords`` lists what else a definition uses.
COMBINED = ("allOf", "anyOf", "oneOf", "not", "if", "then", "else", "$ref", "dependentSchemas")
CHECKED = ("type", "enum", "const", "properties", "required", "additionalProperties", "items",
           "uniqueItems", "pattern", "patternProperties", "propertyNames", "prefixItems",
           "contains", "minContains", "maxContains", "dependentRequired", "unevaluatedProperties",
           "unevaluatedItems", *COMBINED, *_BOUNDS)
#: Keywords that would change verdicts; definitions with one are refused.
UNSUPPORTED = ("dependencies", "additionalItems")
DESCRIPTIVE = ("$id", "$schema", "$comment", "$defs", "definitions", "$anchor", "title",
               "description", "format", "default", "examples", "deprecated", "readOnly", "writeOnly")


def plain_pattern(pattern: str) -> str:
    """Whether a pattern is made of letters, escapes, classes, groups, alternatives,
    anchors and quantifiers, which mean the same wherever it is searched for. Anything
    else is refused: named groups, back references, possessive quantifiers, class
    operations, options, and ranges or repetitions that run backwards."""
    marked = f"regexp_replace({pattern}, r'{ESCAPE}', '\ue000')"
    bare = f"regexp_replace({marked}, r'{CLASS}', 'a')"
    atoms = f"regexp_replace(regexp_replace({bare}, r'[(][?][:=!]', '('), r'{QUANTIFIED}', '')"
    # What is left are groups; innermost ones are taken out one level at a time.
    left = f"aggregate(sequence(1, 20), {atoms}, (t, i) -> regexp_replace(t, r'{GROUP}', ''))"
    ranges = f"""exists(regexp_extract_all({marked}, r'({CLASS})', 1), c -> exists(
        regexp_extract_all(c, r'([^-\\[^]-[^-\\]])', 1),
        p -> ascii(left(p, 1)) > ascii(right(p, 1)) OR contains(p, '\ue000')))"""
    counts = f"""exists(regexp_extract_all({bare}, r'([{{][0-9]+,[0-9]+[}}])', 1), q ->
        int(regexp_extract(q, r'[{{]([0-9]+)', 1)) > int(regexp_extract(q, r',([0-9]+)', 1)))"""
    return f"({left} = '' AND NOT {ranges} AND NOT {counts})"


#: The parts of a pattern that are taken over as they are.
ESCAPE = r"\\[dDwWsSbBtnrfv^$.|?*+(){}/\\\[\]-]"
CLASS = r"\[\^?(?:[^\[\]\\&]|&(?!&))+\]"
QUANTIFIED = r"[^\\\[\](){}*+?|^$](?:[*+?]|[{][0-9]{1,4}(?:,[0-9]{0,4})?[}])?[?]?|[\^$]"
GROUP = r"[(][|]*[)](?:[*+?]|[{][0-9]{1,4}(?:,[0-9]{0,4})?[}])?[?]?|^[|]+$"

_PATTERN_NODES = f"""filter(coalesce(map_entries({jsontree.members('n.v', '$.patternProperties')}),
    cast(array() AS array<struct<key:string,value:variant>>)), e -> {plain_pattern('e.key')})"""


def _branches(keyword: str) -> str:
    """The schemas of a list keyword, each a branch."""
    found = jsontree.elements("n.v", f"$.{keyword}")
    return f"""coalesce(transform({found}, (x, i) -> named_struct('branch', '{keyword}',
        'rule', concat(n.path, '/~{keyword}/', i), 'needs', {_ALWAYS})), {_NO_BRANCHES})"""


# ``needs`` names the member without which a branch does not apply.
_ALWAYS = "cast(NULL AS string)"
_NO_BRANCHES = "cast(array() AS array<struct<branch:string,rule:string,needs:string>>)"
_SINGLE = ", ".join(f"'{k}'" for k in ("not", "if", "then", "else"))
_REFERENCE = "try_variant_get(n.v, '$[\"$ref\"]', 'string')"
# A definition that names none of the keywords has no branches to look for.
_SAME = f"""CASE WHEN NOT _combined THEN {_NO_BRANCHES} ELSE concat(
    {", ".join(_branches(k) for k in ("allOf", "anyOf", "oneOf"))},
    transform(filter(array({_SINGLE}), k -> map_contains_key({jsontree.members('n.v')}, k)),
        k -> named_struct('branch', k, 'rule', concat(n.path, '/~', k), 'needs', {_ALWAYS})),
    coalesce(transform(map_keys({jsontree.members('n.v', '$.dependentSchemas')}), k -> named_struct(
        'branch', 'allOf', 'rule', concat(n.path, '/~dependentSchemas/', {jsontree.step('k')}),
        'needs', k)), {_NO_BRANCHES}),
    transform(filter(array(try_element_at(_places, {_REFERENCE})), p -> p IS NOT NULL),
        p -> named_struct('branch', 'allOf', 'rule', p, 'needs', {_ALWAYS}))) END"""

# Keywords that follow members or items a second time.
_EXTENDED = ("contains", "propertyNames", "unevaluatedProperties", "unevaluatedItems")

_RULES = f"""map_from_entries(transform(_nodes, n -> struct(n.path, named_struct(
    'types', {jsontree.types('n.v')},
    'options', {jsontree.options('n.v')},
    'constant', to_json(try_variant_get(n.v, '$.const', 'variant')),
    'required', try_variant_get(n.v, '$.required', 'array<string>'),
    'closed', coalesce(NOT try_variant_get(n.v, '$.additionalProperties', 'boolean'), false),
    'declared', coalesce(map_keys({jsontree.members('n.v', '$.properties')}), cast(array() AS array<string>)),
    'never', coalesce(NOT try_variant_get(n.v, '$', 'boolean'), false)
        AND {jsontree.kind('n.v')} = 'boolean',
    'distinct', coalesce(try_variant_get(n.v, '$.uniqueItems', 'boolean'), false),
    'pattern', CASE WHEN {plain_pattern("try_variant_get(n.v, '$.pattern', 'string')")}
        THEN try_variant_get(n.v, '$.pattern', 'string') END,
    'patterns', transform({_PATTERN_NODES}, e -> named_struct('expression', e.key,
        'rule', concat(n.path, '/~patternProperties/', {jsontree.step('e.key')}))),
    'prefix', coalesce(size({jsontree.elements('n.v', '$.prefixItems')}), 0),
    'all_members', try_variant_get(n.v, '$.additionalProperties', 'variant') IS NOT NULL,
    'all_items', try_variant_get(n.v, '$.items', 'variant') IS NOT NULL,
    'other', coalesce({jsontree.kind("try_variant_get(n.v, '$.additionalProperties', 'variant')")} = 'object', false),
    'extended', {" OR ".join(f"try_variant_get(n.v, '$.{k}', 'variant') IS NOT NULL" for k in _EXTENDED)},
    'same', {_SAME},
    'further', _further,
    'lost', {_REFERENCE} IS NOT NULL AND try_element_at(_places, {_REFERENCE}) IS NULL,
    'fewest', CASE WHEN try_variant_get(n.v, '$.contains', 'variant') IS NOT NULL
        THEN coalesce(try_variant_get(n.v, '$.minContains', 'bigint'), 1) END,
    'most', try_variant_get(n.v, '$.maxContains', 'bigint'),
    'dependent', try_variant_get(n.v, '$.dependentRequired', 'map<string,array<string>>'),
    {", ".join(f"'{name}', try_variant_get(n.v, '$.{name}', '{kind}')"
               for name, kind in _BOUNDS.items())}))))"""

_NAMES = " OR ".join(f"contains(schema_definition, '\"{k}\"')" for k in COMBINED if k not in ("then", "else"))
_FURTHER = " OR ".join(
    f"contains(schema_definition, '\"{k}\"')"
    for k in ("patternProperties", "propertyNames", "prefixItems", "contains",
              "unevaluatedProperties", "unevaluatedItems")
)
# The internal places of sub-schemas by what a reference calls them.
_PLACES = """CASE WHEN _combined THEN map_from_entries(array_distinct(concat(
    transform(_nodes, n -> struct(concat('#', n.at), n.path)),
    transform(filter(_nodes, n -> try_variant_get(n.v, '$[\"$anchor\"]', 'string') IS NOT NULL),
        n -> struct(concat('#', try_variant_get(n.v, '$[\"$anchor\"]', 'string')), n.path))))) END"""


def compile_rules(schemas: DataFrame, levels: int | None, key: tuple[str, ...]) -> DataFrame:
    """(key..., rules): place of each (sub-)schema -> the checks it asks for; the root
    also has the ``program``, all there is to know of every place as one JSON text.

    References are resolved here, to the place of the sub-schema they name by
    pointer or anchor; one that names none breaks every record (``lost``).
    """
    nodes = jsontree.with_definition_nodes(
        schemas, "try_parse_json(schema_definition)", levels, "_nodes", others=True
    )
    nodes = nodes.withColumn("_combined", F.expr(f"coalesce({_NAMES}, false)"))
    nodes = nodes.withColumn("_further", F.expr(f"_combined OR coalesce({_FURTHER}, false)"))
    nodes = nodes.withColumn("_places", F.expr(_PLACES))
    ruled = nodes.select(*key, F.expr(_RULES).alias("rules"))
    names = [f.name for f in ruled.schema["rules"].dataType.valueType.fields]
    kept = ", ".join(f"'{n}', r.{n}" for n in names)
    ruled = ruled.withColumn(
        "rules", F.expr(f"transform_values(rules, (place, r) -> named_struct({kept}, 'checks', {_ASKED}))")
    )
    return ruled.withColumn("rules", F.expr(f"""transform_values(rules, (place, r) -> named_struct(
        'checks', r.checks, 'program', CASE WHEN place = '' THEN {_PROGRAM} END))"""))


#: Each check and when a rule ``r`` asks for it at all; ``judge`` has what it finds broken.
_CHECKS = (
    ("type", "r.types IS NOT NULL"),
    ("enum", "r.options IS NOT NULL"),
    ("required", "r.required IS NOT NULL"),
    ("extra", "r.closed"),
    ("never", "r.never"),
    ("$ref", "r.lost"),
    ("const", "r.constant IS NOT NULL"),
    ("pattern", "r.pattern IS NOT NULL"),
    ("uniqueItems", "r.distinct"),
    ("contains", "r.fewest > 0"),
    ("dependentRequired", "r.dependent IS NOT NULL"),
    *((name, f"r.{name} IS NOT NULL") for name in _BOUNDS),
)

#: The checks a rule asks for, by their place in the list.
_ASKED = f"""filter(array({", ".join(f"CASE WHEN {asked} THEN {i} END" for i, (_, asked) in enumerate(_CHECKS))}),
    c -> c IS NOT NULL)"""


def _bound(name: str, kind: str) -> str:
    """A bound as texts: whole numbers are compared as such where both sides are, anything
    else as doubles; multiples are looked for among decimals of nine places first."""
    if kind != "variant":
        return f"r.{name}"
    return f"""CASE WHEN r.{name} IS NOT NULL THEN named_struct(
        'whole', CASE WHEN {jsontree.kind(f"r.{name}")} = 'integer'
            THEN cast({_as(f"r.{name}", "decimal(38,0)")} AS string) END,
        'real', cast({_as(f"r.{name}", "double")} AS string),
        'exact', cast({_as(f"r.{name}", "decimal(38,9)")} AS string)) END"""


# What is false, empty or zero is left out: the text travels with every row.
_PROGRAM = f"""to_json(transform_values(rules, (at, r) -> named_struct(
    {", ".join(f"'{k}', r.{k}" for k in ("types", "options", "constant", "required", "pattern",
                                          "fewest", "most", "dependent"))},
    {", ".join(f"'{k}', CASE WHEN size(r.{k}) > 0 THEN r.{k} END" for k in ("declared", "patterns", "same"))},
    {", ".join(f"'{k}', CASE WHEN r.{k} THEN true END" for k in ("all_members", "all_items", "other",
                                                                "extended", "further"))},
    'prefix', CASE WHEN r.prefix > 0 THEN r.prefix END,
    'checks', CASE WHEN size(r.checks) > 0 THEN transform(r.checks,
        c -> array({", ".join(f"'{name}'" for name, _ in _CHECKS)})[c]) END,
    {", ".join(f"'{name}', {_bound(name, kind)}" for name, kind in _BOUNDS.items())})))"""


def with_violations(
    df: DataFrame, record: str, levels: int | None = None, rules: str = "rules", out: str = "violations"
) -> DataFrame:
    """Add every violation of a parsed record against the rules in its row.

    ``levels`` is not needed any more: every record is followed to its own depth.
    Of a broken ``anyOf``, ``oneOf``, ``not`` or ``contains`` the detail is the number of
    branches (or items) that hold. Of ``unevaluatedProperties`` and ``unevaluatedItems`` it
    is the member or place that no other schema of the value speaks of.
    """
    program = F.expr(f"{rules}['']['program']")
    return df.withColumn(out, judge.judged(F.col(record), program, VIOLATIONS))


def unchecked_keywords(schemas: DataFrame, levels: int) -> DataFrame:
    """Add ``unchecked``: the sorted keywords of a definition that records are not
    held against (such as ``dependencies`` or ``additionalItems``)."""
    known = ", ".join(f"'{name}'" for name in (*CHECKED, *DESCRIPTIVE))
    df = jsontree.with_definition_nodes(
        schemas, "try_parse_json(schema_definition)", levels, "_nodes", others=True
    )
    used = f"flatten(transform(_nodes, n -> coalesce(map_keys({jsontree.members('n.v')}), cast(array() AS array<string>))))"
    return df.withColumn(
        "unchecked", F.expr(f"array_sort(array_distinct(array_except({used}, array({known}))))")
    ).drop("_nodes")
