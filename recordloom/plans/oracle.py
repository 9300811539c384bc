"""DuckDB SQL each query is checked with, written on its own: relational and
recursive where the Spark side works inside rows."""

from __future__ import annotations

from recordloom import model
from recordloom.functions import text
from recordloom.operators import prompting, registry
from recordloom.plans.derived import duck
from recordloom.plans.queries import ASOF, MEMORY, STOP_AT

_ASOF = f"TIMESTAMP '{ASOF:%Y-%m-%d %H:%M:%S}'"
_STOP_AT = f"TIMESTAMP '{STOP_AT:%Y-%m-%d %H:%M:%S}'"


def stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


KIND = """CASE WHEN mime_type = 'text/plain' THEN 'text' WHEN mime_type = 'application/pdf' THEN 'pdf'
  WHEN mime_type IN ('image/png', 'image/jpg', 'image/jpeg', 'image/gif', 'image/bmp', 'image/tiff')
  THEN 'image' ELSE 'unsupported' END"""

_LENGTHS = """concat_ws('; ',
  CASE WHEN length(schema_name) < 4 THEN 'schema_name: too short' END,
  CASE WHEN length(schema_version) <> 10 THEN 'schema_version: wrong length' END,
  CASE WHEN length(content) < 1 THEN 'content: too short' END,
  CASE WHEN length(mime_type) < 1 THEN 'mime_type: too short' END)"""

CHECKED = f"""checked AS (
  SELECT *, {KIND} AS kind, {_LENGTHS} AS problems,
    CASE WHEN {_LENGTHS} <> '' THEN 'ValidationError'
      WHEN {KIND} = 'unsupported' THEN 'InvalidMimeType' END AS error_name
  FROM requests),
good AS (SELECT * FROM checked WHERE error_name IS NULL),
decoded AS (
  SELECT *, CASE WHEN kind IN ('pdf', 'image') AND content NOT LIKE '#%'
    THEN decode(from_base64(content)) END AS body FROM good),
paged AS (
  SELECT *, CASE WHEN kind = 'pdf' AND body IS NOT NULL THEN string_split(body, chr(10))
      WHEN kind = 'image' AND body IS NOT NULL THEN [body] ELSE [] END AS pages,
    CASE WHEN kind = 'pdf' THEN 'image/png' ELSE mime_type END AS page_mime,
    kind IN ('pdf', 'image') AND body IS NULL AS undecodable
  FROM decoded)"""

PREPARED = f"""{CHECKED},
prepared AS (
  SELECT p.*, s.schema_definition, CASE WHEN kind = 'text' THEN content ELSE '' END AS text_data,
    list_transform(pages, lambda x, i: concat(request_id, '/', i, '-', sha256(x))) AS image_list
  FROM paged p JOIN doc_schemas s USING (schema_name, schema_version))"""


def _first(pattern: str) -> str:
    return f"nullif(regexp_extract(text_data, '{pattern}'), '')"


_EMAIL = _first(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]+")
_IP = _first(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}")
_PHONE = _first(r"\(?[0-9]{3}\)?[ -][0-9]{3}-[0-9]{4}")
_DIGITS = _first("[0-9]+")

EXTRACTED = f"""{PREPARED},
found AS (
  SELECT *, coalesce('"' || {_EMAIL} || '"', 'null') AS email,
    coalesce('"' || {_IP} || '"', 'null') AS ip, coalesce('"' || {_PHONE} || '"', 'null') AS phone,
    coalesce(regexp_replace({_DIGITS}, '^0+([0-9])', '\\1'), 'null') AS digits
  FROM prepared WHERE NOT undecodable),
extracted AS (
  SELECT *, CASE schema_name
    WHEN 'doc_en' THEN concat('{{"email":', email, ',"ip":', ip, ',"phone":', phone, '}}')
    WHEN 'doc_fr' THEN concat('{{"contact":{{"email":', email, ',"phone":', phone, '}},"ip":', ip, '}}')
    ELSE concat('{{"digits":', digits, ',"email":', email, '}}') END AS record,
    schema_name = 'doc_de' AND digits = 'null' AS broken
  FROM found)"""

OUTCOMES = f"""{EXTRACTED},
unresolved AS (SELECT * FROM good g WHERE NOT EXISTS (
  SELECT 1 FROM doc_schemas s
  WHERE s.schema_name = g.schema_name AND s.schema_version = g.schema_version)),
refused AS (
  SELECT request_id, schema_name, error_name,
    CASE WHEN error_name = 'ValidationError' THEN problems ELSE 'Invalid MIME type.' END
      AS error_message
  FROM checked WHERE error_name IS NOT NULL),
undecoded AS (
  SELECT request_id, schema_name, 'Error' AS error_name, 'Content is not base64' AS error_message
  FROM prepared WHERE undecodable),
finished AS (
  SELECT request_id, schema_name, CASE WHEN broken THEN 'InvalidData' END AS error_name,
    CASE WHEN broken THEN 'Data does not match schema' END AS error_message,
    CASE WHEN NOT broken THEN record END AS result
  FROM extracted)"""


def definition_nodes(source: str, keys: str) -> str:
    """Recursive walk over the sub-schemas of ``source``(keys, v JSON)."""
    return f"""nodes AS (
  SELECT {keys}, '' AS path, '' AS name, 0 AS depth, true AS needed, v FROM {source}
  UNION ALL
  SELECT {keys}, c.path, c.name, depth + 1, c.needed, c.v FROM (
    SELECT {keys}, depth, unnest(list_concat(
      CASE WHEN json_type(v, '$.properties') = 'OBJECT' THEN
        list_transform(json_keys(v, '$.properties'), lambda k: {{
          'path': concat(path, '/', k), 'name': k,
          'needed': coalesce(list_contains(json_extract_string(v, '$.required[*]'), k), false),
          'v': json_extract(v, concat('$.properties."', k, '"'))}}) ELSE [] END,
      CASE WHEN json_exists(v, '$.items') THEN [{{
          'path': concat(path, '/~i'), 'name': '~i', 'needed': false,
          'v': json_extract(v, '$.items')}}] ELSE [] END)) AS c
    FROM nodes))"""


TYPES = """CASE json_type(v, '$.type') WHEN 'ARRAY' THEN json_extract_string(v, '$.type[*]')
  WHEN 'VARCHAR' THEN [json_extract_string(v, '$.type')] END"""
OPTIONS = """CASE WHEN json_type(v, '$.enum') = 'ARRAY'
  THEN list_transform(json_extract(v, '$.enum[*]'), lambda o: CAST(o AS VARCHAR)) END"""

# Answers as JSON: the tab is escaped and the repeated key dropped by hand, both
# of which the strict reader here would refuse.
PARSED = r"""spans AS (
  SELECT *, regexp_extract(trim(content), '\{.*\}', 0, 's') AS span FROM answers),
cleaned AS (
  SELECT *, replace(replace(span, chr(9), '\t'), '{"doc_id":"x","doc_id":', '{"doc_id":') AS body
  FROM spans),
parsed AS (
  SELECT *, CASE WHEN json_valid(body) AND NOT contains(body, 'NaN') THEN CAST(body AS JSON) END
    AS v FROM cleaned)"""

# Read from the text: the JSON reader here turns long reals into doubles.
CHARS = """CASE WHEN v IS NOT NULL THEN CAST(CAST(
  nullif(regexp_extract(body, '"chars":([0-9.]+)', 1), '') AS DECIMAL(38, 9)) AS VARCHAR) END"""

_KIND_OF = """CASE json_type(v) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array'
  WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null'
  WHEN 'DOUBLE' THEN 'number' ELSE 'integer' END"""

VIOLATIONS = f"""{PARSED},
definitions AS (
  SELECT schema_name, schema_version, CAST(schema_definition AS JSON) AS v FROM answer_schemas),
{definition_nodes("definitions", "schema_name, schema_version")},
ruleset AS (
  SELECT schema_name, schema_version, path, {TYPES} AS types, {OPTIONS} AS options,
    json_extract_string(v, '$.required[*]') AS required,
    json_extract_string(v, '$.additionalProperties') = 'false' AS closed,
    coalesce(json_keys(v, '$.properties'), []) AS declared
  FROM nodes),
held AS (
  SELECT request_id, schema_name, schema_version, '' AS path, '' AS rule, v
  FROM parsed WHERE v IS NOT NULL
  UNION ALL
  SELECT request_id, schema_name, schema_version, c.path, c.rule, c.v FROM (
    SELECT request_id, schema_name, schema_version, unnest(
      CASE json_type(v)
        WHEN 'OBJECT' THEN list_transform(json_keys(v), lambda k: {{
          'path': concat(path, '/', k), 'rule': concat(rule, '/', k),
          'v': json_extract(v, concat('$."', k, '"'))}})
        WHEN 'ARRAY' THEN list_transform(range(CAST(json_array_length(v) AS BIGINT)), lambda i: {{
          'path': concat(path, '/', i), 'rule': concat(rule, '/~i'),
          'v': json_extract(v, concat('$[', i, ']'))}})
        ELSE [] END) AS c FROM held)),
judged AS (
  SELECT h.*, {_KIND_OF.replace("(v)", "(h.v)")} AS kind, r.types, r.options, r.required, r.closed,
    r.declared
  FROM held h JOIN ruleset r ON h.schema_name = r.schema_name
    AND h.schema_version = r.schema_version AND h.rule = r.path),
violations AS (
  SELECT request_id, path, 'type' AS "check", kind AS detail FROM judged
  WHERE types IS NOT NULL AND NOT list_contains(types, kind)
    AND NOT (kind = 'integer' AND list_contains(types, 'number'))
  UNION ALL
  SELECT request_id, path, 'enum', CAST(v AS VARCHAR) FROM judged
  WHERE options IS NOT NULL AND NOT list_contains(options, CAST(v AS VARCHAR))
  UNION ALL
  SELECT request_id, path, 'required', k FROM (
    SELECT request_id, path, v, unnest(required) AS k FROM judged WHERE kind = 'object')
  WHERE NOT list_contains(json_keys(v), k)
  UNION ALL
  SELECT request_id, path, 'extra', k FROM (
    SELECT request_id, path, declared, unnest(json_keys(v)) AS k FROM judged
    WHERE kind = 'object' AND closed)
  WHERE NOT list_contains(declared, k))"""

CURRENT = """current AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (
      PARTITION BY schema_name, schema_version ORDER BY written_at DESC) AS n FROM schema_log)
  WHERE n = 1),
listed AS (SELECT * FROM current WHERE schema_status <> 'DELETED')"""

_STRING = r'"[^"\\]*(?:\\.[^"\\]*)*"'
def _tokens(definition: str) -> str:
    """The estimate, written out for one expression."""
    compact = f"regexp_replace({definition}, '({_STRING})|\\s+', '\\1', 'g')"
    return f"""(len(regexp_extract_all({compact}, '{text.TOKEN_PIECE}'))
      + length(regexp_replace(regexp_replace({compact}, '{_STRING}', '', 'g'), '[^,:]', '', 'g')))"""


COUNTED = f"""counted AS (
  SELECT *, len(regexp_extract_all(compact, '{text.TOKEN_PIECE}'))
    + length(regexp_replace(regexp_replace(compact, '{_STRING}', '', 'g'), '[^,:]', '', 'g'))
    AS tokens
  FROM (SELECT *, regexp_replace(schema_definition, '({_STRING})|\\s+', '\\1', 'g') AS compact
    FROM registrations))"""

VERSION = """substr(translate(to_base64(unhex(sha256(concat_ws('|', schema_name,
  schema_definition, CAST(created_at AS VARCHAR))))), '+/', 'ab'), 1, 10)"""

_REG_NODES = f"""given AS (
  SELECT p_partkey, CAST(schema_definition AS JSON) AS v FROM registrations
  WHERE json_valid(schema_definition)),
objects AS (SELECT * FROM given WHERE json_type(v) = 'OBJECT'),
{definition_nodes("objects", "p_partkey")}"""


def _not_in(name: str, *kinds: str) -> str:
    wanted = ", ".join(f"'{k}'" for k in kinds)
    return f"json_exists(v, '$.{name}') AND json_type(v, '$.{name}') NOT IN ({wanted})"


_META = {
    "schema must be an object or a boolean": "json_type(v) NOT IN ('OBJECT', 'BOOLEAN')",
    "type must be a name or a list of distinct names": (
        f"len({TYPES}) <> len(list_distinct({TYPES})) OR len({TYPES}) = 0 OR len(list_filter("
        f"{TYPES}, lambda t: t NOT IN ('array', 'boolean', 'integer', 'null', 'number', 'object', "
        "'string'))) > 0"
    ),
    "required must be a list of distinct strings": (
        f"({_not_in('required', 'ARRAY')}) OR len(json_extract(v, '$.required[*]')) "
        "<> len(list_distinct(json_extract_string(v, '$.required[*]')))"
    ),
    "enum must be a list": _not_in("enum", "ARRAY"),
    "properties must be an object": _not_in("properties", "OBJECT"),
    "items must be a schema": _not_in("items", "OBJECT", "BOOLEAN"),
    "additionalProperties must be a schema": _not_in("additionalProperties", "OBJECT", "BOOLEAN"),
    "title must be a string": _not_in("title", "VARCHAR"),
    "description must be a string": _not_in("description", "VARCHAR"),
    "format must be a string": _not_in("format", "VARCHAR"),
}
PROBLEMS = f"""{_REG_NODES},
problems AS (
  SELECT p_partkey, ': definition is not JSON' AS problem FROM registrations
  WHERE NOT json_valid(schema_definition)
  UNION ALL
  SELECT p_partkey, ': definition must be an object' FROM given WHERE json_type(v) <> 'OBJECT'
  UNION ALL
""" + "  UNION ALL\n".join(
    f"  SELECT p_partkey, concat(path, ': {rule}') FROM nodes WHERE {broken}\n"
    for rule, broken in _META.items()
) + ")"

LATEST = """latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY request_id ORDER BY created_at DESC) AS n FROM states) WHERE n = 1),
stored AS (
  SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY request_id ORDER BY written_at DESC) AS n FROM written_results) WHERE n = 1)"""

FOLD = f"""ranked AS (
  SELECT conv_id, turn, role, text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r
  FROM conversations WHERE role <> 'system'),
fold AS (
  SELECT conv_id, r, role, turn, 1 AS held FROM ranked WHERE r = 1
  UNION ALL
  SELECT k.conv_id, k.r, k.role, k.turn,
    CASE WHEN k.role = 'user' AND f.held + 1 > {MEMORY} THEN f.held - 1 ELSE f.held + 1 END
  FROM fold f JOIN ranked k ON k.conv_id = f.conv_id AND k.r = f.r + 1),
sent AS (
  SELECT f.conv_id, f.turn, count(*) AS messages,
    string_agg(concat(h.role, ':', h.text), '|' ORDER BY h.r) AS history
  FROM fold f JOIN ranked h ON h.conv_id = f.conv_id AND h.r > f.r - f.held AND h.r <= f.r
  WHERE f.role = 'user' GROUP BY f.conv_id, f.turn)"""

_BEFORE, _BETWEEN, _AFTER = prompting.USER_MESSAGE.split("%s")


def _case(mapping: dict[str, str], column: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {column} {cases} END"


def _with(views: str, ctes: str, select: str) -> str:
    parts = [part for part in (duck(*views.split()), ctes) if part]
    return f"WITH RECURSIVE {', '.join(parts)} {select}"


def _check(check: str) -> str:
    return _with(
        "answers answer_schemas",
        VIOLATIONS,
        f"SELECT request_id, path, detail FROM violations WHERE \"check\" = '{check}'",
    )


_RETRY = """tries AS (
  SELECT *, CASE WHEN doc_id % 4 < 3 THEN doc_id % 4 + 1 ELSE 3 END AS attempts,
    CASE WHEN doc_id % 4 < 3 THEN concat('{"doc_id":', doc_id,
      ',"lang":"en","size":{"chars":1,"unit":"words"}}') END AS result
  FROM answers)"""

# Requests that are not expired when the queue is run.
_LIVE = """SELECT e.* FROM extracted e JOIN requests r USING (request_id)
    WHERE r.created_at >= TIMESTAMP '2024-01-01 00:00:30'"""

ORACLE: dict[str, str] = {
    "d1_scan_text": """SELECT CAST(doc_id AS VARCHAR) AS document_id, 'text/plain' AS mime_type,
        length(text) AS n_chars, md5(text) AS digest FROM documents""",
    "d2_base64": """SELECT doc_id, length(to_base64(encode(text))) AS encoded_length,
        md5(to_base64(encode(text))) AS digest FROM documents""",
    "d3_unbase64": _with("requests", "", f"""SELECT request_id,
        CASE WHEN content NOT LIKE '#%' THEN octet_length(from_base64(content)) END AS n_bytes,
        CASE WHEN content NOT LIKE '#%' THEN md5(decode(from_base64(content))) END AS digest,
        content LIKE '#%' AS failed FROM requests WHERE {KIND} IN ('pdf', 'image')"""),
    "d4_validate_requests": _with("requests", CHECKED, """SELECT request_id, error_name,
        CASE error_name WHEN 'ValidationError' THEN problems
          WHEN 'InvalidMimeType' THEN 'Invalid MIME type.' END AS error_message FROM checked"""),
    "d5_mime_kind": _with("requests", "", f"""SELECT mime_type, {KIND} AS kind,
        count(*) AS requests FROM requests GROUP BY 1, 2"""),
    "d7_page_fanout": _with("requests", CHECKED, """SELECT request_id, page_mime AS mime_type,
        i AS page_no, md5(pages[i]) AS digest
        FROM (SELECT *, unnest(range(1, len(pages) + 1)) AS i FROM paged WHERE len(pages) > 0)
        UNION ALL SELECT request_id, page_mime, NULL, NULL FROM paged WHERE len(pages) = 0"""),
    "d8_manifest": _with("requests", CHECKED, """SELECT request_id, page_mime AS mime_type,
        i AS page_no, concat(request_id, '/', i, '-', sha256(pages[i])) AS object_key,
        octet_length(encode(pages[i])) AS n_bytes
        FROM (SELECT *, unnest(range(1, len(pages) + 1)) AS i FROM paged WHERE len(pages) > 0)"""),
    "d7_custom_pages": _with("requests", CHECKED, """SELECT request_id, kind,
        md5(array_to_string(list_transform(pages, lambda x, i:
          concat(request_id, '/', i, '-', sha256(x))), ',')) AS image_digest,
        len(pages) AS images,
        CASE WHEN kind <> 'text' AND body IS NULL THEN 'Error' END AS error_name FROM paged"""),
    "d9_resolve": _with("requests doc_schemas", "", """SELECT request_id, schema_name,
        schema_version, schema_description, schema_status
        FROM requests JOIN doc_schemas USING (schema_name, schema_version)"""),
    "d10_unresolved": _with("requests doc_schemas", "", """SELECT request_id, schema_name,
        schema_version, 'SchemaDoesNotExist' AS error_name,
        'Schema does not exist.' AS error_message
        FROM requests r WHERE NOT EXISTS (SELECT 1 FROM doc_schemas s
          WHERE s.schema_name = r.schema_name AND s.schema_version = r.schema_version
            AND s.schema_status <> 'DELETED')"""),
    "d11_prepare": _with("requests doc_schemas", PREPARED, """SELECT request_id,
        CASE WHEN undecodable THEN 'Error' END AS error_name, md5(text_data) AS text_digest,
        md5(array_to_string(image_list, ',')) AS image_digest, len(image_list) AS images,
        length(schema_definition) AS definition_length FROM prepared"""),
    "d12_page_requests": """SELECT concat(doc_id, '-', i) AS request_id,
        'doc_en' AS schema_name, '0123456789' AS schema_version, 'image/png' AS mime_type,
        md5(to_base64(encode(pages[i]))) AS digest
        FROM (SELECT *, unnest(range(1, len(pages) + 1)) AS i
          FROM (SELECT doc_id, string_split(text, chr(10)) AS pages FROM documents))""",
    "s1_register": _with("registrations", f"{PROBLEMS}, {COUNTED}, bad AS ("
        "SELECT p_partkey, bool_or(problem LIKE ': definition%') AS no_object FROM problems "
        "GROUP BY p_partkey), verdicts AS (SELECT c.*, CASE "
        "WHEN length(schema_name) < 4 OR length(schema_description) < 8 OR b.no_object "
        "THEN 'ValidationError' WHEN b.p_partkey IS NOT NULL THEN 'SchemaError' "
        "WHEN tokens > 2048 THEN 'SchemaDefinitionTooLarge' END AS error_name "
        "FROM counted c LEFT JOIN bad b USING (p_partkey))",
        f"""SELECT p_partkey, schema_name, CASE WHEN error_name IS NULL THEN {VERSION} END
          AS schema_version, CASE WHEN error_name IS NULL THEN 'ACTIVE' END AS schema_status,
        CASE WHEN error_name IS NULL THEN tokens END AS tokens, error_name FROM verdicts"""),
    "io1_registry": _with("registrations", f"{PROBLEMS}, {COUNTED}, bad AS ("
        "SELECT p_partkey, bool_or(problem LIKE ': definition%') AS no_object FROM problems "
        "GROUP BY p_partkey), good AS (SELECT c.*, "
        f"{VERSION} AS schema_version FROM counted c LEFT JOIN bad b USING (p_partkey) "
        "WHERE length(schema_name) >= 4 AND length(schema_description) >= 8 "
        "AND b.p_partkey IS NULL AND tokens <= 2048)",
        """SELECT schema_name, schema_version, any_value(tokens) AS tokens,
          CASE WHEN max(p_size) > 40 THEN 'DELETED' ELSE 'ACTIVE' END AS schema_status
        FROM good GROUP BY ALL"""),
    "s2_check_definition": _with("registrations", PROBLEMS, "SELECT * FROM problems"),
    "s3_token_limit": _with("registrations", COUNTED, """SELECT p_partkey, tokens,
        tokens > 2048 AS too_large, true AS is_estimate FROM counted"""),
    "s4_get_schema": _with("schema_log schema_keys", CURRENT, f"""SELECT k.schema_name,
        k.schema_version, md5(l.schema_definition) AS definition_digest,
        CAST({_tokens('l.schema_definition')} AS BIGINT) AS number_of_tokens,
        CASE WHEN l.schema_name IS NULL THEN 'SchemaDoesNotExist' END AS error_name,
        CASE WHEN l.schema_name IS NULL THEN 'Schema does not exist.' END AS error_message
        FROM schema_keys k LEFT JOIN listed l USING (schema_name, schema_version)"""),
    "s5_list_by_name": _with("schema_log", CURRENT, """SELECT schema_name, schema_version,
        schema_description, count(*) OVER (PARTITION BY schema_name) AS version_count
        FROM listed"""),
    "s6_list_all": _with("schema_log", CURRENT, f"""SELECT schema_name, schema_version, row_no,
        (row_no - 1) // {model.LIST_PAGE_SIZE} + 1 AS page_number FROM (SELECT *,
          row_number() OVER (ORDER BY schema_name, schema_version) AS row_no FROM listed)"""),
    "s7_soft_delete": _with("schema_log schema_keys", CURRENT, """SELECT DISTINCT k.schema_name,
        k.schema_version, CASE WHEN l.schema_name IS NOT NULL THEN 'DELETED' END AS schema_status,
        CASE WHEN l.schema_name IS NULL THEN 'SchemaDoesNotExist' END AS error
        FROM schema_keys k LEFT JOIN listed l USING (schema_name, schema_version)"""),
    "s8_version_id": _with("registrations", "",
        f"SELECT p_partkey, {VERSION} AS schema_version FROM registrations"),
    "s9_fields": _with("schema_log", f"""given AS (
        SELECT row_number() OVER () AS row_key, * FROM schema_log),
        objects AS (SELECT row_key, CAST(schema_definition AS JSON) AS v FROM given),
        {definition_nodes("objects", "row_key")}""", f"""SELECT schema_name, schema_version, path,
        CAST(depth AS BIGINT) AS depth, array_to_string({TYPES}, ',') AS types,
        coalesce(list_contains({TYPES}, 'null'), false) AS nullable,
        json_extract_string(v, '$.format') AS format,
        array_to_string({OPTIONS}, ',') AS options, needed AS required,
        json_extract_string(v, '$.description') AS description
        FROM nodes JOIN given USING (row_key) WHERE depth > 0"""),
    "s10_field_tag": _with("schema_log", f"""objects AS (
        SELECT row_number() OVER () AS row_key, CAST(schema_definition AS JSON) AS v
          FROM schema_log),
        {definition_nodes("objects", "row_key")},
        tagged AS (SELECT name AS field_name, coalesce(json_extract_string(v, '$.format'),
          list_filter({TYPES}, lambda t: t <> 'null')[1]) AS tag FROM nodes WHERE depth > 0)""",
        f"""SELECT field_name, tag, {_case(registry.FIELD_TAGS, "tag")} AS tag_colour,
        count(*) AS fields FROM tagged GROUP BY 1, 2, 3"""),
    "s11_lint": _with("registrations", f"""objects AS (
        SELECT p_partkey, CAST(schema_definition AS JSON) AS v FROM registrations
        WHERE json_valid(schema_definition)),
        {definition_nodes("objects", "p_partkey")},
        fields AS (SELECT *, {TYPES} AS types FROM nodes WHERE depth > 0),
        findings AS (
          SELECT p_partkey, path, 'field has no description' AS finding FROM fields
          WHERE name <> '~i' AND trim(coalesce(json_extract_string(v, '$.description'), '')) = ''
          UNION ALL SELECT p_partkey, path, 'field does not admit null' FROM fields
          WHERE name <> '~i' AND types IS NOT NULL AND NOT list_contains(types, 'object')
            AND NOT list_contains(types, 'null')
          UNION ALL SELECT p_partkey, path, 'field is not snake case' FROM fields
          WHERE name <> '~i' AND NOT regexp_matches(name, '{registry.SNAKE_CASE}')
          UNION ALL SELECT p_partkey, path, 'field is not required' FROM fields
          WHERE name <> '~i' AND NOT needed
          UNION ALL SELECT p_partkey, path, 'field has no type' FROM fields WHERE types IS NULL
          UNION ALL SELECT p_partkey, '', 'schema has no description'
          FROM registrations LEFT JOIN objects USING (p_partkey)
          WHERE coalesce(json_extract_string(v, '$.description'), '') = '')""",
        """SELECT schema_name, CAST(p_partkey AS VARCHAR) AS schema_version, path, finding
        FROM findings JOIN registrations USING (p_partkey)"""),
    "s12_typed_record": _with("answers answer_schemas", VIOLATIONS, f"""SELECT request_id,
        CAST(json_extract_string(v, '$.doc_id') AS BIGINT) AS doc_id,
        json_extract_string(v, '$.lang') AS lang,
        {CHARS} AS chars,
        json_extract_string(v, '$.size.unit') AS unit,
        CAST(json_array_length(v, '$.tags') AS BIGINT) AS tags
        FROM parsed WHERE v IS NOT NULL
          AND request_id NOT IN (SELECT request_id FROM violations)"""),
    "s13_tool_spec": _with("schema_log", """slim AS (SELECT *, replace(
          CAST(json(schema_definition) AS VARCHAR), '"description":"Data of a part",', '')
          AS parameters FROM schema_log)""", """SELECT schema_name, schema_version,
        concat('get_', schema_name, '_data') AS name, schema_description AS description,
        array_to_string(list_sort(json_keys(CAST(parameters AS JSON))), ',') AS parameters,
        length(concat('{"type":"function","function":{"name":"get_', schema_name,
          '_data","description":"', schema_description, '","parameters":', parameters, '}}'))
          AS spec_length FROM slim"""),
    "e1_prompt": _with("requests doc_schemas", PREPARED, f"""SELECT request_id,
        'system' AS first_role, 'user' AS second_role, len(image_list) + 1 AS parts,
        md5(concat('{_BEFORE}', schema_definition, '{_BETWEEN}', text_data, '{_AFTER}'))
          AS text_digest, md5(array_to_string(image_list, ',')) AS image_digest
        FROM prepared"""),
    "e2_model": _with("requests doc_schemas", PREPARED, """SELECT request_id, mime_type,
        CASE WHEN len(image_list) > 0 THEN 'vision-model' ELSE 'text-model' END AS model
        FROM prepared"""),
    "e3_rule_extract": _with("requests doc_schemas", EXTRACTED,
        "SELECT request_id, schema_name, record AS content FROM extracted"),
    "e4_unwrap": _with("responses", "", """SELECT request_id,
        json_extract_string(response, '$.choices[0].message.content') AS content,
        CAST(json_extract(response, '$.usage.prompt_tokens') AS BIGINT) AS prompt_tokens,
        CAST(json_extract(response, '$.usage.completion_tokens') AS BIGINT) AS completion_tokens,
        CAST(json_extract(response, '$.usage.total_tokens') AS BIGINT) AS total_tokens
        FROM responses"""),
    "e5_json_span": _with("answers", PARSED, "SELECT request_id, span FROM spans"),
    "e6_parse": _with("answers", PARSED, rf"""SELECT request_id, v IS NOT NULL AS parsed,
        regexp_replace(json_extract_string(v, '$.doc_id'), '\.0$', '') AS doc_id,
        json_extract_string(v, '$.lang') AS lang,
        {CHARS} AS chars,
        CASE WHEN v IS NOT NULL THEN array_to_string(list_transform(json_extract(v, '$.tags[*]'),
          lambda x: coalesce(json_extract_string(x, '$'), 'null')), '|') END AS tags
        FROM parsed"""),
    "e7_required": _check("required"),
    "e7_type": _check("type"),
    "e7_enum": _check("enum"),
    "e7_extra": _check("extra"),
    "e7_nested": _with("answers answer_schemas", VIOLATIONS, """SELECT * FROM violations
        WHERE regexp_matches(path, '^/[^/]+/[^/0-9]')
          OR (path <> '' AND "check" IN ('required', 'extra'))"""),
    "e7_array": _with("answers answer_schemas", VIOLATIONS,
        "SELECT * FROM violations WHERE regexp_matches(path, '/[0-9]+$')"),
    "e8_retry": _with("answers", _RETRY, """SELECT request_id, CAST(attempts AS BIGINT) AS attempts,
        CAST(2 * attempts AS BIGINT) AS messages, result,
        CASE WHEN result IS NULL THEN 'JSONDecodeError' END AS error_name FROM tries"""),
    "e9_result": _with("answers", _RETRY, f"""SELECT request_id, schema_name, schema_version,
        '{model.TEXT_MODEL}' AS model, {model.SEED}::BIGINT AS seed,
        {model.MAX_OUTPUT_TOKENS}::BIGINT AS max_tokens, result,
        CAST(10 + attempts AS BIGINT) AS total_tokens,
        concat(request_id, '/1,', request_id, '/2') AS images
        FROM tries WHERE result IS NOT NULL"""),
    "e7_bounds": _with("bounded_records", "", """
        SELECT event_id, '/value' AS path, 'minimum' AS "check" FROM bounded_records
          WHERE CAST(json_extract(content, '$.value') AS BIGINT) < 2
        UNION ALL SELECT event_id, '/value', 'exclusiveMaximum' FROM bounded_records
          WHERE CAST(json_extract(content, '$.value') AS BIGINT) >= 90
        UNION ALL SELECT event_id, '/kind', 'minLength' FROM bounded_records
          WHERE length(json_extract_string(content, '$.kind')) < 5
        UNION ALL SELECT event_id, '/tags', 'minItems' FROM bounded_records WHERE event_id % 5 = 0
        UNION ALL SELECT event_id, '/tags', 'maxItems' FROM bounded_records WHERE event_id % 5 = 4
        UNION ALL SELECT event_id, '/tags', 'uniqueItems' FROM bounded_records
          WHERE event_id % 5 = 2
        UNION ALL SELECT event_id, '/unit', 'const' FROM bounded_records WHERE event_id % 3 = 0"""),
    "e7_additional_schema": _with("bounded_records", "", """
        SELECT event_id, '/more' AS path, 'type' AS "check" FROM bounded_records
          WHERE event_id % 4 = 0
        UNION ALL SELECT event_id, '/more', 'maxLength' FROM bounded_records
          WHERE event_id % 4 = 1
        UNION ALL SELECT event_id, '/kind', 'maxLength' FROM bounded_records
          WHERE length(json_extract_string(content, '$.kind')) > 6"""),
    "e7_boolean_schema": _with("bounded_records", "", """SELECT event_id, '/blocked' AS path,
        'never' AS "check" FROM bounded_records WHERE event_id % 7 = 0"""),
    "e7_combinators": _with("combined_records", "", """
        SELECT event_id, '/value' AS path, 'anyOf' AS "check" FROM combined_records
          WHERE score > 20 AND score < 60 AND score % 10 <> 0
        UNION ALL SELECT event_id, '/kind', 'oneOf' FROM combined_records WHERE kind = 'click'
        UNION ALL SELECT event_id, '/value', 'not' FROM combined_records
          WHERE kind = 'error' AND score % 7 = 0"""),
    "e7_ref": _with("combined_records", "", """
        SELECT event_id, '/child/value' AS path, 'maximum' AS "check" FROM combined_records
          WHERE event_id % 4 >= 1 AND score > 80
        UNION ALL SELECT event_id, '/child/child/value', 'maximum' FROM combined_records
          WHERE event_id % 4 >= 2 AND score > 80
        UNION ALL SELECT event_id, '/child/child/child/value', 'type' FROM combined_records
          WHERE event_id % 4 = 3"""),
    "e7_patterns": _with("combined_records", "", """
        SELECT event_id, '' AS path, 'extra' AS "check" FROM combined_records
          WHERE event_id % 9 = 0
        UNION ALL SELECT event_id, '/Extra', 'pattern' FROM combined_records
          WHERE event_id % 9 = 0 AND kind <> 'error'
        UNION ALL SELECT event_id, '/x1', 'maximum' FROM combined_records
          WHERE event_id % 4 = 3"""),
    "e7_positions": _with("combined_records", "", """
        SELECT event_id, '/tags' AS path, 'contains' AS "check" FROM combined_records
          WHERE event_id % 5 = 2
        UNION ALL SELECT event_id, '/tags/2', 'never' FROM combined_records WHERE event_id % 5 >= 3
        UNION ALL SELECT event_id, '/tags/3', 'never' FROM combined_records
          WHERE event_id % 5 = 4"""),
    "e7_evaluated": _with("evaluated_records", "", """
        SELECT event_id, '' AS path, 'unevaluatedProperties' AS "check", 'place' AS detail
          FROM evaluated_records WHERE event_id % 2 = 0 AND kind <> 'click'
        UNION ALL SELECT event_id, '', 'unevaluatedProperties', 'amount' FROM evaluated_records
          WHERE event_id % 3 = 0 AND kind = 'click'
        UNION ALL SELECT event_id, '', 'unevaluatedProperties', 'refund' FROM evaluated_records
          WHERE event_id % 5 = 1
        UNION ALL SELECT event_id, '/tags', 'unevaluatedItems', '3' FROM evaluated_records
          WHERE event_id % 7 IN (0, 4)
        UNION ALL SELECT event_id, '/tags', 'unevaluatedItems', '1' FROM evaluated_records
          WHERE event_id % 7 = 1
        UNION ALL SELECT event_id, '/tags', 'unevaluatedItems', '2' FROM evaluated_records
          WHERE event_id % 7 = 4"""),
    "s2_meta": """WITH faults(kind, path, "check") AS (VALUES (1, '/type', 'anyOf'),
        (2, '/required', 'uniqueItems'), (3, '/$defs/x~1y/minLength', 'minimum'),
        (4, '/allOf/0/anyOf', 'minItems'), (5, '/dependentRequired/a', 'type'),
        (6, '/items/not/multipleOf', 'exclusiveMinimum'), (7, '/examples', 'type'),
        (7, '/deprecated', 'type'), (8, '/then/unevaluatedItems', 'type'))
        SELECT p_partkey, concat('/properties/part', path) AS path, "check"
        FROM part JOIN faults ON kind = p_partkey % 9 WHERE kind <> 3 OR p_size > 0""",
    "s2_unchecked": _with("bounded_schemas answer_schemas", "", """SELECT schema_name,
        schema_version, 'dependencies' AS unchecked FROM bounded_schemas
        UNION ALL SELECT schema_name, schema_version, '' FROM answer_schemas"""),
    "j1_large_lookup": """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
        o_orderpriority FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey""",
    "e10_failure": _with("requests doc_schemas", OUTCOMES, """, outcome AS (
        SELECT request_id, error_name, error_message FROM finished
        UNION ALL SELECT request_id, error_name, error_message FROM undecoded)
        SELECT *, CASE WHEN error_name IS NULL THEN 'COMPLETED' ELSE 'FAILED' END AS status
        FROM outcome"""),
    "e11_usage": _with("responses", "", """SELECT schema_name, 'text-model' AS model,
        count(*) AS requests,
        CAST(sum(CAST(json_extract(response, '$.usage.prompt_tokens') AS BIGINT)) AS BIGINT)
          AS prompt_tokens,
        CAST(sum(CAST(json_extract(response, '$.usage.completion_tokens') AS BIGINT)) AS BIGINT)
          AS completion_tokens,
        CAST(sum(CAST(json_extract(response, '$.usage.total_tokens') AS BIGINT)) AS BIGINT)
          AS total_tokens,
        max(CAST(json_extract(response, '$.usage.total_tokens') AS BIGINT)) AS largest_request
        FROM responses GROUP BY schema_name"""),
    "e12_route": r"""WITH hits AS (SELECT doc_id,
          CAST(regexp_matches(low, '[a-z0-9]@[a-z0-9.]+') AS INT)
            + CAST(regexp_matches(low, '\([0-9]{3}\) [0-9]{3}-[0-9]{4}') AS INT) AS contact,
          CAST(contains(low, 'license') AS INT) + CAST(regexp_matches(low, 'version [0-9]') AS INT)
            + CAST(contains(low, 'released under') AS INT) + CAST(contains(low, 'cc by') AS INT)
            AS license,
          CAST(regexp_matches(low, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') AS INT) AS network
        FROM (SELECT doc_id, lower(text) AS low FROM documents)),
        best AS (SELECT *, greatest(contact, license, network) AS top FROM hits)
        SELECT doc_id, CAST(top AS BIGINT) AS score, CASE WHEN top = 0 THEN NULL
          WHEN contact = top THEN 'contact_card' WHEN license = top THEN 'license_notice'
          ELSE 'network_log' END AS tool_name FROM best""",
    "e13_tool_args": _with("responses", "", """SELECT request_id,
        json_extract_string(response, '$.choices[0].message.tool_calls[0].function.name')
          AS tool_name,
        CASE WHEN doc_id % 3 = 0 THEN concat('{"doc":', doc_id, ',"lang":null}') END AS record
        FROM responses"""),
    "e3_custom": """SELECT concat('req-', doc_id) AS request_id,
        CASE WHEN doc_id % 10 = 7 THEN 'TimeoutError' END AS error_name,
        CASE WHEN doc_id % 10 <> 7 THEN concat('{"length":', length(text), '}') END AS result,
        CAST(CASE WHEN doc_id % 10 = 7 THEN 1 ELSE doc_id % 3 + 1 END AS BIGINT) AS attempts
        FROM documents""",
    "extract_documents": _with("requests doc_schemas", OUTCOMES, """, outcome AS (
        SELECT request_id, schema_name, error_name, error_message, result FROM finished
        UNION ALL SELECT *, NULL FROM refused UNION ALL SELECT *, NULL FROM undecoded
        UNION ALL SELECT request_id, schema_name, 'SchemaDoesNotExist', 'Schema does not exist.',
          NULL FROM unresolved)
        SELECT request_id, schema_name, error_name,
          CAST(CASE WHEN error_name IS NULL THEN 200 WHEN error_name = 'Error' THEN 500
            ELSE 400 END AS BIGINT) AS status_code,
          CASE WHEN error_name IS NULL THEN concat('{"OK":true,"result":', result, '}')
            ELSE concat('{"OK":false,"error":{"error_name":"', error_name,
              '","error_message":"', error_message, '"}}') END AS reply
        FROM outcome"""),
    "m2_latest_state": _with("states written_results", LATEST,
        f"SELECT request_id, status, {stamp('created_at')} AS created_at FROM latest"),
    "m2_other_states": _with("mixed_states", """ranked AS (SELECT *, row_number() OVER (
          PARTITION BY request_id ORDER BY created_at DESC,
          CASE status WHEN 'QUEUED' THEN 0 WHEN 'RUNNING' THEN 1 WHEN 'FAILED' THEN 2
            WHEN 'COMPLETED' THEN 3 ELSE 4 END DESC) AS nth FROM mixed_states)""",
        f"SELECT request_id, status, {stamp('created_at')} AS created_at "
        "FROM ranked WHERE nth = 1"),
    "m3_get_result": _with("states written_results", LATEST, f"""SELECT l.request_id, l.status,
        {stamp('l.created_at')} AS created_at,
        CASE WHEN l.status = 'COMPLETED' THEN s.result END AS data,
        CASE WHEN l.status = 'FAILED' THEN s.error_name END AS error_name
        FROM latest l LEFT JOIN stored s USING (request_id)"""),
    "m4_result_upsert": _with("states written_results", LATEST, f"""SELECT request_id, result,
        error_name, {stamp('written_at')} AS written_at FROM stored"""),
    "m5_outcomes": _with("outcomes", "", f"""SELECT operation,
        {stamp("date_trunc('day', \"at\")")} AS period, count(*) FILTER (ok) AS success,
        count(*) FILTER (NOT ok) AS failed FROM outcomes GROUP BY 1, 2"""),
    "m6_errors": _with("errors", "", """SELECT error_name, count(*) AS occurrences,
        CAST(CASE WHEN error_name IN ('InvalidData', 'InvalidMimeType', 'ValidationError',
          'RequestDoesNotExist', 'SchemaDoesNotExist', 'SchemaDefinitionTooLarge')
          THEN 400 ELSE 500 END AS BIGINT) AS status_code FROM errors GROUP BY error_name"""),
    "m7_envelope": _with("written_results", "", f"""SELECT request_id,
        {stamp('written_at')} AS written_at,
        CASE WHEN error_name IS NULL
          THEN concat('{{"OK":true,"result":', CAST(json(result) AS VARCHAR), '}}')
          ELSE concat('{{"OK":false,"error":{{"error_name":"', error_name,
            '","error_message":"', error_message, '"}}}}') END AS reply FROM written_results"""),
    "m8_harvest": _with("states written_results asked", LATEST, """SELECT a.request_id,
        CASE WHEN l.status = 'COMPLETED' THEN s.result END AS data,
        CASE WHEN l.status = 'COMPLETED' AND s.result IS NOT NULL THEN NULL
          WHEN l.status IS NULL THEN 'RequestDoesNotExist'
          WHEN l.status = 'FAILED' THEN s.error_name ELSE l.status END AS reason
        FROM asked a LEFT JOIN latest l USING (request_id) LEFT JOIN stored s USING (request_id)"""),
    "m10_status_counts": _with("states written_results", LATEST,
        "SELECT status, count(*) AS requests FROM latest GROUP BY status"),
    "t1_enqueue": _with("requests doc_schemas", PREPARED.replace(
        "string_split(body, chr(10))", "string_split(body, chr(12))"), f"""SELECT request_id,
        CASE WHEN NOT undecodable THEN schema_name END AS schema_name,
        CASE WHEN NOT undecodable THEN schema_version END AS schema_version,
        CASE WHEN NOT undecodable THEN md5(text_data) END AS text_digest,
        CASE WHEN NOT undecodable THEN len(image_list) END AS images,
        CASE WHEN NOT undecodable THEN length(schema_definition) END AS definition_length,
        CASE WHEN NOT undecodable THEN {stamp('created_at')} END AS created_at,
        CASE WHEN undecodable THEN 'FAILED' ELSE 'QUEUED' END AS status FROM prepared"""),
    "t2_run_batch": _with("requests doc_schemas", EXTRACTED, f"""SELECT request_id,
        'RUNNING' AS status, '2024-01-15 00:00:30.000000' AS created_at FROM ({_LIVE})
        UNION ALL SELECT request_id, CASE WHEN broken THEN 'FAILED' ELSE 'COMPLETED' END,
        '2024-01-15 00:00:30.000000' FROM ({_LIVE})"""),
    "t2_results": _with("requests doc_schemas", EXTRACTED, f"""SELECT request_id, schema_name,
        CASE WHEN NOT broken THEN record END AS result,
        CASE WHEN broken THEN 'InvalidData' END AS error_name FROM ({_LIVE})"""),
    "t4_undecodable": """SELECT value, row_number() OVER (PARTITION BY value) AS copy_no
        FROM (SELECT concat('no event ', doc_id % 4) AS value FROM documents
          WHERE doc_id % 25 = 3)""",
    "t6_late_audit": _with("requests doc_schemas", PREPARED, f"""SELECT request_id,
        {stamp('created_at')} AS created_at FROM prepared
        WHERE NOT undecodable AND created_at < TIMESTAMP '2024-01-01 00:00:30'"""),
    "t9_change_feed": _with("requests doc_schemas", EXTRACTED, f"""SELECT request_id,
        CASE WHEN NOT broken THEN record END AS result,
        CASE WHEN broken THEN 'InvalidData' END AS error_name FROM ({_LIVE})"""),
    "t3_groups": _with("deliveries", """named AS (SELECT
        concat(request_id, '#', hour(created_at)) AS request_id, created_at FROM deliveries),
        numbered AS (SELECT request_id,
          row_number() OVER (ORDER BY created_at, request_id) AS row_no FROM named)""",
        "SELECT *, (row_no - 1) // 10 AS invocation FROM numbered"),
    "t5_dedup": _with("deliveries", "", f"""SELECT request_id, any_value(note) AS note,
        {stamp('min(created_at)')} AS created_at, count(*) AS deliveries
        FROM deliveries GROUP BY request_id"""),
    "t3_stream": _with("deliveries", f"""named AS (SELECT
        concat(request_id, '#', hour(created_at)) AS request_id, created_at,
          CASE WHEN created_at < {_STOP_AT} THEN 0::BIGINT ELSE 1::BIGINT END AS batch_id
          FROM deliveries),
        numbered AS (SELECT request_id, batch_id, row_number() OVER (
          PARTITION BY batch_id ORDER BY created_at, request_id) AS row_no FROM named)""",
        "SELECT *, (row_no - 1) // 10 AS invocation FROM numbered"),
    "t5_stream": _with("deliveries", "", "SELECT DISTINCT request_id, note FROM deliveries"),
    "t7_stream": _with("states", """followed AS (SELECT *, lead(created_at) OVER (
          PARTITION BY request_id ORDER BY created_at, CASE status WHEN 'QUEUED' THEN 0
            WHEN 'RUNNING' THEN 1 WHEN 'FAILED' THEN 2 ELSE 3 END) AS later FROM states)""",
        f"""SELECT request_id, {stamp('created_at')} AS running_since FROM followed
        WHERE status = 'RUNNING'
          AND (later IS NULL OR later > created_at + INTERVAL 300 SECOND)"""),
    "t8_stream": _with("states written_results", LATEST, f"""SELECT l.request_id, f.failures,
        {stamp('l.created_at')} AS failed_at
        FROM latest l JOIN (SELECT request_id, count(*) AS failures FROM states
          WHERE status = 'FAILED' GROUP BY request_id) f USING (request_id)
        WHERE l.status = 'FAILED' AND f.failures >= 3"""),
    "t6_expired": _with("deliveries", "", f"""SELECT request_id,
        {stamp('created_at')} AS created_at FROM deliveries
        WHERE created_at < {_ASOF} - INTERVAL 14 DAY"""),
    "t7_stuck": _with("states written_results", LATEST, f"""SELECT request_id,
        {stamp('created_at')} AS running_since FROM latest
        WHERE status = 'RUNNING' AND created_at < {_ASOF} - INTERVAL 300 SECOND"""),
    "t8_dead_letter": _with("states written_results", LATEST, f"""SELECT l.request_id, f.failures,
        {stamp('l.created_at')} AS failed_at
        FROM latest l JOIN (SELECT request_id, count(*) AS failures FROM states
          WHERE status = 'FAILED' GROUP BY request_id) f USING (request_id)
        WHERE l.status = 'FAILED' AND f.failures >= 3"""),
    "t10_quota": _with("calls", "", f"""SELECT api_key,
        {stamp("date_trunc('month', called_at)")} AS month, count(*) AS calls,
        count(*) > 60 AS over_quota FROM calls GROUP BY 1, 2"""),
    "t11_rate": _with("calls", "", f"""SELECT api_key,
        {stamp("date_trunc('hour', called_at)")} AS window_start, count(*) AS calls
        FROM calls GROUP BY 1, 2 HAVING count(*) > 1"""),
    "t11_burst": _with("calls", "", f"""
        , instants AS (SELECT api_key, called_at, epoch_us(called_at) AS at, count(*) AS calls,
          row_number() OVER (PARTITION BY api_key ORDER BY called_at) AS r
          FROM calls GROUP BY api_key, called_at),
        bucket AS (SELECT *, least(2, calls) AS served,
          86400000000 - least(2, calls) * 43200000000 AS tokens FROM instants WHERE r = 1
          UNION ALL SELECT i.*,
          least(least(86400000000, b.tokens + i.at - b.at) // 43200000000, i.calls),
          least(86400000000, b.tokens + i.at - b.at)
            - least(least(86400000000, b.tokens + i.at - b.at) // 43200000000, i.calls) * 43200000000
          FROM bucket b JOIN instants i ON i.api_key = b.api_key AND i.r = b.r + 1)
        SELECT api_key, {stamp("called_at")} AS called_at, calls,
          CAST(calls - served AS BIGINT) AS throttled FROM bucket WHERE served < calls"""),
    "c1_nonblank": _with("typed_messages", "", r"""SELECT conv_id, turn, role, md5(text) AS digest
        FROM typed_messages WHERE role <> 'user' OR regexp_replace(text, '\s', '', 'g') <> ''"""),
    "c2_history": _with("", FOLD,
        "SELECT conv_id, turn, messages, md5(history) AS digest FROM sent"),
    "c2_long_memory": _with("", """history AS (SELECT conv_id, turn, role, text FROM conversations
          WHERE role <> 'system' AND (role <> 'user' OR regexp_replace(text, '\\s', '', 'g') <> ''))""",
        """SELECT u.conv_id, u.turn, count(*) AS messages,
        md5(string_agg(concat(h.role, ':', h.text), '|' ORDER BY h.turn)) AS digest
        FROM history u JOIN history h ON h.conv_id = u.conv_id AND h.turn <= u.turn
        WHERE u.role = 'user' GROUP BY u.conv_id, u.turn"""),
    "c3_messages": _with("", FOLD, """SELECT conv_id, turn, messages + 1 AS messages,
        md5(concat('system:Build a schema.|', history)) AS digest FROM sent"""),
    "c4_chunks": """SELECT conv_id, turn, md5(text) AS digest, CAST(3 AS BIGINT) AS pieces
        FROM conversations WHERE role = 'assistant'""",
    "c5_latest_result": """SELECT conv_id, max(turn) AS turn, md5(arg_max(text, turn)) AS digest
        FROM conversations WHERE role = 'assistant' GROUP BY conv_id""",
    "c6_snapshot": _with("", f"""{FOLD},
        ends AS (SELECT conv_id, max(r) AS r FROM ranked GROUP BY conv_id),
        kept AS (SELECT h.* FROM ends e JOIN fold f ON f.conv_id = e.conv_id AND f.r = e.r
          JOIN ranked h ON h.conv_id = e.conv_id AND h.r > e.r - f.held),
        systems AS (SELECT conv_id, arg_min(text, turn) AS system_message FROM conversations
          WHERE role = 'system' GROUP BY conv_id),
        answers AS (SELECT conv_id, arg_max(text, turn) AS latest, max(turn) AS turn
          FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
        starts AS (SELECT conv_id, min(turn) AS turn FROM conversations GROUP BY conv_id),
        times AS (SELECT s.conv_id, TIMESTAMP '2024-01-01' + to_hours(s.conv_id)
            + to_minutes(s.turn) AS created_at, TIMESTAMP '2024-01-01' + to_hours(s.conv_id)
            + to_minutes(coalesce(a.turn, s.turn)) AS updated_at
          FROM starts s LEFT JOIN answers a USING (conv_id))""",
        f"""SELECT k.conv_id AS thread_id, concat('user-', k.conv_id % 97) AS user_id,
        {stamp('any_value(t.created_at)')} AS created_at,
        {stamp('any_value(t.updated_at)')} AS updated_at,
        'schema-builder' AS agent_name, md5(any_value(s.system_message)) AS system_digest,
        count(*) AS messages,
        md5(string_agg(concat(k.role, ':', k.text), '|' ORDER BY k.r)) AS history_digest,
        md5(any_value(a.latest)) AS result_digest
        FROM kept k LEFT JOIN systems s USING (conv_id) LEFT JOIN answers a USING (conv_id)
        JOIN times t USING (conv_id) GROUP BY k.conv_id"""),
    "c7_schema_from_thread": """SELECT conv_id, concat('thread_', conv_id) AS schema_name,
        concat('{"properties":{"field_', max(turn), '":{"type":["string","null"]}},',
          '"required":["field_', max(turn), '"],"type":"object"}') AS schema_definition,
        'ACTIVE' AS schema_status, CAST(NULL AS VARCHAR) AS error_name
        FROM conversations WHERE role = 'assistant' AND conv_id % 2 = 0 GROUP BY conv_id""",
    "u1_sorted": _with("schema_log", CURRENT, f"""SELECT schema_version AS id,
        row_number() OVER (ORDER BY created_at, schema_name, schema_version) AS row_no,
        {stamp('created_at')} AS created_at FROM current"""),
    "u2_page": """SELECT o_orderkey, (row_no - 1) // 10 + 1 AS page_number,
        (row_no - 1) % 10 + 1 AS position FROM (SELECT o_orderkey,
          row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS row_no FROM orders)""",
    "u3_remove_selected": """SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
        WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
}
ORACLE = {name: sql.replace(") , outcome", "), outcome") for name, sql in ORACLE.items()}

# What all versions of a schema declare of a field, from the rows of s9_fields.
ORACLE["s12_registry"] = f"""SELECT schema_name, path, CASE kinds WHEN 'boolean' THEN 'boolean'
    WHEN 'integer' THEN 'bigint' WHEN 'number' THEN 'decimal(38,9)'
    WHEN 'integer,number' THEN 'decimal(38,9)' WHEN 'string' THEN 'string'
    WHEN 'array' THEN 'array' WHEN 'object' THEN 'struct' ELSE 'variant' END AS kind
  FROM (SELECT schema_name, path, string_agg(DISTINCT one, ',' ORDER BY one) AS kinds
    FROM (SELECT schema_name, path,
        unnest(string_split(coalesce(types, 'any'), ',')) AS one FROM ({ORACLE["s9_fields"]}))
    WHERE one <> 'null' GROUP BY ALL)"""
