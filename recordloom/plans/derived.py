"""Requests, registries, states and answers derived from the given tables.

Every view is one SQL text that Spark and DuckDB both read; ``TS0``, ``B64(x)``
and a few names are spelled per dialect. All of them grow with their table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from recordloom.session import configure
from recordloom.sources.documents import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# --- definitions used by the derived registries -----------------------------

_EN = (
    '{"type":"object","description":"Contact data found in a document","properties":{'
    '"email":{"type":["string","null"],"format":"email","description":"First email address"},'
    '"ip":{"type":["string","null"],"description":"First IP address"},'
    '"phone":{"type":["string","null"],"description":"First phone number"}},'
    '"required":["email","ip","phone"],"additionalProperties":false}'
)
_FR = (
    '{"type":"object","description":"Contact data, nested","properties":{'
    '"contact":{"type":"object","properties":{'
    '"email":{"type":["string","null"],"format":"email"},'
    '"phone":{"type":["string","null"],"description":"First phone number"}},'
    '"required":["email","phone"]},'
    '"ip":{"type":["string","null"],"description":"First IP address"}},'
    '"required":["contact","ip"]}'
)
_DE = (
    '{"type":"object","description":"A count that must be there","properties":{'
    '"digits":{"type":"integer","description":"Number of something"},'
    '"email":{"type":["string","null"],"format":"email"}},'
    '"required":["digits"],"additionalProperties":false}'
)
_ANSWER = (
    '{"type":"object","properties":{"doc_id":{"type":"integer"},'
    '"lang":{"type":["string","null"],"enum":["de","en","fr"]},'
    '"size":{"type":"object","properties":{"chars":{"type":["number","null"]},'
    '"unit":{"type":"string","enum":["chars","words"]}},'
    '"required":["chars","unit"],"additionalProperties":false},'
    '"tags":{"type":"array","items":{"type":"string"}}},'
    '"required":["doc_id","lang","size"],"additionalProperties":false}'
)

_GOOD_ANSWER = (
    """concat('{"doc_id":', doc_id, ',"lang":"', lang, '","size":{"chars":', n_chars, """
    """',"unit":"chars"},"tags":["', source, '","x"]}')"""
)

VIEWS: dict[str, str] = {}

VIEWS["requests"] = """
SELECT concat('req-', doc_id) AS request_id,
  CASE WHEN doc_id % 41 = 40 THEN 'doc' ELSE concat('doc_', lang) END AS schema_name,
  substr(md5(concat(lang, source)), 1, CASE WHEN doc_id % 43 = 42 THEN 9 ELSE 10 END)
    AS schema_version,
  CASE WHEN doc_id % 47 = 46 THEN ''
    WHEN doc_id % 20 = 10 AND doc_id % 3 = 0 THEN '#not base64#'
    WHEN doc_id % 20 BETWEEN 10 AND 17 THEN B64(text)
    ELSE text END AS content,
  CASE WHEN doc_id % 53 = 52 THEN ''
    WHEN doc_id % 20 = 10 THEN 'application/pdf' WHEN doc_id % 20 = 11 THEN 'image/png'
    WHEN doc_id % 20 = 12 THEN 'image/jpg' WHEN doc_id % 20 = 13 THEN 'image/jpeg'
    WHEN doc_id % 20 = 14 THEN 'image/gif' WHEN doc_id % 20 = 15 THEN 'image/bmp'
    WHEN doc_id % 20 = 16 THEN 'image/tiff' WHEN doc_id % 20 = 17 THEN 'image/webp'
    WHEN doc_id % 20 = 18 THEN 'application/msword' ELSE 'text/plain' END AS mime_type,
  TS0 + doc_id * interval '1' second AS created_at
FROM documents
"""

VIEWS["doc_schemas"] = f"""
SELECT concat('doc_', lang) AS schema_name,
  substr(md5(concat(lang, source)), 1, 10) AS schema_version,
  concat('Fields of documents in ', lang, ' from ', source) AS schema_description,
  CASE WHEN lang = 'en' THEN '{_EN}' WHEN lang = 'fr' THEN '{_FR}' ELSE '{_DE}' END
    AS schema_definition,
  CASE WHEN source = 'src3' THEN 'DELETED' ELSE 'ACTIVE' END AS schema_status
FROM (SELECT DISTINCT lang, source FROM documents WHERE lang <> 'es') AS pairs
"""

VIEWS["answer_schemas"] = f"""
SELECT concat('ans_', lang) AS schema_name,
  substr(md5(concat(lang, source)), 1, 10) AS schema_version,
  '{_ANSWER}' AS schema_definition
FROM (SELECT DISTINCT lang, source FROM documents) AS pairs
"""

VIEWS["answers"] = f"""
SELECT doc_id, concat('req-', doc_id) AS request_id, concat('ans_', lang) AS schema_name,
  substr(md5(concat(lang, source)), 1, 10) AS schema_version,
  CASE doc_id % 16
    WHEN 1 THEN concat('Here it is:', chr(10), '```json', chr(10), {_GOOD_ANSWER}, chr(10), '```')
    WHEN 2 THEN concat('Nothing was found in ', source)
    WHEN 3 THEN concat('{{"doc_id":', doc_id, '}} and {{"doc_id":', doc_id, '}}')
    WHEN 4 THEN concat({_GOOD_ANSWER}, ',', {_GOOD_ANSWER})
    WHEN 5 THEN replace({_GOOD_ANSWER}, '"x"', concat('"a', chr(9), 'b"'))
    WHEN 6 THEN replace({_GOOD_ANSWER}, '{{"doc_id":', '{{"doc_id":"x","doc_id":')
    WHEN 7 THEN replace({_GOOD_ANSWER}, '"chars":', '"chars":NaN,"more":')
    WHEN 8 THEN replace({_GOOD_ANSWER}, '{{"doc_id":', '{{"note":"n","doc_id":')
    WHEN 9 THEN replace({_GOOD_ANSWER}, '"lang":', '"language":')
    WHEN 10 THEN replace({_GOOD_ANSWER}, '{{"doc_id":', '{{"doc_id":true,"was":')
    WHEN 11 THEN replace({_GOOD_ANSWER}, concat('"', lang, '"'), 'null')
    WHEN 12 THEN replace({_GOOD_ANSWER}, ',"unit":"chars"', '')
    WHEN 13 THEN replace({_GOOD_ANSWER}, '"x"]', '7,null]')
    WHEN 14 THEN replace({_GOOD_ANSWER}, '"chars":', '"chars":12345678901234567890.125')
    WHEN 15 THEN replace({_GOOD_ANSWER}, ',"lang"', '.0,"lang"')
    ELSE {_GOOD_ANSWER} END AS content
FROM documents
"""

_BOUNDED = (
    '{"type":"object","properties":{"value":{"type":"number","minimum":2,"exclusiveMaximum":90},'
    '"kind":{"type":"string","minLength":5,"maxLength":6},"tags":{"type":"array","minItems":2,'
    '"maxItems":3,"uniqueItems":true},"unit":{"const":"eur"},"blocked":false,"open":true},'
    '"additionalProperties":{"type":"string","maxLength":3},"pattern":"^x",'
    '"allOf":[{"type":"object"}],"dependencies":{},"required":["value"]}'
)

VIEWS["bounded_schemas"] = f"""
SELECT DISTINCT concat('event_', event_type) AS schema_name, '0123456789' AS schema_version,
  '{_BOUNDED}' AS schema_definition
FROM events
"""

VIEWS["bounded_records"] = """
SELECT event_id, concat('event_', event_type) AS schema_name, '0123456789' AS schema_version,
  concat('{"value":', user_id % 100, ',"kind":"', event_type, '","tags":[',
    CASE event_id % 5 WHEN 0 THEN '1' WHEN 1 THEN '1,2' WHEN 2 THEN '1,1' WHEN 3 THEN '1,2,3'
      ELSE '1,2,3,4' END,
    '],"unit":"', CASE WHEN event_id % 3 = 0 THEN 'usd' ELSE 'eur' END, '"',
    CASE WHEN event_id % 7 = 0 THEN ',"blocked":1' ELSE ',"open":[{"x":1}]' END,
    CASE event_id % 4 WHEN 0 THEN ',"more":5' WHEN 1 THEN ',"more":"long"'
      WHEN 2 THEN ',"more":"ok"' ELSE '' END, '}') AS content
FROM events
"""

# Combinators, a schema that refers to itself, patterns and positions.
_COMBINED = (
    '{"type":"object","$defs":{"node":{"type":"object","required":["value"],"properties":'
    '{"value":{"type":"integer","maximum":80},"child":{"$ref":"#/$defs/node"}}}},'
    '"properties":{"kind":{"oneOf":[{"pattern":"^(click|view)$"},{"minLength":5}]},'
    '"value":{"anyOf":[{"maximum":20},{"minimum":60},{"multipleOf":10}]},'
    '"child":{"$ref":"#/$defs/node"},"tags":{"prefixItems":[{"const":1},{"enum":[1,2]}],'
    '"items":false,"contains":{"const":1},"maxContains":1}},'
    '"patternProperties":{"^x[0-9]$":{"maximum":2}},"additionalProperties":false,'
    '"if":{"properties":{"kind":{"const":"error"}}},'
    '"then":{"properties":{"value":{"not":{"multipleOf":7}}}},'
    '"else":{"propertyNames":{"pattern":"^[a-z0-9]+$"}}}'
)

VIEWS["combined_schemas"] = f"""
SELECT DISTINCT concat('event_', event_type) AS schema_name, '0123456789' AS schema_version,
  '{_COMBINED}' AS schema_definition
FROM events
"""

VIEWS["combined_records"] = """
SELECT event_id, concat('event_', event_type) AS schema_name, '0123456789' AS schema_version,
  event_type AS kind, user_id % 100 AS score,
  concat('{"value":', user_id % 100, ',"kind":"', event_type, '","x1":', event_id % 4, ',"tags":[',
    CASE event_id % 5 WHEN 0 THEN '1' WHEN 1 THEN '1,2' WHEN 2 THEN '1,1' WHEN 3 THEN '1,2,3'
      ELSE '1,2,3,4' END, ']',
    CASE WHEN event_id % 9 = 0 THEN ',"Extra":null' ELSE '' END,
    CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN concat(',"child":{"value":', user_id % 100, '}')
      WHEN 2 THEN concat(',"child":{"value":', user_id % 100, ',"child":{"value":', user_id % 100, '}}')
      ELSE concat(',"child":{"value":', user_id % 100, ',"child":{"value":', user_id % 100,
        ',"child":{"value":"s"}}}') END, '}') AS content
FROM events
"""

# What schemas combined at one value leave over: members for a kind of event, those that
# another member brings along, items beyond the named and the found ones.
_EVALUATED = (
    '{"type":"object","properties":{"kind":true,"tags":{"anyOf":[{"prefixItems":[{"const":1},'
    '{"const":2}]},{"prefixItems":[{"const":1}]}],"contains":{"const":9},"minContains":0,'
    '"unevaluatedItems":{"type":"string"}}},'
    '"if":{"properties":{"kind":{"const":"click"}}},"then":{"properties":{"place":true}},'
    '"else":{"$ref":"#/$defs/amount"},"dependentSchemas":{"ref/no":{"patternProperties":'
    '{"^ref":true}}},"unevaluatedProperties":false,'
    '"$defs":{"amount":{"properties":{"amount":{"type":"integer"}}}}}'
)

VIEWS["evaluated_schemas"] = f"""
SELECT DISTINCT concat('event_', event_type) AS schema_name, '0123456789' AS schema_version,
  '{_EVALUATED}' AS schema_definition
FROM events
"""

VIEWS["evaluated_records"] = """
SELECT event_id, concat('event_', event_type) AS schema_name, '0123456789' AS schema_version,
  event_type AS kind,
  concat('{"kind":"', event_type, '"',
    CASE WHEN event_id % 2 = 0 THEN ',"place":"x"' ELSE '' END,
    CASE WHEN event_id % 3 = 0 THEN concat(',"amount":', user_id) ELSE '' END,
    CASE event_id % 5 WHEN 0 THEN ',"ref/no":1,"refund":2' WHEN 1 THEN ',"refund":2' ELSE '' END,
    ',"tags":[', CASE event_id % 7 WHEN 0 THEN '1,2,9,3' WHEN 1 THEN '1,3' WHEN 2 THEN '1,"a","b"'
      WHEN 3 THEN '1,2,9' WHEN 4 THEN '1,2,3,4' ELSE '' END, ']}') AS content
FROM events
"""

# Definitions that hold or break the published meta-schema, each in a way of its own.
VIEWS["definitions"] = """
SELECT p_partkey, concat('{"title":"', p_partkey, '","properties":{"part":',
  CASE p_partkey % 9
    WHEN 0 THEN concat('{"enum":[', p_size, ',null],"type":["integer","null"]}')
    WHEN 1 THEN '{"type":"text"}'
    WHEN 2 THEN '{"required":["a","a"]}'
    WHEN 3 THEN concat('{"$defs":{"x/y":{"minLength":-', p_size, '}}}')
    WHEN 4 THEN '{"allOf":[{"anyOf":[]}]}'
    WHEN 5 THEN '{"dependentRequired":{"a":"b"}}'
    WHEN 6 THEN '{"items":{"not":{"multipleOf":0}}}'
    WHEN 7 THEN '{"examples":1,"deprecated":"no"}'
    ELSE '{"if":true,"then":{"unevaluatedItems":[]}' END,
  CASE WHEN p_partkey % 9 = 8 THEN '}' ELSE '' END, '}}') AS schema_definition
FROM part
"""

# Model responses around the answers, with token usage.
VIEWS["responses"] = """
SELECT doc_id, request_id, schema_name,
  concat('{"choices":[{"message":{"content":"answer ', doc_id, '"',
    CASE WHEN doc_id % 3 = 0 THEN concat(
      ',"tool_calls":[{"function":{"name":"get_', schema_name,
      '_data","arguments":"{ ', chr(92), '"doc', chr(92), '": ', doc_id, ', ', chr(92), '"lang',
      chr(92), '": null }"}}]') ELSE '' END,
    '}}],"usage":{"prompt_tokens":', doc_id % 500, ',"completion_tokens":', doc_id % 90,
    ',"total_tokens":', doc_id % 500 + doc_id % 90, '}}') AS response
FROM answers
"""

_OBJECT = '{"type":"object","description":"Data of a part","properties":{'

VIEWS["registrations"] = f"""
SELECT p_partkey, p_size,
  CASE WHEN p_partkey % 29 = 28 THEN 'abc'
    ELSE concat(lower(p_type), '_', lower(replace(p_brand, '#', ''))) END AS schema_name,
  CASE WHEN p_partkey % 31 = 30 THEN 'short' ELSE concat('Extracts data of ', p_name) END
    AS schema_description,
  CASE p_partkey % 12
    WHEN 1 THEN concat('{_OBJECT}"', replace(p_name, ' ', '_'),
      '":{{"type":["string","null"],"description":"Name of the part"}},"price":{{"type":"object",',
      '"description":"What it costs","properties":{{"net":{{"type":["number","null"]}},',
      '"currency":{{"type":["string","null"],"enum":["chf","eur","usd"]}}}},',
      '"required":["net","currency"]}}}},"required":["', replace(p_name, ' ', '_'),
      '","price"],"additionalProperties":false}}')
    WHEN 2 THEN '{_OBJECT}"maker":{{"type":["string","null"]}},"contact":{{"type":["string","null"],"format":"email"}},"made":{{"type":["string","null"],"format":"date"}},"grade":{{"type":["null","string"],"enum":["A","B"]}}}},"required":["maker","contact","batch","grade"],"additionalProperties":false}}'
    WHEN 3 THEN concat('{_OBJECT}"tags":{{"type":"array","items":{{"type":"object","properties":{{"size":{{"type":"integer","enum":[', p_size, ',null]}}}}}}}}}},"required":["tags"]}}')
    WHEN 4 THEN '{{"type":"object","properties":{{"a":{{"type":"text"}},"b":{{"type":["string","string"]}}}}}}'
    WHEN 5 THEN '{{"type":"object","properties":{{"a":{{"type":"string"}}}},"required":["a","a"]}}'
    WHEN 6 THEN concat('{{"type":"object","description":"', repeat('many long words here ', 600), '"}}')
    WHEN 7 THEN concat('name and size of ', p_name)
    WHEN 8 THEN '[{{"type":"object"}}]'
    WHEN 9 THEN '{{"type":"object","properties":{{"partName":{{"type":"string"}},"x":{{}}}}}}'
    WHEN 10 THEN '{{"type":"object","title":5,"properties":["a"],"enum":"a"}}'
    WHEN 11 THEN '{_OBJECT}"a":{{"type":"object","properties":{{"b":{{"type":"object","properties":{{"c":{{"type":["boolean","null"]}}}},"required":["c"]}}}}}}}}}}'
    ELSE concat('{_OBJECT}"', replace(p_name, ' ', '_'),
      '": {{"type": ["null", "string"], "description": "Name, or: none"}}}},',
      '"required":["', replace(p_name, ' ', '_'), '"],"additionalProperties":false}}')
    END AS schema_definition,
  TS0 + p_partkey * interval '1' minute AS created_at
FROM part
"""

# Kinds of registrations that are refused: names or descriptions too short, and what
# is no definition. Spark builds the log from the registry's own verdicts instead.
_REFUSED = "p_partkey % 12 IN (4, 5, 6, 7, 8, 10) OR p_partkey % 29 = 28 OR p_partkey % 31 = 30"

VIEWS["schema_log"] = f"""
SELECT schema_name, substr(md5(concat('v', p_partkey)), 1, 10) AS schema_version,
  schema_description, schema_definition, 'ACTIVE' AS schema_status, created_at,
  created_at AS written_at
FROM registrations WHERE NOT ({_REFUSED})
UNION ALL
SELECT schema_name, substr(md5(concat('v', p_partkey)), 1, 10) AS schema_version,
  schema_description, schema_definition, 'DELETED' AS schema_status, created_at,
  created_at + interval '1' day AS written_at
FROM registrations WHERE NOT ({_REFUSED}) AND p_size > 40
"""

VIEWS["schema_keys"] = """
SELECT schema_name, substr(md5(concat('v', p_partkey)), 1, 10) AS schema_version
FROM registrations WHERE p_size > 25
UNION ALL
SELECT schema_name, substr(md5(concat('w', p_partkey)), 1, 10) AS schema_version
FROM registrations WHERE p_size BETWEEN 20 AND 25
"""

VIEWS["states"] = """
SELECT concat('u', user_id) AS request_id,
  CASE event_type WHEN 'signup' THEN 'QUEUED' WHEN 'view' THEN 'RUNNING'
    WHEN 'error' THEN 'FAILED' ELSE 'COMPLETED' END AS status,
  ts AS created_at
FROM events
"""

VIEWS["written_results"] = """
SELECT concat('u', user_id) AS request_id,
  CASE WHEN event_type <> 'error' THEN props END AS result,
  CASE WHEN event_type = 'error' THEN 'InvalidData' END AS error_name,
  CASE WHEN event_type = 'error' THEN 'Data does not match schema' END AS error_message,
  ts AS written_at
FROM events WHERE event_type IN ('click', 'purchase', 'error')
"""

VIEWS["errors"] = """
SELECT event_id,
  CASE event_id % 8 WHEN 0 THEN 'InvalidData' WHEN 1 THEN 'InvalidMimeType'
    WHEN 2 THEN 'ValidationError' WHEN 3 THEN 'RequestDoesNotExist'
    WHEN 4 THEN 'SchemaDoesNotExist' WHEN 5 THEN 'SchemaDefinitionTooLarge'
    WHEN 6 THEN 'JSONDecodeError' ELSE 'SchemaError' END AS error_name
FROM events WHERE event_type = 'error'
"""

VIEWS["outcomes"] = """
SELECT CASE user_id % 3 WHEN 0 THEN 'ExtractData' WHEN 1 THEN 'DeleteSchema'
    ELSE 'ExtractDataBatchRun' END AS operation,
  event_type <> 'error' AS ok, ts AS at
FROM events
"""

VIEWS["deliveries"] = """
SELECT concat('ev', event_id) AS request_id, event_type AS note, ts AS created_at FROM events
UNION ALL
SELECT concat('ev', event_id) AS request_id, event_type AS note,
  ts + interval '1' hour AS created_at
FROM events WHERE event_type IN ('view', 'error')
"""

VIEWS["calls"] = "SELECT concat('key', user_id) AS api_key, ts AS called_at FROM events"

VIEWS["asked"] = "SELECT DISTINCT concat('u', doc_id) AS request_id FROM labels"

# Threads in which some user messages are blank.
VIEWS["typed_messages"] = """
SELECT conv_id, turn, role,
  CASE WHEN role = 'user' AND (conv_id + turn) % 7 = 0
    THEN concat(' ', chr(10), chr(9)) ELSE text END AS text
FROM conversations
"""

# Who writes in a thread, and when.
VIEWS["dated_messages"] = """
SELECT conv_id, turn, role, text, concat('user-', conv_id % 97) AS user_id,
  TS0 + conv_id * interval '1' hour + turn * interval '1' minute AS sent_at
FROM conversations
"""

# A log in which some requests end in a status of another system.
VIEWS["mixed_states"] = """
SELECT request_id, status, created_at FROM states
UNION ALL
SELECT concat('u', user_id) AS request_id, 'CANCELLED' AS status, ts AS created_at
FROM events WHERE event_id % 50 = 0
"""

VIEWS["chunks"] = """
SELECT conv_id, turn, 1 AS seq, substr(text, 1, 40) AS delta FROM conversations
WHERE role = 'assistant'
UNION ALL
SELECT conv_id, turn, 2 AS seq, CAST(NULL AS STRING_) AS delta FROM conversations
WHERE role = 'assistant'
UNION ALL
SELECT conv_id, turn, 3 AS seq, substr(text, 41) AS delta FROM conversations
WHERE role = 'assistant'
"""

# Threads whose assistant answers with a definition every other time.
VIEWS["builder_threads"] = """
SELECT conv_id, turn, role,
  CASE WHEN role = 'assistant' AND conv_id % 2 = 0
    THEN concat('```json', chr(10), '{"type":"object","properties":{"field_', turn,
      '":{"type":["string","null"]}},"required":["field_', turn, '"]}', chr(10), '```')
    ELSE text END AS text
FROM conversations
"""

NEEDS = {
    "requests": ["documents"],
    "doc_schemas": ["documents"],
    "answer_schemas": ["documents"],
    "answers": ["documents"],
    "responses": ["documents", "answers"],
    "bounded_schemas": ["events"],
    "bounded_records": ["events"],
    "combined_schemas": ["events"],
    "combined_records": ["events"],
    "evaluated_schemas": ["events"],
    "evaluated_records": ["events"],
    "definitions": ["part"],
    "registrations": ["part"],
    "schema_log": ["part", "registrations"],
    "schema_keys": ["part", "registrations"],
    "states": ["events"],
    "written_results": ["events"],
    "errors": ["events"],
    "outcomes": ["events"],
    "deliveries": ["events"],
    "calls": ["events"],
    "asked": ["labels"],
    "typed_messages": ["conversations"],
    "dated_messages": ["conversations"],
    "mixed_states": ["events", "states"],
    "chunks": ["conversations"],
    "builder_threads": ["conversations"],
}


_SPARK_BASE64 = r"replace(base64(encode(\1, 'UTF-8')), concat(chr(13), chr(10)), '')"


# Tables whose rows cost much work each, the key that spreads them, and how many a task
# should have at most where rows are narrow.
_HEAVY = {"documents": ("doc_id", None), "part": ("p_partkey", 20_000)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name not in _HEAVY:
        return rows
    key, most = _HEAVY[name]
    return spread(rows, key, rows=most)


def _closure(names: tuple[str, ...]) -> list[str]:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for needed in NEEDS.get(name, []):
            visit(needed)
        order.append(name)

    for name in names:
        visit(name)
    return order


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame."""
    parts = []
    for needed in _closure((name,)):
        if needed in TABLES:
            table(spark, sf_dir, needed).createOrReplaceTempView(needed)
        else:
            body = VIEWS[needed].replace("TS0", "TIMESTAMP_NTZ '2024-01-01 00:00:00'")
            body = re.sub(r"B64\((\w+)\)", _SPARK_BASE64, body)
            parts.append(f"{needed} AS ({body.replace('STRING_', 'STRING')})")
    return spark.sql(f"WITH {', '.join(parts)} SELECT * FROM {name}")


def duck(*names: str) -> str:
    """The same views as common table expressions for DuckDB."""
    parts = []
    for needed in _closure(names):
        if needed not in TABLES:
            body = VIEWS[needed].replace("TS0", "TIMESTAMP '2024-01-01 00:00:00'")
            body = re.sub(r"B64\((\w+)\)", r"to_base64(encode(\1))", body)
            parts.append(f"{needed} AS ({body.replace('STRING_', 'VARCHAR')})")
    return ", ".join(parts)
