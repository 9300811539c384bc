from __future__ import annotations

import json

from pyspark.sql import functions as F

from recordloom import model
from recordloom.operators import extraction, prompting

KEY = ("rental_offer", "v" * 10)
SCHEMA = {
    "type": "object",
    "properties": {
        "contact_phone": {"type": ["string", "null"], "description": "Phone of the writer"},
        "monthly_rent": {
            "type": "object",
            "properties": {
                "amount": {"type": ["number", "null"], "description": "Amount of the rent"},
                "terms": {"type": ["string", "null"]},
            },
            "required": ["amount", "terms"],
        },
        "issued": {"type": ["string", "null"], "format": "date", "description": "Issue date"},
        "tags": {"type": "array", "items": {"type": "string"}},
    },
    "required": ["contact_phone", "monthly_rent", "issued"],
    "additionalProperties": False,
}
LETTER = """The ﬂat on the second ﬂoor is free. Its rent is $1,280.75,
as oﬀered on 2021-06-03. Ring 1-555-010-2277 before noon."""


def schemas(spark, definition=SCHEMA):
    return spark.createDataFrame(
        [(*KEY, json.dumps(definition))],
        "schema_name string, schema_version string, schema_definition string",
    )


def prepared(spark, texts, definition=SCHEMA, images=()):
    rows = [(f"r{i}", *KEY, text, list(images)) for i, text in enumerate(texts)]
    df = spark.createDataFrame(
        rows,
        "request_id string, schema_name string, schema_version string, text_data string, "
        "image_list array<string>",
    )
    compiled = extraction.compile_schemas(schemas(spark, definition), 3)
    return prompting.with_prompt(extraction.attach_schemas(df, compiled))


def test_rules_fill_a_nested_record(spark):
    judged = extraction.extract(prepared(spark, [LETTER, ""]), extraction.RuleExtractor(), 3)
    rows = {r.request_id: r for r in extraction.assemble(judged).collect()}
    assert json.loads(rows["r0"].result) == {
        "contact_phone": "555-010-2277",
        "monthly_rent": {"amount": 1280.75, "terms": None},
        "issued": "2021-06-03",
        "tags": [],
    }
    assert json.loads(rows["r1"].result)["monthly_rent"] == {"amount": None, "terms": None}
    assert rows["r0"].error is None
    assert rows["r0"].request.seed == 43 and rows["r0"].request.max_tokens == 4096


def test_ligatures_are_spelled_out(spark):
    df = spark.createDataFrame([("conﬁrm ofﬁce",), ("plain",)], "t string")
    found = [r[0] for r in df.select(extraction.readable(F.col("t"))).collect()]
    assert found == ["confirm office", "plain"]


def test_vision_model_only_with_images(spark):
    df = prepared(spark, ["x"], images=["k1", "k2"]).withColumn(
        "model", prompting.model_name("t", "v")
    )
    row = df.select("model", "messages").first()
    assert row.model == "v"
    assert [part.type for part in row.messages[1].content] == ["text", "image_url", "image_url"]
    assert prepared(spark, ["x"]).select(prompting.model_name("t", "v")).first()[0] == "t"


class FakeClient:
    """Valid at the attempt named in the document; "fail" raises."""

    def complete(self, messages, model, seed, temperature, max_tokens):
        text = messages[1]["content"][0]["text"]
        attempt = sum(1 for m in messages if m["role"] == "assistant") + 1
        if "fail" in text:
            raise TimeoutError("model is away")
        wanted = int(text.split("attempt=")[1].split()[0])
        answers = ["no json", '{"n": "wrong type"}', '{"n": 1, "x": 2}']
        content = '```json\n{"n": 5}\n```' if attempt >= wanted else answers[attempt - 1]
        return {
            "choices": [{"message": {"content": content}}],
            "usage": {"prompt_tokens": 1, "completion_tokens": attempt, "total_tokens": 1 + attempt},
        }


NUMBER = {
    "type": "object",
    "properties": {"n": {"type": "integer"}},
    "required": ["n"],
    "additionalProperties": False,
}


def test_custom_extractor_retries_and_reports(spark):
    texts = [f"attempt={k} " for k in (1, 2, 3, 4)] + ["fail"]
    df = prepared(spark, texts, NUMBER)
    compiled = extraction.compile_schemas(schemas(spark, NUMBER), 2)
    client = extraction.PartitionExtractor(FakeClient, partitions=2)
    judged = extraction.extract(df, client, 2, compiled=compiled)
    rows = {r.request_id: r for r in judged.collect()}
    assert {k: r.attempt for k, r in rows.items()} == {"r0": 1, "r1": 2, "r2": 3, "r3": 3, "r4": 1}
    assert [rows[f"r{i}"].result for i in range(3)] == ['{"n":5}'] * 3
    assert rows["r3"].error_name == "InvalidData"
    assert [(v.check, v.detail) for v in rows["r3"].violations] == [("extra", "x")]
    assert (rows["r4"].error_name, rows["r4"].error_message) == ("TimeoutError", "model is away")
    assert [len(rows[f"r{i}"].messages) for i in range(4)] == [2, 4, 6, 6]
    assert "n" in rows["r2"].messages[5].content[0].text
    assert rows["r2"].usage.completion_tokens == 3


def test_answers_come_back_to_repeated_and_missing_ids(spark):
    ids = ["a", "a", "a", None, "b"]
    df = prepared(spark, [f"attempt={1 + k % 2} {k}" for k in range(5)], NUMBER)
    place = F.regexp_extract("request_id", "([0-9]+)", 1).cast("int")
    named = F.element_at(F.array(*[F.lit(x) for x in ids]), place + 1)
    df = df.withColumn("request_id", named)
    compiled = extraction.compile_schemas(schemas(spark, NUMBER), 2)
    judged = extraction.extract(df, extraction.PartitionExtractor(FakeClient, partitions=2), 2, compiled=compiled)
    rows = judged.collect()
    assert sorted(str(r.request_id) for r in rows) == sorted(map(str, ids))
    assert all(r.result == '{"n":5}' for r in rows)
    assert sorted(r.attempt for r in rows) == [1, 1, 1, 2, 2]


def test_results_and_failures_share_one_table(spark):
    judged = extraction.extract(
        prepared(spark, ["attempt=1 ", "fail"], NUMBER), extraction.PartitionExtractor(FakeClient), 2
    )
    early = extraction.failures(
        spark.createDataFrame(
            [("r9", *KEY, *model.SCHEMA_DOES_NOT_EXIST)],
            "request_id string, schema_name string, schema_version string, error_name string, "
            "error_message string",
        )
    )
    results = extraction.all_results(extraction.assemble(judged), early)
    found = {r.request_id: (r.s, r.error and r.error.error_name) for r in results.select(
        "request_id", extraction.final_status().alias("s"), "error").collect()}
    assert found == {
        "r0": ("COMPLETED", None),
        "r1": ("FAILED", "TimeoutError"),
        "r9": ("FAILED", "SchemaDoesNotExist"),
    }
    (usage,) = extraction.usage_rollup(results.filter("error IS NULL")).collect()
    assert (usage.requests, usage.total_tokens) == (1, 2)


def test_routing(spark):
    texts = [
        "Invoice 7: amount due 12.00, bill to ACME",
        "She is currently employed and earns an annual salary",
        "nothing to see",
        "receipt and invoice",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = [r.tool_name for r in extraction.route(df).collect()]
    assert found == ["invoice", "employment_letter", None, "invoice"]


def test_unwrap_tool_call(spark):
    response = {
        "choices": [
            {
                "message": {
                    "content": None,
                    "tool_calls": [{"function": {"name": "get_x_data", "arguments": '{"a":1}'}}],
                }
            }
        ],
        "usage": {"prompt_tokens": 3, "completion_tokens": 4, "total_tokens": 7},
    }
    df = spark.createDataFrame([(json.dumps(response),), ("{}",)], "response string")
    first, second = prompting.unwrap(df).collect()
    assert (first.tool_name, first.tool_arguments) == ("get_x_data", '{"a":1}')
    assert first.usage.total_tokens == 7
    assert second.content is None and second.usage is None
