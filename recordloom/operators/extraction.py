"""Extraction: rule templates, custom extractors, judging, retries, results.

The path of a request is: prepared request -> answer (one text) -> judged
answer -> result row. A custom extractor and judging run in Python workers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom import model
from recordloom.functions import jsontree, rules, text
from recordloom.functions.joins import lookup_join
from recordloom.operators import prompting
from recordloom.operators.registry import KEY
from recordloom.session import materialise

_OPEN, _CLOSE = "\ue000", "\ue001"  # private-use marks no rule pattern can match


@dataclass(frozen=True)
class FieldRule:
    """How fields of one kind are found in a text.

    ``cue`` is matched against the lower-case name, format and description of a
    field: the description is the instruction. Patterns stay within the regular
    expressions every engine shares (no look-around, no back-references).
    """

    kind: str
    cue: str
    pattern: str
    group: int = 0
    number: bool = False

    @property
    def mark(self) -> str:
        return f"{_OPEN}{self.kind}{_CLOSE}"


FIELD_RULES = (
    FieldRule("email", r"e-?mail", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]+"),
    FieldRule("ipv4", r"\bip\b|ipv4|ip address", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"),
    FieldRule("phone", r"phone|telephone", r"\(?[0-9]{3}\)?[ -][0-9]{3}-[0-9]{4}"),
    FieldRule("date", r"\bdate\b", r"[0-9]{4}-[0-9]{2}-[0-9]{2}"),
    FieldRule(
        "amount",
        r"amount|salary|price|total",
        r"\$ ?([0-9][0-9,]*(?:\.[0-9]+)?)",
        group=1,
        number=True,
    ),
    FieldRule("count", r"number of|count|how many", r"[0-9]+", number=True),
)


def quoted(value: Column) -> Column:
    """A string as JSON text."""
    return F.to_json(value.cast("variant"))


def _mark(field_rules: Sequence[FieldRule]) -> str:
    """Placeholder of the first rule whose cue and type fit the field ``n``."""
    types = f"coalesce({jsontree.types('n.v')}, array('string'))"
    hints = """lower(concat_ws(' ', replace(n.name, '_', ' '),
        try_variant_get(n.v, '$.format', 'string'),
        try_variant_get(n.v, '$.description', 'string')))"""
    numeric = f"arrays_overlap({types}, array('number', 'integer'))"
    cases = " ".join(
        f"WHEN {numeric if rule.number else f"array_contains({types}, 'string')"} "
        f"AND {hints} rlike r'{rule.cue}' THEN '{rule.mark}'"
        for rule in field_rules
    )
    return f"CASE {cases} WHEN array_contains({types}, 'array') THEN '[]' ELSE 'null' END"


def compile_templates(
    schemas: DataFrame, levels: int, field_rules: Sequence[FieldRule] = FIELD_RULES
) -> DataFrame:
    """Add ``template``: the JSON record of a schema with a mark per rule kind.

    A text is later turned into a record by replacing the few marks, whatever
    the number of schemas and fields. Members are rendered before the objects
    that hold them, one projection per level.
    """
    df = jsontree.with_definition_nodes(
        schemas, "try_parse_json(schema_definition)", levels, "_nodes"
    )
    leaf = _mark(field_rules)
    for depth in range(levels, -1, -1):
        body = leaf
        if depth < levels:
            has_members = f"{jsontree.members('n.v', '$.properties')} IS NOT NULL"
            body = f"""CASE WHEN {has_members} THEN concat('{{', array_join(transform(
                filter(_t{depth + 1},
                    c -> c.parent = n.path AND c.name != '{jsontree.ITEM_STEP}'),
                c -> concat(to_json(cast(c.name AS variant)), ':', c.body)), ','), '}}')
                ELSE {leaf} END"""
        rendered = f"""transform(filter(_nodes, n -> n.depth = {depth}), n -> named_struct(
            'parent', regexp_replace(n.path, '/[^/]*$', ''), 'name', n.name, 'body', {body}))"""
        df = df.withColumn(f"_t{depth}", F.expr(rendered))
    return df.select(*schemas.columns, F.expr("get(_t0, 0).body").alias("template"))


def fill_template(
    template: Column, content: Column, field_rules: Sequence[FieldRule] = FIELD_RULES
) -> Column:
    """First match of every rule a template asks for."""
    out = template
    for rule in field_rules:
        match = F.nullif(F.regexp_extract(content, rule.pattern, rule.group), F.lit(""))
        # JSON numbers have no thousands separators and no leading zeros.
        digits = F.regexp_replace(F.replace(match, F.lit(","), F.lit("")), "^0+([0-9])", "$1")
        value = F.coalesce(digits if rule.number else quoted(match), F.lit("null"))
        # The text is only searched when the schema asks for this kind.
        wanted = F.when(template.contains(rule.mark), value).otherwise("")
        out = F.replace(out, F.lit(rule.mark), wanted)
    return out


def readable(content: Column) -> Column:
    """Text with ligatures spelled out; most texts have none and pass through."""
    signs = "".join(text.LIGATURES)
    return F.when(content.rlike(f"[{signs}]"), text.expand_ligatures(content)).otherwise(content)


class Extractor(Protocol):
    """Answers prepared requests.

    ``answer`` adds content (text of the answer), usage (struct of token
    counts), call_error (name) and call_message; it sees the column ``attempt``.
    """

    def answer(self, requests: DataFrame) -> DataFrame: ...


_USAGE = "struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>"


class RuleExtractor:
    """E3 built in: regular-expression rules compiled to columns."""

    def __init__(self, field_rules: Sequence[FieldRule] = FIELD_RULES):
        self.field_rules = tuple(field_rules)

    def answer(self, requests: DataFrame) -> DataFrame:
        df = requests.withColumn("_text", readable(F.col("text_data")))
        content = fill_template(F.col("template"), F.col("_text"), self.field_rules)
        none = F.lit(None)
        return df.withColumns(
            {
                "content": content,
                "usage": none.cast(_USAGE),
                "call_error": none.cast("string"),
                "call_message": none.cast("string"),
            }
        ).drop("_text")


class Client(Protocol):
    def complete(
        self, messages: list[dict], model: str, seed: int, temperature: float, max_tokens: int
    ) -> dict:
        """Chat completion response as a dictionary (choices, usage)."""


class PartitionExtractor:
    """E3 custom: a model client opened once per partition.

    Only a row number, model and prompt travel to Python, in Arrow batches; up to
    ``in_flight`` calls of a task are under way at a time, so the client has to
    bear threads. A failing call becomes data of its own row and is not retried.
    Requests are stored with a number of their own, by which the answers come back:
    request ids may repeat or be missing. The responses are stored, so that no lost
    executor asks a model twice for what is there.
    """

    def __init__(
        self,
        open_client: Callable[[], Client],
        partitions: int | None = None,
        in_flight: int = 8,
    ):
        self.open_client = open_client
        self.partitions = partitions
        self.in_flight = in_flight

    def answer(self, requests: DataFrame) -> DataFrame:
        open_client, in_flight = self.open_client, self.in_flight

        def run(batches: Iterator) -> Iterator:
            import json
            from concurrent.futures import ThreadPoolExecutor

            import pyarrow as pa

            client = None

            def ask(name: str, prompt: str) -> tuple[str | None, str | None, str | None]:
                try:
                    response = client.complete(
                        messages=json.loads(prompt),
                        model=name,
                        seed=model.SEED,
                        temperature=model.TEMPERATURE,
                        max_tokens=model.MAX_OUTPUT_TOKENS,
                    )
                    return json.dumps(response), None, None
                except Exception as failure:
                    return None, type(failure).__name__, str(failure)

            with ThreadPoolExecutor(in_flight) as calls:
                for batch in batches:
                    client = client or open_client()
                    names, prompts = (batch.column(c).to_pylist() for c in ("model", "_prompt"))
                    answers = list(calls.map(ask, names, prompts))
                    columns = zip(*answers, strict=True) if answers else ([], [], [])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("_no"), *(pa.array(c, pa.string()) for c in columns)],
                        ["_no", "response", "call_error", "call_message"],
                    )

        numbered = requests.withColumn("_no", F.monotonically_increasing_id())
        numbered = materialise(numbered, "asked")
        asked = numbered.select("_no", "model", F.to_json("messages").alias("_prompt"))
        if self.partitions:
            asked = asked.repartition(self.partitions)
        responses = asked.mapInArrow(
            run, "_no bigint, response string, call_error string, call_message string"
        )
        answered = numbered.join(materialise(responses, "responses"), "_no", "left")
        return prompting.unwrap(answered).drop("_no", "response", "tool_name", "tool_arguments")


def judge(answers: DataFrame, levels: int) -> DataFrame:
    """Parse each answer and check it against the rules in its row.

    Adds result, violations, error_name and error_message; an answer that is
    not one JSON object is a decode error, a record that breaks its schema is
    invalid data.
    """
    df = answers.withColumn("_span", text.json_span(F.trim("content")))
    df = df.withColumn("_record", text.parse_object(F.col("_span"))).drop("_span")
    df = rules.with_violations(df, "_record", levels)
    decode_name, decode_message = model.JSON_DECODE_ERROR
    data_name, data_message = model.INVALID_DATA
    called = F.col("call_error").isNull()
    parsed = F.col("_record").isNotNull()
    broken = F.size("violations") > 0
    return (
        df.withColumns(
            {
                "error_name": F.when(~called, F.col("call_error"))
                .when(~parsed, decode_name)
                .when(broken, data_name),
                "error_message": F.when(~called, F.col("call_message"))
                .when(~parsed, decode_message)
                .when(broken, data_message),
                "violations": F.when(parsed, F.col("violations")),
            }
        )
        .withColumn("result", F.when(F.col("error_name").isNull(), F.to_json("_record")))
        .drop("_record")
    )


def violation_text() -> Column:
    return F.array_join(
        F.transform(
            F.col("violations"),
            lambda x: F.concat(x["path"], F.lit(" "), x["check"], F.lit(": "), x["detail"]),
        ),
        "; ",
    )


def compile_schemas(
    schemas: DataFrame,
    levels: int,
    field_rules: Sequence[FieldRule] = FIELD_RULES,
    with_templates: bool = True,
) -> DataFrame:
    """Everything extraction needs to know about each schema version, one row
    per version: definition, rules and (for the rule extractor) template."""
    base = schemas.select(*KEY, "schema_definition")
    if with_templates:
        base = compile_templates(base, levels, field_rules)
    kept = tuple(base.columns)
    return rules.compile_rules(base, levels, kept)


def attach_schemas(requests: DataFrame, compiled: DataFrame) -> DataFrame:
    return lookup_join(requests, compiled, KEY, "inner", spread_by=("request_id",))


# What extraction takes from the schema and can look up again.
_FROM_SCHEMA = ("rules", "template", "schema_definition")


def extract(
    prepared: DataFrame,
    extractor: Extractor,
    levels: int,
    attempts: int = model.ATTEMPT_LIMIT,
    compiled: DataFrame | None = None,
) -> DataFrame:
    """Answer, judge, and ask again about rejected answers only.

    ``prepared`` carries rules (and template) of its schema. The number of
    rounds is fixed by ``attempts``; a round is stored before it is split, so a
    row is asked once per round. With ``compiled`` the stored rows leave the
    schema columns out and rejected rows look them up again. The rule extractor
    gives the same answer every time, so it never needs a second round.
    """
    pending = prepared.withColumn("attempt", F.lit(1))
    if isinstance(extractor, RuleExtractor):
        return judge(extractor.answer(pending), levels)
    columns = pending.columns
    left_out = [c for c in _FROM_SCHEMA if compiled is not None and c in columns]
    finished: list[DataFrame] = []
    for attempt in range(1, attempts + 1):
        judged = judge(extractor.answer(pending), levels).drop(*left_out)
        judged = materialise(judged, "attempt")
        last = attempt == attempts
        final = F.col("error_name").isNull() | F.col("call_error").isNotNull() | F.lit(last)
        finished.append(judged.filter(final))
        if last:
            break
        rejected = judged.filter(~final)
        if rejected.isEmpty():
            break
        if left_out:
            rejected = attach_schemas(rejected, compiled.select(*KEY, *left_out))
        reason = F.concat_ws(" ", "error_message", violation_text())
        pending = (
            rejected.withColumn(
                "messages", F.concat("messages", prompting.feedback(F.col("content"), reason))
            )
            .withColumn("attempt", F.lit(attempt + 1))
            .select(*columns)
        )
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    return out


def assemble(judged: DataFrame) -> DataFrame:
    """Result rows, success and failure in one projection."""
    ok = F.col("error_name").isNull()
    request = F.struct(
        "model",
        "messages",
        F.lit(model.SEED).alias("seed"),
        F.lit(model.TEMPERATURE).alias("temperature"),
        F.lit(model.MAX_OUTPUT_TOKENS).alias("max_tokens"),
    )
    images = F.map_from_entries(
        F.transform(
            # A caller's list may name an object twice; a map holds it once.
            F.array_distinct(F.coalesce("image_list", F.array().cast("array<string>"))),
            lambda key: F.struct(key.alias("key"), key.alias("value")),
        )
    )
    return judged.select(
        "request_id",
        *KEY,
        F.when(ok, request).alias("request"),
        F.when(ok, images).alias("images"),
        "result",
        F.when(ok, F.col("usage")).alias("metadata"),
        F.when(~ok, F.struct("error_name", "error_message")).alias("error"),
        "attempt",
        "violations",
    )


def failures(rows: DataFrame) -> DataFrame:
    """Result rows of requests that failed before extraction."""
    return rows.select(
        "request_id", *KEY, F.struct("error_name", "error_message").alias("error")
    )


def all_results(successes: DataFrame, failed: DataFrame) -> DataFrame:
    return successes.unionByName(failed, allowMissingColumns=True)


def final_status() -> Column:
    return F.when(F.col("error").isNull(), model.COMPLETED).otherwise(model.FAILED)


def usage_rollup(results: DataFrame) -> DataFrame:
    """Token usage per schema and model; partial aggregation first, so a
    dominant schema is reduced before the shuffle."""
    total = F.col("metadata.total_tokens")
    return results.groupBy("schema_name", F.col("request.model").alias("model")).agg(
        F.count("*").alias("requests"),
        F.sum("metadata.prompt_tokens").alias("prompt_tokens"),
        F.sum("metadata.completion_tokens").alias("completion_tokens"),
        F.sum(total).alias("total_tokens"),
        F.max(total).alias("largest_request"),
        F.percentile_approx(total, 0.5).alias("median_tokens"),
    )


@dataclass(frozen=True)
class Tool:
    """A document type a text can be routed to; cues are regular expressions."""

    name: str
    cues: tuple[str, ...]


# The ten kinds of document (fixed names); the cues are this engine's own.
DOCUMENT_TOOLS = (
    Tool("invoice", ("invoice", "amount due", "bill to")),
    Tool("receipt", ("receipt", "subtotal", "change due")),
    Tool("pay_slip", ("pay ?(slip|stub)", "gross pay", "net pay")),
    Tool("credit_report", ("credit report", "credit score", "inquir(y|ies)")),
    Tool("employment_letter", ("employment", "currently employed", "annual salary")),
    Tool("mortgage_contract", ("mortgage", "lender", "borrower")),
    Tool("bank_statement", ("bank statement", "opening balance", "closing balance")),
    Tool("tax_return", ("tax return", "taxable income", "refund")),
    Tool("salesforce_notes", ("next steps", "follow[- ]up", "opportunity")),
    Tool("call_transcript", ("transcript", "thanks for calling", "speaking")),
)


def route(
    documents: DataFrame, tools: Sequence[Tool] = DOCUMENT_TOOLS, column: str = "text"
) -> DataFrame:
    """The tool with the most cues in the text, ties by name, else NULL.

    Tools are part of the request, any number of them, so they are constants of one
    projection: no pair of document and tool ever becomes a row.
    """
    tools = sorted(tools, key=lambda t: t.name)
    low = F.lower(F.col(column))
    hits = [
        sum((F.when(F.col("_low").rlike(cue), 1).otherwise(0) for cue in tool.cues), F.lit(0))
        for tool in tools
    ]
    scored = documents.withColumn("_low", low).withColumn("_hits", F.array(*hits))
    best = F.array_max("_hits")
    names = F.array(*[F.lit(tool.name) for tool in tools])
    return (
        scored.withColumn("score", best)
        .withColumn(
            "tool_name",
            F.when(best > 0, F.get(names, F.array_position("_hits", best).cast("int") - 1)),
        )
        .drop("_low", "_hits")
    )
