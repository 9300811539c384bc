"""The whole path of a request in one pass over the requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom import model
from recordloom.functions.joins import lookup_join
from recordloom.operators import extraction, intake, prompting, states
from recordloom.operators.registry import KEY


def ready_or_failed(
    requests: DataFrame,
    compiled: DataFrame,
    splitter: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """D4, D9, D10, D11 for every request: the prepared row, or its first error.

    One scan and one lookup; a request that fails stays a row and goes on
    without being worked on, instead of being collected by a second scan.
    """
    refused = {"error_name": "_refused", "error_message": "_reason"}
    checked = intake.check_requests(requests).withColumnsRenamed(refused)
    known = compiled.withColumn("_known", F.lit(True))
    joined = lookup_join(checked, known, KEY, "left", spread_by=("request_id",))
    # Only a request with a schema is prepared, so that failure comes last.
    no_schema = F.col("_known").isNull()
    first = F.col("_refused").isNotNull()
    name, message = model.SCHEMA_DOES_NOT_EXIST
    return (
        intake.prepare(joined, splitter)
        .withColumns(
            {
                "error_name": F.when(first, F.col("_refused"))
                .when(no_schema, name)
                .otherwise(F.col("error_name")),
                "error_message": F.when(first, F.col("_reason"))
                .when(no_schema, message)
                .otherwise(F.col("error_message")),
            }
        )
        .drop("_refused", "_reason", "_known")
    )


def answer_all(
    requests: DataFrame,
    compiled: DataFrame,
    levels: int,
    splitter: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Judged rows of all requests with the built-in rule extractor."""
    failed = {"error_name": "_failed", "error_message": "_why"}
    ready = ready_or_failed(requests, compiled, splitter).withColumnsRenamed(failed)
    # A failed row asks for no kind of field, so its text is not searched.
    going = ready.withColumns(
        {
            "template": F.when(F.col("_failed").isNull(), F.col("template")),
            "attempt": F.lit(1),
        }
    )
    answered = extraction.RuleExtractor().answer(prompting.with_prompt(going))
    answered = answered.withColumns(
        {"call_error": F.col("_failed"), "call_message": F.col("_why")}
    )
    return extraction.judge(answered, levels).drop("_failed", "_why")


def replies(judged: DataFrame) -> DataFrame:
    """M6, M7: the status code and JSON reply each request gets."""
    name, message = F.col("error_name"), F.col("error_message")
    return judged.select(
        "request_id",
        *KEY,
        "error_name",
        states.status_code("error_name").alias("status_code"),
        states.envelope(F.col("result"), name, message).alias("reply"),
    )
