"""Model requests and model responses as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom import model

SYSTEM_MESSAGE = (
    "You extract structured data from documents. Read the text, the page images or both, and "
    "answer with exactly one JSON object that satisfies the given JSON schema. The description "
    "of the schema and of every field tells you what to look for and how to write it down."
)
USER_MESSAGE = "Extract one record.\n\nSchema:\n%s\n\nDocument text:\n%s\n"

CONTENT_PART = "array<struct<type:string,text:string,url:string>>"
MESSAGES = f"array<struct<role:string,content:{CONTENT_PART}>>"

RESPONSE = (
    "choices array<struct<message:struct<content:string,"
    "tool_calls:array<struct<function:struct<name:string,arguments:string>>>>>>,"
    "usage struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>"
)


def _part(kind: str, text: Column, url: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), text.alias("text"), url.alias("url"))


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.cast(CONTENT_PART).alias("content"))


def messages(system_message: str = SYSTEM_MESSAGE, user_message: str = USER_MESSAGE) -> Column:
    """The system message, then schema and document, then one part per image."""
    no_text = F.lit(None).cast("string")
    body = F.format_string(user_message, F.col("schema_definition"), F.col("text_data"))
    pictures = F.transform(
        F.coalesce(F.col("image_list"), F.array().cast("array<string>")),
        lambda key: _part("image_url", no_text, key),
    )
    first = F.array(_part("text", body, no_text)).cast(CONTENT_PART)
    system = F.array(_part("text", F.lit(system_message), no_text))
    return F.array(
        _message("system", system),
        _message("user", F.concat(first, pictures.cast(CONTENT_PART))),
    ).cast(MESSAGES)


def model_name(
    text_model: str = model.TEXT_MODEL, vision_model: str = model.VISION_MODEL
) -> Column:
    """The vision model if and only if there are images."""
    return F.when(F.size("image_list") > 0, vision_model).otherwise(text_model)


def with_prompt(
    prepared: DataFrame,
    system_message: str = SYSTEM_MESSAGE,
    user_message: str = USER_MESSAGE,
    text_model: str = model.TEXT_MODEL,
    vision_model: str = model.VISION_MODEL,
) -> DataFrame:
    """E1 and E2 on prepared requests."""
    return prepared.withColumns(
        {
            "messages": messages(system_message, user_message),
            "model": model_name(text_model, vision_model),
        }
    )


def feedback(content: Column, error: Column) -> Column:
    """What is appended before the model is asked again."""
    no_text = F.lit(None).cast("string")
    request = F.concat(F.lit("That answer was rejected, correct it. Reason: "), error)
    return F.array(
        _message("assistant", F.array(_part("text", content, no_text))),
        _message("user", F.array(_part("text", request, no_text))),
    ).cast(MESSAGES)


def unwrap(responses: DataFrame, column: str = "response") -> DataFrame:
    """Content, tool arguments and usage of a model response."""
    answer = F.from_json(column, RESPONSE)
    first = F.get(F.col("_answer.choices"), F.lit(0))["message"]
    call = F.get(first["tool_calls"], F.lit(0))["function"]
    return (
        responses.withColumn("_answer", answer)
        .withColumns(
            {
                "content": first["content"],
                "tool_name": call["name"],
                "tool_arguments": call["arguments"],
                "usage": F.col("_answer.usage"),
            }
        )
        .drop("_answer")
    )
