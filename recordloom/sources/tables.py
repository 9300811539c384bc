"""Registry, result and state tables and JSON files (IO1-IO3, IO7, IO8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom import model
from recordloom.functions.rows import first_rows


def append_schemas(rows: DataFrame, path: str) -> None:
    """IO1: append to the registry log; the latest row of a key is its value."""
    rows.select(*model.SCHEMA_ROW.fieldNames()).write.mode("append").parquet(path)


def read_schemas(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(model.SCHEMA_ROW).parquet(path)


def append_results(rows: DataFrame, path: str) -> None:
    """IO2: append; ``states.latest_results`` keeps the last write of a request."""
    rows.withColumn("written_at", F.current_timestamp().cast("timestamp_ntz")).write.mode(
        "append"
    ).parquet(path)


def append_states(rows: DataFrame, path: str) -> None:
    """IO3: the state log, one folder per day so that old days can be skipped."""
    rows.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy(
        "day"
    ).parquet(path)


def read_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*model.STATE_ROW.fieldNames())


def append_batch(rows: DataFrame, path: str, batch_id: int, day: Column) -> None:
    """The rows of one micro-batch, appended to the folder of their day.

    A replayed batch appends its rows again under the same ``batch_id``; readers
    keep one of each (see ``once``), so no folder is needed for every batch.
    """
    rows.withColumns({"batch_id": F.lit(batch_id).cast("bigint"), "day": day}).write.mode(
        "append"
    ).partitionBy("day").parquet(path)


def once(rows: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """One row of each key and batch, whatever was replayed."""
    return first_rows(rows, [*keys, "batch_id"], list(order)).drop("batch_id", "day")


def create(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Make the folder of a table, so that it can be read before its first row."""
    spark.createDataFrame([], schema).write.mode("append").parquet(path)


def write_media(manifest: DataFrame, path: str) -> None:
    """Media objects next to their keys, grouped by content type."""
    manifest.write.mode("append").partitionBy("mime_type").parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    """IO7, IO8: threads, schemas or harvested records as JSON lines."""
    rows.write.mode("overwrite").json(path)
