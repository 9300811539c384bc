"""Queue behaviour over stored events: batch size, redelivery, expiry, stuck
and dead requests, quota and rate (T3, T5-T8, T10, T11)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom import model
from recordloom.functions.ranking import number_rows
from recordloom.functions.rows import first_rows
from recordloom.operators.states import (
    code_status,
    code_time,
    latest_states,
    transition_code,
)


def _moment(asof: datetime | Column) -> Column:
    return asof if isinstance(asof, Column) else F.lit(asof).cast("timestamp_ntz")


def invocations(
    events: DataFrame,
    size: int = model.QUEUE_BATCH_SIZE,
    order: tuple[str, ...] = ("created_at", "request_id"),
) -> DataFrame:
    """Number events in ``order`` and cut them into groups of ``size``."""
    numbered = number_rows(events, order)
    return numbered.withColumn(
        "invocation", F.floor((F.col("row_no") - 1) / size).cast("long")
    )


def first_deliveries(events: DataFrame) -> DataFrame:
    """T5: the earliest delivery of each request, ties by content, and how often it
    was delivered. Copies of a hot request are merged before the shuffle, and both
    sides of the join are hashed on the request already."""
    counts = events.groupBy("request_id").agg(F.count("*").alias("deliveries"))
    return first_rows(events, ["request_id"], [F.col("created_at")]).join(counts, "request_id")


def expired(events: DataFrame, asof: datetime | Column, days: int = model.RETENTION_DAYS):
    """Events older than the retention period at ``asof``."""
    return events.filter(F.col("created_at") < _moment(asof) - F.make_dt_interval(F.lit(days)))


def retained(events: DataFrame, asof: datetime | Column, days: int = model.RETENTION_DAYS):
    return events.filter(F.col("created_at") >= _moment(asof) - F.make_dt_interval(F.lit(days)))


def stuck(
    states: DataFrame,
    asof: datetime | Column,
    seconds: int = model.VISIBILITY_TIMEOUT_SECONDS,
) -> DataFrame:
    """Requests RUNNING for more than ``seconds`` become deliverable again."""
    limit = _moment(asof) - F.make_dt_interval(secs=F.lit(seconds))
    return latest_states(states).filter(
        (F.col("status") == model.RUNNING) & (F.col("created_at") < limit)
    )


def dead_letters(states: DataFrame, failures: int = model.ATTEMPT_LIMIT) -> DataFrame:
    """Requests that failed ``failures`` times or more and last failed."""
    code = F.col("_code")
    return (
        states.groupBy("request_id")
        .agg(
            F.count_if(F.col("status") == model.FAILED).alias("failures"),
            F.max(transition_code()).alias("_code"),
        )
        .filter((F.col("failures") >= failures) & (code_status(code) == model.FAILED))
        .select("request_id", "failures", code_time(code).alias("failed_at"))
    )


def quota_use(calls: DataFrame, quota: int = model.MONTHLY_QUOTA) -> DataFrame:
    """Calls per key and month, and whether they exceed the quota."""
    return (
        calls.groupBy("api_key", F.date_trunc("month", "called_at").alias("month"))
        .agg(F.count("*").alias("calls"))
        .withColumn("over_quota", F.col("calls") > quota)
    )


def rate_breaches(
    calls: DataFrame, limit: int = model.RATE_PER_SECOND, window: str = "1 second"
) -> DataFrame:
    """Tumbling windows in which a key made more than ``limit`` calls."""
    return (
        calls.groupBy("api_key", F.window("called_at", window).alias("_w"))
        .agg(F.count("*").alias("calls"))
        .filter(F.col("calls") > limit)
        .select("api_key", F.col("_w.start").alias("window_start"), "calls")
    )
