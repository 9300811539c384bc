"""Dead letters of a running queue (T8): failures are counted in keyed state that a
timer clears."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from recordloom import model
from recordloom.functions.rows import first_rows
from recordloom.operators.states import status_rank

_DAY_MILLIS = 24 * 60 * 60 * 1000
LETTERS = "request_id string, failures bigint, failed_at_micros bigint, dead boolean, seen bigint"


class FailureCount(StatefulProcessor):
    """Per request: how many transitions were seen, how many of them were failures,
    and the newest one. Four numbers, whatever a request has been through; its rows
    are read one by one.

    A letter is given out when a request becomes dead, changes while it is dead, or
    comes alive again. The counts go when nothing was heard of the request for the
    retention period.
    """

    def __init__(self, failures: int, retention_days: int) -> None:
        self.failures = failures
        self.kept_millis = retention_days * _DAY_MILLIS
        self.failed = model.STATUS_RANK[model.FAILED]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState(
            "counts", "seen bigint, failures bigint, micros bigint, rank int"
        )

    def _due(self, micros: int) -> int:
        return micros // 1000 + 1 + self.kept_millis

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = tuple(self.counts.get()) if self.counts.exists() else None
        seen, failures, *newest = before or (0, 0, -(2**62), -1)
        newest = tuple(newest)
        for row in rows:
            seen += 1
            failures += row.rank == self.failed
            newest = max(newest, (row.micros, row.rank))
        if before is not None:
            self.handle.deleteTimer(self._due(before[2]))
        self.counts.update((seen, failures, *newest))
        self.handle.registerTimer(self._due(newest[0]))
        was_dead = before is not None and self._dead(before[1], before[3])
        dead = self._dead(failures, newest[1])
        if dead or was_dead:
            yield Row(
                request_id=key[0],
                failures=failures,
                failed_at_micros=newest[0] if dead else None,
                dead=dead,
                seen=seen,
            )

    def _dead(self, failures: int, rank: int) -> bool:
        return failures >= self.failures and rank == self.failed

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.counts.clear()
        yield from ()

    def close(self) -> None:
        pass


def dead_letter_stream(
    transitions: DataFrame,
    failures: int = model.ATTEMPT_LIMIT,
    retention_days: int = model.RETENTION_DAYS,
    lateness: str = "10 minutes",
) -> DataFrame:
    """T8 on a stream of state rows (request_id, status, created_at as a timestamp):
    a letter whenever a request is found dead, as soon as its batch is done, and one
    that takes it back when a later transition is no failure.

    Rows without a time are in no order and are left out; a status outside the four
    counts as no failure and, at equal times, as the newest. Transitions without an
    id are one request. Needs the RocksDB state store (``session.configure``).
    """
    return (
        transitions.filter(F.col("created_at").isNotNull())
        .withWatermark("created_at", lateness)
        .select(
            "request_id",
            "created_at",
            F.unix_micros("created_at").alias("micros"),
            status_rank().alias("rank"),
        )
        .groupBy("request_id")
        .transformWithState(FailureCount(failures, retention_days), LETTERS, "Append", "EventTime")
    )


def current_letters(letters: DataFrame) -> DataFrame:
    """The requests that are dead by the newest letter of each: of letters stored by a
    stream, or by a stream that wrote some twice."""
    order = [F.col("seen").desc()]
    newest = first_rows(letters, ["request_id"], order).filter("dead")
    failed_at = F.timestamp_micros("failed_at_micros").cast("timestamp_ntz")
    return newest.select("request_id", "failures", failed_at.alias("failed_at"))
