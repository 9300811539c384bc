"""Calls refused by a rate with bursts (T11): a bucket of tokens for every key.

A bucket holds ``burst`` tokens at most and gets ``rate`` of them every ``seconds``;
a call takes one or is refused. What a bucket holds depends on every earlier call of
its key, so a key's calls are cut into blocks of time: each block becomes a function
from the tokens before it to those after it, the functions of a key are composed, one
narrow row a block, and every block is then walked from its own start. No task walks
all calls of a key.

Tokens are counted in whole units: microseconds bring ``rate`` units each, and a token
has as many units as a bucket gets in ``seconds`` at rate one. Nothing is rounded.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom import model
from recordloom.session import materialise

BLOCK_SECONDS = 3_600
MICROS = 1_000_000
_BLOCK = ("api_key", "_block")

#: Where a piece starts, 1 if it follows the tokens before the block (0 if they do not
#: matter any more), and what is added to them.
Piece = tuple[int, int, int]


def taken(tokens: int, calls: int, cost: int) -> int:
    """Units that ``calls`` calls at one instant take out of a bucket."""
    return min(tokens // cost, calls) * cost


def after_calls(pieces: list[Piece], gain: int, calls: int, cost: int, full: int) -> list[Piece]:
    """The function ``pieces``, followed by a refill of ``gain`` units and by calls.

    A token more or less in a bucket shifts nothing but whole tokens, so the borders
    are those of the remainders: at most one more for each instant and token.
    """
    out: list[Piece] = []

    def put(start: int, slope: int, added: int) -> None:
        if not out or out[-1][1:] != (slope, added):
            out.append((start, slope, added))

    for i, (start, slope, added) in enumerate(pieces):
        end = pieces[i + 1][0] if i + 1 < len(pieces) else full + 1
        if not slope:
            left = min(full, added + gain)
            put(start, 0, left - taken(left, calls, cost))
            continue
        shift = added + gain
        # Below ``brim`` the bucket is not full after the refill.
        brim = min(end, max(start, full - shift))
        at = start
        while at < brim:
            spent = taken(at + shift, calls, cost)
            last = spent == calls * cost
            upto = brim if last else min(brim, spent + cost - shift)
            put(at, 1, shift - spent)
            at = upto
        if brim < end:
            put(brim, 0, full - taken(full, calls, cost))
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _block_functions(rate: int, cost: int, full: int):
    """Map (api_key, _block, at, calls), sorted, to a function for every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row():
            starts, slopes, added = zip(*pieces, strict=True)
            return pa.RecordBatch.from_pylist([{
                "api_key": name[0], "_block": name[1], "first": first, "last": last,
                "starts": starts, "slopes": slopes, "added": added,
            }], schema)

        whole = pa.list_(pa.int64())
        schema = pa.schema([
            ("api_key", pa.string()), ("_block", pa.int64()), ("first", pa.int64()),
            ("last", pa.int64()), ("starts", whole), ("slopes", whole), ("added", whole),
        ])
        name, first, last, pieces = None, 0, 0, []
        for each in _rows(batches):
            if (each["api_key"], each["_block"]) != name:
                if name is not None:
                    yield row()
                name, first = (each["api_key"], each["_block"]), each["at"]
                last, pieces = first, [(0, 1, 0)]
            gain = (each["at"] - last) * rate
            pieces = after_calls(pieces, gain, each["calls"], cost, full)
            last = each["at"]
        if name is not None:
            yield row()

    return run


def _composed(rate: int, full: int):
    """Map the functions of every key's blocks, in order, to the tokens in its bucket
    when a block's first call comes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, tokens, last = None, full, 0
        for batch in batches:
            before = []
            for each in batch.to_pylist():
                if each["api_key"] != name:
                    name, tokens, last = each["api_key"], full, each["first"]
                tokens = min(full, tokens + (each["first"] - last) * rate)
                before.append(tokens)
                piece = bisect_right(each["starts"], tokens) - 1
                tokens = each["slopes"][piece] * tokens + each["added"][piece]
                last = each["last"]
            yield pa.RecordBatch.from_arrays(
                [batch.column("api_key"), batch.column("_block"), pa.array(before, pa.int64())],
                ["api_key", "_block", "before"],
            )

    return run


def _walked(rate: int, cost: int, full: int):
    """Map (api_key, _block, at, calls, before), sorted, to the instants at which calls
    were refused, and how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("api_key", pa.string()), ("at", pa.int64()), ("calls", pa.int64()), ("throttled", pa.int64()),
        ])
        name, tokens, last = None, 0, 0
        for batch in batches:
            rows = []
            for each in batch.to_pylist():
                if (each["api_key"], each["_block"]) != name:
                    name = (each["api_key"], each["_block"])
                    tokens, last = each["before"], each["at"]
                tokens = min(full, tokens + (each["at"] - last) * rate)
                spent = taken(tokens, each["calls"], cost)
                tokens, last = tokens - spent, each["at"]
                if refused := each["calls"] - spent // cost:
                    rows.append({"api_key": each["api_key"], "at": last, "calls": each["calls"], "throttled": refused})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def burst_breaches(
    calls: DataFrame,
    rate: int = model.RATE_PER_SECOND,
    burst: int = model.BURST_LIMIT,
    seconds: int = 1,
    block_seconds: int = BLOCK_SECONDS,
) -> DataFrame:
    """Instants at which calls of a key were refused: api_key, called_at, calls
    (made at that instant) and throttled (how many of them found no token).

    A bucket is full before the first call of its key. Calls at one instant share what
    is there; refused calls take nothing. Calls without a key or a time are left out.
    Calls at one instant are counted before anything is shuffled.
    """
    cost, full = seconds * MICROS, burst * seconds * MICROS
    at = F.unix_micros(F.col("called_at").cast("timestamp"))
    instants = (
        calls.filter("api_key IS NOT NULL AND called_at IS NOT NULL")
        .select(F.col("api_key").cast("string").alias("api_key"), at.alias("at"))
        .groupBy("api_key", "at").agg(F.count("*").alias("calls"))
        .withColumn("_block", F.expr(f"at div {block_seconds * MICROS}"))
    )
    instants = materialise(instants.select("api_key", "_block", "at", "calls"), "instants")

    def in_blocks(frame: DataFrame) -> DataFrame:
        return frame.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK, "at")

    functions = in_blocks(instants).mapInArrow(
        _block_functions(rate, cost, full),
        "api_key string, _block bigint, first bigint, last bigint, "
        "starts array<bigint>, slopes array<bigint>, added array<bigint>",
    )
    starts = (
        functions.repartition("api_key").sortWithinPartitions(*_BLOCK)
        .mapInArrow(_composed(rate, full), "api_key string, _block bigint, before bigint")
    )
    refused = in_blocks(instants.join(starts, list(_BLOCK))).mapInArrow(
        _walked(rate, cost, full), "api_key string, at bigint, calls bigint, throttled bigint"
    )
    kind = calls.schema["called_at"].dataType
    when = F.timestamp_micros("at").cast(kind)
    return refused.select("api_key", when.alias("called_at"), "calls", "throttled")
