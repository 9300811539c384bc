"""Key lookups that neither broadcast an unchecked side nor stall on a hot key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.session import materialise

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 32
HOT_ROWS = 100_000


def fits_broadcast(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Measure ``df`` with one partial aggregate: a row per task meets in the end,
    not the rows counted."""
    widths = []
    for field in df.schema.fields:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            widths.append(F.coalesce(F.octet_length(value), F.lit(0)))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            widths.append(F.coalesce(F.octet_length(F.to_json(F.struct(value))), F.lit(0)))
    width = sum(widths, F.lit(8 * len(df.columns)))
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    spread_by: Sequence[str] = (),
    max_rows: int = BROADCAST_ROWS,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join a large ``left`` with a ``right`` that holds each key once.

    The right side is stored first, so that measuring it does not compute it
    twice. Measured to be small it is broadcast and the left side never moves.
    Beyond that bound both sides are shuffled on (key, salt) and merged: Spark would
    go by the size of the stored files and broadcast them after all. A left key that
    owns very many rows is spread over ``SALTS`` tasks by ``spread_by``, columns outside
    the key, and only the right rows of such keys are copied as often.
    Without ``spread_by`` the left side is expected to hold each key once, too.
    """
    on = list(on)
    if set(spread_by) & set(on):
        raise ValueError("a salt from the key itself splits nothing")
    right = materialise(right, "lookup")
    if fits_broadcast(right, max_rows, max_bytes):
        return left.join(F.broadcast(right), on, how)
    if not spread_by:
        return left.join(right.hint("merge"), on, how)
    hot = _hot_keys(left, on)
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread_by), F.lit(SALTS))).otherwise(0)
    last = F.when(F.col("_hot"), SALTS - 1).otherwise(0)
    salted = _marked(left, hot, on).withColumn("_salt", salt.cast("int")).drop("_hot")
    copies = _marked(right, hot, on).withColumn("_salt", F.explode(F.sequence(F.lit(0), last)))
    return salted.join(copies.drop("_hot").hint("merge"), [*on, "_salt"], how).drop("_salt")


def _hot_keys(left: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys that own more than ``HOT_ROWS`` rows: at most one for so many rows."""
    counts = left.groupBy(*on).agg(F.count("*").alias("_rows"))
    hot = counts.filter(F.col("_rows") > HOT_ROWS)
    return hot.select(*[F.col(c).alias(f"_hot_{c}") for c in on], F.lit(True).alias("_hot"))


def _marked(df: DataFrame, hot: DataFrame, on: Sequence[str]) -> DataFrame:
    same = [df[c].eqNullSafe(hot[f"_hot_{c}"]) for c in on]
    marked = df.join(F.broadcast(hot), same, "left")
    return marked.drop(*[f"_hot_{c}" for c in on])
