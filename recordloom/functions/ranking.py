"""Row numbers that hold up when one group owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.session import materialise

_ROW_BITS = 33  # monotonically_increasing_id keeps the row index in the low 33 bits
GROUP_BLOCK = 10_000


def number_rows(df: DataFrame, order: Sequence[Column | str], name: str = "row_no") -> DataFrame:
    """Number all rows 1..n in ``order`` (which must be total) without a
    single-task window.

    The range sort is stored once, so partition and position of a row are
    facts on disk; each partition then only needs the number of rows before it.
    """
    placed = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    stored = materialise(placed, "numbered")
    part = F.shiftright("_at", _ROW_BITS)
    counts = stored.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per task of the sort: bounded by the partition count, not the data.
    offsets = counts.select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    )
    within = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        stored.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + within + 1)
        .drop("_at", "_part", "_before")
    )


def rank_in_group(
    df: DataFrame, group: str, seq: str, name: str = "rank_no", block: int = GROUP_BLOCK
) -> DataFrame:
    """Rank rows 1..n by the integer ``seq`` inside each ``group``; (group, seq)
    must be unique.

    Rows are shuffled on (group, seq block), so a group of any size is split
    into tasks of at most ``block`` rows; only per-block counts meet per group.
    """
    blocked = df.withColumn("_block", F.expr(f"{seq} div {block}"))
    counts = blocked.groupBy(group, "_block").agg(F.count("*").alias("_rows"))
    earlier = (
        Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select(
        group, "_block", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(group, "_block").orderBy(seq)
    return (
        blocked.withColumn("_in", F.row_number().over(inside))
        .join(offsets, [group, "_block"])
        .withColumn(name, F.col("_before") + F.col("_in"))
        .drop("_block", "_before", "_in")
    )
