"""Sorting, paging and removal for table views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom import model
from recordloom.functions.joins import lookup_join
from recordloom.functions.ranking import number_rows


def with_row_id(schemas: DataFrame) -> DataFrame:
    """U4: the version is the row id of a listed schema."""
    return schemas.withColumn("id", F.col("schema_version"))


def sorted_by_creation(
    rows: DataFrame, created_at: str, ties: Sequence[str], descending: bool = False
) -> DataFrame:
    """A range-partitioned sort; ``ties`` make the order total, which also
    splits rows that share one creation time over several tasks."""
    first = F.col(created_at).desc() if descending else F.col(created_at).asc()
    return rows.orderBy(first, *ties)


def page(
    rows: DataFrame, order: Sequence[str], number: int = 1, size: int = model.TABLE_PAGE_SIZE
) -> DataFrame:
    """One page."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def pages(rows: DataFrame, order: Sequence[str], size: int = model.TABLE_PAGE_SIZE) -> DataFrame:
    """U2 for all pages: add ``page_number`` and the position on the page."""
    numbered = number_rows(rows, order)
    index = F.col("row_no") - 1
    return numbered.withColumn("page_number", F.floor(index / size).cast("long") + 1).withColumn(
        "position", F.pmod(index, F.lit(size)) + 1
    )


def remove_selected(rows: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    """Drop the selected rows; ``key`` is their row id (U4), so it is unique."""
    return lookup_join(rows, selected.select(key).distinct(), [key], "left_anti")
