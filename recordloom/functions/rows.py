"""Arrays as rows, and one row of many."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def one_row_each(df: DataFrame, array: Column | str, name: str, *kept: str) -> DataFrame:
    """One row per element of ``array``, none for an empty one.

    The outer form with a filter behind it, because in front of a plain
    ``explode`` Spark puts a filter on the array's size and so computes a costly
    array (and everything it is made of) a second time.
    """
    rows = df.select(*kept, F.explode_outer(array).alias(name))
    return rows.filter(F.col(name).isNotNull())


def row_digest(df: DataFrame) -> Column:
    """A number that depends on the content of a row alone, to order ties by."""
    values = []
    for field in df.schema.fields:
        value = F.col(f"`{field.name}`")
        hashable = not isinstance(field.dataType, (T.MapType, T.StructType, T.ArrayType, T.VariantType))
        values.append(value if hashable else F.to_json(F.struct(value)))
    return F.xxhash64(*values)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key, ties by content: the same whatever order the
    rows come in. Spark keeps one row per key and task before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order, row_digest(df))
    return df.withColumn("_nth", F.row_number().over(window)).filter("_nth = 1").drop("_nth")
