"""What the operators of this subpackage have in common."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SALTS = 32


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """A column by its exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_text(name: str) -> Column:
    """The text as it is; a missing one counts as empty."""
    return F.coalesce(column(name).cast("string"), F.lit(""))


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """The rows of ``docs`` as one struct ``_row`` beside the columns an operator
    works with, so that no name of theirs can clash with a name of its own.
    ``select("_row.*")`` gives the rows back."""
    row = F.struct(*[column(name) for name in docs.columns]).alias("_row")
    return docs.select(row, *[value.alias(name) for name, value in columns.items()])


def fold(doc_id: str, folds: int) -> Column:
    """The fold of a row: crc32 of the decimal id, modulo ``folds``."""
    return F.pmod(F.crc32(column(doc_id).cast("string")), F.lit(folds))


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    how: str = "left",
    salts: int = SALTS,
) -> DataFrame:
    """Join a ``left`` whose keys may be hot with a narrow ``right`` that holds
    each key once.

    Both sides are shuffled on (key, salt). The salt is taken from columns
    outside the key, so the rows of one key are dealt over ``salts`` tasks.
    """
    salt = F.pmod(F.xxhash64(*[column(c) for c in spread_by]), F.lit(salts)).cast("int")
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", salt).join(copies, [*on, "_salt"], how).drop("_salt")


ROWS_AT_ONCE = 500
SLICE = 100


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python workers in batches of ROWS_AT_ONCE, not of 10 000."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_AT_ONCE))


def slices(batch: pa.RecordBatch, rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """A batch in parts that are small once they are Python objects."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()
