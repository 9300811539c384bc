"""Document sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom import model
from recordloom.functions.text import base64_text


def spread(scan: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """Use all cores on a table just read that came in fewer splits than there
    are cores. A large table has more splits than that and is left alone, unless
    ``rows`` says how many a task should have at most: narrow rows come by the million
    in one split, however many splits there are."""
    wanted = scan.sparkSession.sparkContext.defaultParallelism
    count = scan.count() if rows else 0
    if rows and count > rows:
        return scan.repartition(max(wanted, -(-count // rows)), *keys)
    if scan.rdd.getNumPartitions() >= wanted:
        return scan
    return scan.repartition(wanted, *keys)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Each text file is one document, its content passed on as it is."""
    files = spark.read.text(path, wholetext=True)
    return files.select(
        F.col("_metadata.file_path").alias("document_id"),
        F.col("value").alias("content"),
        F.lit(model.TEXT_MIME).alias("mime_type"),
    )


def text_file_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """D1 as a stream of newly arriving files."""
    return (
        spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
        .text(path, wholetext=True)
        .select(
            F.col("_metadata.file_path").alias("document_id"),
            F.col("value").alias("content"),
            F.lit(model.TEXT_MIME).alias("mime_type"),
        )
    )


def text_table(table: DataFrame, key: str, column: str) -> DataFrame:
    """D1 for documents that are already rows of a table."""
    return table.select(
        F.col(key).cast("string").alias("document_id"),
        F.col(column).alias("content"),
        F.lit(model.TEXT_MIME).alias("mime_type"),
    )


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files as base64 text, the form in which requests carry media."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(
        F.col("path").alias("document_id"), base64_text(F.col("content")).alias("content"), "length"
    )


def encoded(table: DataFrame, column: str) -> DataFrame:
    """D2 for bytes or text held in a table."""
    return table.withColumn("content", base64_text(F.col(column).cast("binary")))
