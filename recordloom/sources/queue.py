"""The batch queue as JSON text: folders here, a Kafka topic in production
(IO4, IO5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom import model

TIME_FORMAT = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def event_body(prepared: DataFrame) -> DataFrame:
    """IO4: the queue message of each prepared request."""
    body = F.struct(
        "request_id",
        F.struct("schema_name", "schema_version").alias("key"),
        F.struct("schema_definition", "text_data", "image_list").alias("payload"),
        "created_at",
    )
    return prepared.select("request_id", F.to_json(body, TIME_FORMAT).alias("value"))


def send(bodies: DataFrame, path: str) -> None:
    bodies.select("value").write.mode("append").text(path)


def send_kafka(bodies: DataFrame, servers: str, topic: str) -> None:
    """Needs the Kafka connector on the class path."""
    bodies.select(F.col("request_id").alias("key"), "value").write.format("kafka").option(
        "kafka.bootstrap.servers", servers
    ).option("topic", topic).save()


def _decoded(raw: DataFrame) -> DataFrame:
    event = F.from_json("value", model.QUEUE_EVENT, TIME_FORMAT)
    return raw.select("value", event.alias("_e")).select("value", "_e.*")


def receive(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """IO5: the queue as a stream; a body that is no event keeps NULL fields."""
    raw = (
        spark.readStream.schema("value string")
        .option("maxFilesPerTrigger", files_per_trigger)
        .text(path)
    )
    return _decoded(raw)


def receive_kafka(
    spark: SparkSession, servers: str, topic: str, offsets_per_trigger: int = 100_000
) -> DataFrame:
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("maxOffsetsPerTrigger", offsets_per_trigger)
        .load()
    )
    return _decoded(raw.select(F.col("value").cast("string").alias("value")))


def read_all(spark: SparkSession, path: str) -> DataFrame:
    return _decoded(spark.read.text(path))
