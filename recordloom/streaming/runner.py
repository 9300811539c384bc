"""Queue producer and consumer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom import model
from recordloom.functions.joins import lookup_join
from recordloom.functions.jsontree import measured_levels
from recordloom.functions.rows import first_rows
from recordloom.operators import delivery, extraction, intake, prompting, states
from recordloom.operators.registry import KEY
from recordloom.session import materialise, scratch
from recordloom.sources import queue, tables

RETENTION = f"{model.RETENTION_DAYS} days"


def enqueue(requests: DataFrame, schemas: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queue messages, state rows, result rows of requests that failed).

    Requests are prepared once and stored; the three tables are read from there.
    The QUEUED time is the request's own time, before any RUNNING time. A
    request without a schema leaves nothing here (see ``intake.unresolved``).
    """
    checked = intake.valid(intake.check_requests(requests))
    prepared = materialise(intake.prepare(intake.resolve(checked, schemas)), "prepared")
    status = F.when(F.col("error_name").isNull(), model.QUEUED).otherwise(model.FAILED)
    return (
        queue.event_body(intake.valid(prepared)),
        states.state_rows(prepared, status, F.col("created_at")),
        extraction.failures(intake.invalid(prepared)),
    )


def first_of_each(events: DataFrame) -> DataFrame:
    """T5 on a stream: an event redelivered within the retention period after its
    first arrival is dropped.

    The watermark runs on arrival, so no event comes too late to be seen; whether
    it is expired is decided, and recorded, by the batch that gets it. Bodies
    without an id are no copies of each other: all are kept.
    """
    return (
        events.withColumn("_once", F.coalesce(F.col("request_id"), F.expr("uuid()")))
        .withColumn("_arrived", F.current_timestamp())
        .withWatermark("_arrived", RETENTION)
        .dropDuplicatesWithinWatermark(["_once"])
        .drop("_once", "_arrived")
    )


def run_events(events: DataFrame, extractor: extraction.Extractor) -> DataFrame:
    """E1-E10 for a batch of events: result rows, failures included (T4).

    Every event carries the definition it was accepted with; the distinct ones of
    the batch are compiled, so a schema registered after the stream began is known
    and a deleted one still is. An event without a readable definition fails.
    """
    flat = events.select(
        "request_id",
        "key.schema_name",
        "key.schema_version",
        "payload.schema_definition",
        "payload.text_data",
        "payload.image_list",
        "created_at",
    )
    definition = F.try_parse_json("schema_definition")
    readable = F.coalesce(F.schema_of_variant(definition).startswith("OBJECT"), F.lit(False))
    # By the definition alone: a name or version may be missing, and no join meets a null.
    name, version = KEY
    flat = flat.withColumn("_definition", F.sha2("schema_definition", 256))
    schemas = flat.filter(readable).select(
        F.col("_definition").alias(name), F.lit("").alias(version), "schema_definition"
    )
    schemas = materialise(schemas.distinct(), "batch-schemas")
    levels = measured_levels(schemas)
    compiled = materialise(extraction.compile_schemas(schemas, levels), "compiled")
    compiled = compiled.drop(version, "schema_definition").withColumnRenamed(name, "_definition")
    prepared = lookup_join(
        flat.filter(readable), compiled, ["_definition"], "inner", spread_by=("request_id",)
    ).drop("_definition")
    flat = flat.drop("_definition")
    results = extraction.assemble(
        extraction.extract(prompting.with_prompt(prepared), extractor, levels)
    )
    name, message = model.SCHEMA_DOES_NOT_EXIST
    lost = flat.filter(~readable).withColumns(
        {"error_name": F.lit(name), "error_message": F.lit(message)}
    )
    return extraction.all_results(results, extraction.failures(lost))


def batch_runner(
    out: str, extractor: extraction.Extractor, now: Column | None = None
) -> Callable[[DataFrame, int], None]:
    """What happens to one micro-batch.

    Undecodable bodies and expired events (T6) are kept in tables of their own.
    Every other event gets a RUNNING row, a result, and a final state that is
    derived from the stored result: the extractor is not asked twice. Rows carry
    the batch id, by which readers drop what a replay wrote again.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        clock = now if now is not None else F.current_timestamp().cast("timestamp_ntz")
        (moment,) = spark.range(1).select(clock.alias("at")).first()
        clock = F.lit(moment).cast("timestamp_ntz")
        day = F.to_date(clock)
        good = F.col("request_id").isNotNull() & F.col("key.schema_name").isNotNull()
        batch = batch.persist()
        try:
            if batch.isEmpty():  # a batch that only moves the watermark
                return
            with scratch(spark):
                copies = Window.partitionBy("value").orderBy("value")
                undecodable = batch.filter(~good).select(
                    "value", F.row_number().over(copies).alias("copy_no")
                )
                tables.append_batch(undecodable, f"{out}/undecodable", batch_id, day)
                expired = F.coalesce(
                    F.col("created_at") < clock - F.make_dt_interval(F.lit(model.RETENTION_DAYS)),
                    F.lit(False),
                )
                late = batch.filter(good & expired).select("request_id", "created_at", "value")
                tables.append_batch(late, f"{out}/expired", batch_id, day)
                events = batch.filter(good & ~expired)
                running = states.state_rows(events, model.RUNNING, clock)
                tables.append_batch(running, f"{out}/running", batch_id, day)
                results = run_events(events, extractor).withColumn("written_at", clock)
                tables.append_batch(results, f"{out}/results", batch_id, day)
            stored = spark.read.parquet(f"{out}/results").filter(
                (F.col("day") == day) & (F.col("batch_id") == batch_id)
            )
            done = states.state_rows(stored, extraction.final_status(), F.col("written_at"))
            tables.append_batch(done.distinct(), f"{out}/finished", batch_id, day)
        finally:
            batch.unpersist()

    return run


def run_queue(
    events: DataFrame,
    out: str,
    checkpoint: str,
    extractor: extraction.Extractor,
    now: Column | None = None,
    available_now: bool = True,
):
    """Consume the queue until it is empty (or for ever)."""
    spark = events.sparkSession
    for name in ("running", "finished"):
        tables.create(spark, f"{out}/{name}", _BATCH_STATE)
    writer = (
        first_of_each(events)
        .writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(batch_runner(out, extractor, now))
    )
    writer = (
        writer.trigger(availableNow=True)
        if available_now
        else writer.trigger(processingTime="5 seconds")
    )
    return writer.start()


_BATCH_STATE = T.StructType([*model.STATE_ROW.fields, T.StructField("batch_id", T.LongType())])
_STORED_STATE = T.StructType([*_BATCH_STATE.fields, T.StructField("day", T.DateType())])


def read_run_states(spark: SparkSession, out: str) -> DataFrame:
    """The state rows of all batches, each once."""
    rows = [spark.read.schema(_STORED_STATE).parquet(f"{out}/{n}") for n in ("running", "finished")]
    return tables.once(rows[0].unionByName(rows[1]), ["request_id", "status"])


def read_results(spark: SparkSession, out: str) -> DataFrame:
    """The result rows of all batches, each once."""
    return tables.once(
        spark.read.parquet(f"{out}/results"), ["request_id"], [F.col("written_at")]
    )


def change_feed(spark: SparkSession, out: str, schema) -> DataFrame:
    """Every newly written result row, as a stream. ``schema`` is that of the
    stored table. A batch that is replayed does not show twice."""
    return (
        spark.readStream.schema(schema)
        .parquet(f"{out}/results")
        .withColumn("_arrived", F.current_timestamp())
        .withWatermark("_arrived", RETENTION)
        .dropDuplicatesWithinWatermark(["request_id", "batch_id"])
        .drop("_arrived")
    )


def stuck_stream(
    transitions: DataFrame,
    seconds: int = model.VISIBILITY_TIMEOUT_SECONDS,
    lateness: str = "10 minutes",
) -> DataFrame:
    """T7 on a stream of state rows (request_id, status, created_at as a
    timestamp): a request for every RUNNING row that nothing followed within
    ``seconds``, whatever batches the rows come in.

    Transitions of a request at most ``seconds`` apart are one session, of which the
    newest status is kept; sessions are merged in each task before the shuffle, so a
    request with very many transitions is a few rows there. A session ends when the
    watermark has passed it: ``lateness`` is how long after newer rows a transition
    may still arrive and count.
    """
    newest = F.max(F.struct(F.col("created_at").alias("at"), states.status_rank().alias("rank")))
    return (
        transitions.withWatermark("created_at", lateness)
        .groupBy("request_id", F.session_window("created_at", f"{seconds} seconds"))
        .agg(newest.alias("_newest"))
        .filter(F.col("_newest.rank") == model.STATUS_RANK[model.RUNNING])
        .select("request_id", F.col("_newest.at").alias("running_since"))
    )


def invocation_runner(
    out: str, size: int = model.QUEUE_BATCH_SIZE
) -> Callable[[DataFrame, int], None]:
    """T3 on the stream: the events of a micro-batch in invocations of at most
    ``size``, in order of time, id and body, however many a file holds.

    A batch that is replayed has the files it had before, so its rows get the same
    invocations; it is found again by its id (see ``read_invocations``). Bodies that
    are no events come first.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("request_id", "created_at", "value")
        with scratch(spark):
            groups = delivery.invocations(rows, size, ("created_at", "request_id", "value"))
            day = F.to_date(F.current_timestamp())
            tables.append_batch(groups, f"{out}/invocations", batch_id, day)

    return run


def run_invocations(
    events: DataFrame, out: str, checkpoint: str, size: int = model.QUEUE_BATCH_SIZE
):
    """Store the invocations of all that is in the queue."""
    writer = events.writeStream.option("checkpointLocation", checkpoint)
    return writer.foreachBatch(invocation_runner(out, size)).trigger(availableNow=True).start()


def read_invocations(spark: SparkSession, out: str) -> DataFrame:
    """Events with ``batch_id`` and ``invocation``, each once: a batch that was
    replayed on another day has its numbers there, too."""
    rows = spark.read.parquet(f"{out}/invocations").drop("day")
    return first_rows(rows, ["batch_id", "row_no"], [])
