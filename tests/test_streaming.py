from __future__ import annotations

import glob
import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from recordloom.operators import extraction, states
from recordloom.session import shared_folder
from recordloom.sources import documents, queue, tables
from recordloom.streaming import dead_letters, runner

NOW = datetime(2024, 1, 1, 13)
KEY = ("contact", "v" * 10)
DEFINITION = {
    "type": "object",
    "properties": {"email": {"type": ["string", "null"], "format": "email"}},
    "required": ["email"],
}
STRICT = {"type": "object", "properties": {"n": {"type": "integer"}}, "required": ["n"]}


def registry(spark):
    return spark.createDataFrame(
        [(*KEY, json.dumps(DEFINITION)), ("strict", KEY[1], json.dumps(STRICT))],
        "schema_name string, schema_version string, schema_definition string",
    )


def send(spark, folder):
    rows = [
        ("r1", *KEY, "mail me: a@b.example", "text/plain"),
        ("r2", *KEY, "no address", "text/plain"),
        ("r3", "strict", KEY[1], "no number", "text/plain"),
        ("r4", "unknown", KEY[1], "x", "text/plain"),
        ("r5", *KEY, "###", "image/png"),
    ]
    df = spark.createDataFrame(
        [(*r, datetime(2024, 1, 1, 12, 0, i)) for i, r in enumerate(rows)],
        "request_id string, schema_name string, schema_version string, content string, "
        "mime_type string, created_at timestamp_ntz",
    )
    bodies, transitions, failed = runner.enqueue(df, registry(spark))
    found = {r.request_id: r.status for r in transitions.collect()}
    assert found == {"r1": "QUEUED", "r2": "QUEUED", "r3": "QUEUED", "r5": "FAILED"}
    assert [r.request_id for r in failed.collect()] == ["r5"]
    queue.send(bodies, folder)
    queue.send(bodies, folder)
    late = bodies.filter("request_id = 'r1'").selectExpr(
        "request_id",
        """replace(replace(value, '2024-01-01', '2023-12-01'), '"r1"', '"old"') as value""",
    )
    bare = bodies.filter("request_id = 'r1'").selectExpr(
        "request_id",
        """to_json(struct('bare' as request_id, struct('contact' as schema_name,
           'v' as schema_version) as key, '2024-01-01T12:00:00.000000' as created_at)) as value""",
    )
    queue.send(late.unionByName(bare), folder)
    for _ in range(3):
        spark.createDataFrame([("not an event",)], "value string").write.mode("append").text(folder)


def run(spark, folder, out, offsets):
    stream = runner.run_queue(
        queue.receive(spark, folder, files_per_trigger=2),
        out,
        offsets,
        extraction.RuleExtractor(),
        now=F.lit(NOW).cast("timestamp_ntz"),
    )
    stream.awaitTermination()
    assert stream.exception() is None


def test_queue_run_redelivery_and_replay(spark, tmp_path):
    folder, out, offsets = (str(tmp_path / n) for n in ("queue", "out", "offsets"))
    send(spark, folder)
    run(spark, folder, out, offsets)
    log = runner.read_run_states(spark, out)
    assert log.groupBy("request_id").count().filter("count != 2").count() == 0
    latest = {r.request_id: r.status for r in states.latest_states(log).collect()}
    assert latest == {"r1": "COMPLETED", "r2": "COMPLETED", "r3": "FAILED", "bare": "FAILED"}
    results = {r.request_id: r for r in runner.read_results(spark, out).collect()}
    assert results["bare"].error.error_name == "SchemaDoesNotExist"
    assert json.loads(results["r1"].result) == {"email": "a@b.example"}
    assert results["r3"].error.error_name == "InvalidData"
    assert spark.read.parquet(f"{out}/undecodable").count() == 3
    assert [r.request_id for r in spark.read.parquet(f"{out}/expired").collect()] == ["old"]
    run(spark, folder, out, offsets)
    assert runner.read_run_states(spark, out).count() == 8

    stored = spark.read.parquet(f"{out}/results")
    feed = runner.change_feed(spark, out, stored.schema).select("request_id", "result")
    target = str(tmp_path / "feed")
    for _ in range(2):
        feed.writeStream.option("checkpointLocation", str(tmp_path / "feed-offsets")).trigger(
            availableNow=True
        ).format("parquet").start(target).awaitTermination()
    assert spark.read.parquet(target).count() == 4


def test_events_without_a_version_get_a_result(spark, tmp_path):
    folder, out, offsets = (str(tmp_path / n) for n in ("queue", "out", "offsets"))
    send(spark, folder)
    stripped = [
        ("null", f'"schema_version":"{KEY[1]}"', '"schema_version":null'),
        ("absent", f'"schema_version":"{KEY[1]}"', '"schema_other":"x"'),
    ]
    bodies = [r.value for r in spark.read.text(folder).collect() if '"r1"' in r.value]
    bodies = [b for b in bodies if "2024-01-01" in b and '"old"' not in b]
    new = [bodies[0].replace('"r1"', f'"{i}"').replace(old, by) for i, old, by in stripped]
    assert all(KEY[1] not in b.replace(" ", "") for b in new)
    spark.createDataFrame([(b,) for b in new], "value string").write.mode("append").text(folder)
    run(spark, folder, out, offsets)
    results = {r.request_id: r for r in runner.read_results(spark, out).collect()}
    latest = states.latest_states(runner.read_run_states(spark, out)).collect()
    assert {r.request_id: r.status for r in latest} == {
        "r1": "COMPLETED", "r2": "COMPLETED", "r3": "FAILED", "bare": "FAILED",
        "null": "COMPLETED", "absent": "COMPLETED",
    }
    for i in ("null", "absent"):
        assert json.loads(results[i].result) == {"email": "a@b.example"}
        assert results[i].schema_name == "contact" and results[i].schema_version is None


def test_an_empty_queue_leaves_readable_tables(spark, tmp_path):
    folder, out, offsets = (str(tmp_path / n) for n in ("queue", "out", "offsets"))
    spark.createDataFrame([], "value string").write.text(folder)
    run(spark, folder, out, offsets)
    assert runner.read_run_states(spark, out).count() == 0


def test_a_replayed_batch_counts_once(spark, tmp_path):
    folder, out = str(tmp_path / "queue"), str(tmp_path / "out")
    send(spark, folder)
    batch = queue.read_all(spark, folder).dropDuplicates(["request_id"])
    handle = runner.batch_runner(
        out,
        extraction.RuleExtractor(),
        now=F.lit(NOW).cast("timestamp_ntz"),
    )
    handle(batch, 7)
    handle(batch, 7)
    assert runner.read_results(spark, out).count() == 4
    assert runner.read_run_states(spark, out).count() == 8
    left = glob.glob(f"{shared_folder(spark)}/recordloom/compiled-*")
    handle(batch, 8)
    assert glob.glob(f"{shared_folder(spark)}/recordloom/compiled-*") == left


def test_stuck_requests_are_reported_by_a_timer(spark, tmp_path):
    source = str(tmp_path / "states")
    columns = "request_id string, status string, created_at timestamp"

    def arrive(*rows):
        spark.createDataFrame(
            [(r, s, datetime(2024, 1, 1, 12, m)) for r, s, m in rows], columns
        ).coalesce(1).write.mode("append").parquet(source)

    def consume():
        stream = runner.stuck_stream(spark.readStream.schema(columns).parquet(source))
        query = (
            stream.writeStream.option("checkpointLocation", str(tmp_path / "offsets"))
            .trigger(availableNow=True)
            .format("parquet")
            .start(str(tmp_path / "stuck"))
        )
        query.awaitTermination()
        assert query.exception() is None

    arrive(("a", "RUNNING", 0), ("b", "RUNNING", 0), ("c", "QUEUED", 0))
    consume()
    arrive(("b", "COMPLETED", 2), ("e", "RUNNING", 2), ("d", "QUEUED", 9))
    consume()
    arrive(("e", "COMPLETED", 4))  # behind newer rows, within the lateness
    consume()
    arrive(("c", "RUNNING", 30))
    consume()
    arrive(("d", "QUEUED", 41))
    consume()
    found = spark.read.parquet(str(tmp_path / "stuck")).collect()
    assert [r.request_id for r in found] == ["a"]
    assert found[0].running_since == datetime(2024, 1, 1, 12, 0)


def test_document_sources(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.txt").write_text("line one\nline two\n")
    (folder / "b.txt").write_text("other")
    texts = {r.content for r in documents.text_files(spark, str(folder)).collect()}
    assert texts == {"line one\nline two\n", "other"}
    encoded = {r.content for r in documents.binary_files(spark, str(folder), "b*").collect()}
    assert encoded == {"b3RoZXI="}
    stream = documents.text_file_stream(spark, str(folder))
    query = (
        stream.writeStream.option("checkpointLocation", str(tmp_path / "o"))
        .trigger(availableNow=True)
        .format("parquet")
        .start(str(tmp_path / "seen"))
    )
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "seen")).count() == 2


def test_table_sinks(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a", "QUEUED", NOW)], "request_id string, status string, created_at timestamp_ntz"
    )
    tables.append_states(rows, str(tmp_path / "states"))
    tables.append_states(rows, str(tmp_path / "states"))
    assert tables.read_states(spark, str(tmp_path / "states")).count() == 2
    result = spark.createDataFrame([("a", '{"n":1}')], "request_id string, result string")
    tables.append_results(result, str(tmp_path / "results"))
    latest = states.latest_results(spark.read.parquet(str(tmp_path / "results")))
    assert latest.first().result == '{"n":1}'
    tables.write_json(result, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first().request_id == "a"


def consume(spark, make, schema, source, offsets, target):
    stream = make(spark.readStream.schema(schema).parquet(source))
    writer = stream.writeStream.option("checkpointLocation", offsets).trigger(availableNow=True)
    query = writer.format("parquet").start(target)
    query.awaitTermination()
    assert query.exception() is None
    return query


def arrive(spark, source, rows):
    moments = [(i, s, None if at is None else START + at) for i, s, at in rows]
    spark.createDataFrame(moments, STATES).write.mode("append").parquet(source)


STATES = "request_id string, status string, created_at timestamp"
START = datetime(2024, 1, 1)
DAY = timedelta(days=1)
SECOND = timedelta(seconds=1)


def test_stuck_is_what_nothing_followed_in_time(spark, tmp_path):
    """Whatever the batches: a follower at the last moment counts, one later does not."""
    source, offsets, target = (str(tmp_path / n) for n in ("states", "offsets", "stuck"))
    micro = timedelta(microseconds=1)
    for rows in (
        [
            ("in time", "RUNNING", 0 * SECOND),
            ("in time", "COMPLETED", 300 * SECOND),
            ("late", "RUNNING", 0 * SECOND),
            ("late", "COMPLETED", 300 * SECOND + micro),
            ("twice", "RUNNING", 0 * SECOND),
            ("twice", "RUNNING", 200 * SECOND),
            ("tie", "RUNNING", 0 * SECOND),
            ("tie", "FAILED", 0 * SECOND),
            (None, "RUNNING", 0 * SECOND),
            ("odd", "RUNNING", 0 * SECOND),
            ("odd", "PAUSED", SECOND),
            ("no time", "RUNNING", None),
        ],
        [("other", "COMPLETED", DAY)],
    ):
        arrive(spark, source, rows)
        consume(spark, runner.stuck_stream, STATES, source, offsets, target)
    found = {(r.request_id, r.running_since) for r in spark.read.parquet(target).collect()}
    assert found == {
        ("late", START), ("twice", START + 200 * SECOND), (None, START),
    }


def test_dead_letters_come_at_once_and_are_forgotten(spark, tmp_path):
    source, offsets, target = (str(tmp_path / n) for n in ("states", "offsets", "letters"))

    def step(rows):
        arrive(spark, source, rows)
        query = consume(
            spark, dead_letters.dead_letter_stream, STATES, source, offsets, target
        )
        letters = dead_letters.current_letters(
            spark.read.schema(dead_letters.LETTERS).parquet(target)
        )
        sizes = [p.stateOperators[0] for p in query.recentProgress]
        return {r.request_id: (r.failures, r.failed_at) for r in letters.collect()}, sizes

    failed = [("a", "FAILED", n * SECOND) for n in range(3)]
    found, sizes = step(
        [
            *failed,
            *[("b", "FAILED", n * SECOND) for n in range(3)],
            ("b", "COMPLETED", 3 * SECOND),
            ("c", "FAILED", SECOND),
            ("c", "FAILED", SECOND),
            (None, "FAILED", SECOND),
            ("no time", "FAILED", None),
        ]
    )
    assert found == {"a": (3, START + 2 * SECOND)}
    assert any("rocksdbSstFileSize" in s.customMetrics for s in sizes)
    found, _ = step([("c", "FAILED", 5 * SECOND), ("a", "RUNNING", 6 * SECOND)])
    assert found == {"c": (3, START + 5 * SECOND)}
    found, _ = step([("a", "FAILED", 4 * SECOND)])  # behind a newer transition
    assert found == {"c": (3, START + 5 * SECOND)}
    full = sizes[-1].numRowsTotal
    _, sizes = step([("d", "QUEUED", 20 * DAY)])
    assert full > sizes[-1].numRowsTotal > 0  # two weeks of silence
    found, _ = step([("c", "RUNNING", 20 * DAY), ("a", "FAILED", 20 * DAY)])
    assert found == {"c": (3, START + 5 * SECOND)}  # counted anew; its letter was given out


def test_invocations_do_not_depend_on_files(spark, tmp_path):
    folder, out, offsets = (str(tmp_path / n) for n in ("queue", "out", "offsets"))
    event = """{"request_id":"r%d","created_at":"2024-01-01T12:00:%02d.000000"}"""

    def send_bodies(bodies, files):
        frame = spark.createDataFrame([(b,) for b in bodies], "value string")
        queue.send(frame.repartition(files), folder)
        arrived = queue.receive(spark, folder, files_per_trigger=1000)
        runner.run_invocations(arrived, out, offsets).awaitTermination()

    send_bodies([event % (n, n) for n in range(23)] + ["no event", "no event"], 7)
    send_bodies([event % (3, 3), event % (50, 50)], 1)
    rows = runner.read_invocations(spark, out).orderBy("batch_id", "row_no").collect()
    assert [r.invocation for r in rows] == [*[0] * 10, *[1] * 10, *[2] * 5, 0, 0]
    assert [r.request_id for r in rows] == [
        None, None, *[f"r{n}" for n in range(23)], "r3", "r50",
    ]
    batch = queue.read_all(spark, folder).filter("request_id in ('r3', 'r50')")
    runner.invocation_runner(out)(batch.dropDuplicates(["request_id"]), 1)  # a replay
    assert runner.read_invocations(spark, out).count() == 27
