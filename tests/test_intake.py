from __future__ import annotations

import base64
from datetime import datetime

from pyspark.sql import functions as F

from recordloom import model
from recordloom.operators import intake

AT = datetime(2024, 1, 5)
COLUMNS = (
    "request_id string, schema_name string, schema_version string, content string, "
    "mime_type string, created_at timestamp_ntz"
)


def requests(spark, *rows):
    return spark.createDataFrame([(*row, AT) for row in rows], COLUMNS)


def one(name="name", version="v" * 10, content="text", mime="text/plain"):
    return ("r", name, version, content, mime)


def test_lengths(spark):
    cases = [
        (one(name="abc"), "schema_name: too short"),
        (one(name="a" * 64), None),
        (one(name="a" * 65), "schema_name: too long"),
        (one(name=None), "schema_name: missing"),
        (one(version="v" * 9), "schema_version: wrong length"),
        (one(version=None), "schema_version: missing"),
        (one(content=""), "content: too short"),
        (one(mime=""), "mime_type: too short"),
        (one(mime="m" * 65), "mime_type: too long"),
    ]
    for row, problem in cases:
        checked = intake.check_requests(requests(spark, row)).first()
        assert checked.error_message == problem
        assert checked.error_name == (model.VALIDATION_ERROR if problem else None)
    relaxed = intake.check_requests(requests(spark, one(version="v")), enforce_version_length=False)
    assert relaxed.first().error_name is None


def test_content_size_limit(spark):
    sized = spark.range(2).select(
        F.lit("r").alias("request_id"),
        F.lit("name").alias("schema_name"),
        F.lit("v" * 10).alias("schema_version"),
        F.expr("repeat('x', 10000000 + cast(id AS int))").alias("content"),
        F.lit("text/plain").alias("mime_type"),
    )
    found = [r.error_message for r in intake.check_requests(sized).select("error_message").collect()]
    assert sorted(found, key=str) == [None, "content: too long"]


def test_mime_routing(spark):
    mimes = [
        "text/plain", "application/pdf", "image/png", "image/jpg", "image/jpeg", "image/gif",
        "image/bmp", "image/tiff", "image/webp", "text/html",
    ]
    df = spark.createDataFrame([(m,) for m in mimes], "mime_type string")
    kinds = [r[0] for r in df.select(intake.mime_kind()).collect()]
    assert kinds == ["text", "pdf"] + ["image"] * 6 + ["unsupported"] * 2
    webp = df.select(intake.mime_kind(webp_is_image=True)).collect()[8][0]
    assert webp == "image"
    strict = intake.check_requests(requests(spark, one(mime="text/html"))).first()
    assert strict.error_name == "InvalidMimeType"
    loose = intake.check_requests(requests(spark, one(mime="text/html")), strict_mime=False).first()
    assert loose.error_name is None


def test_pages_and_manifest_keep_their_order(spark):
    pdf = base64.b64encode(b"one\ftwo\fthree").decode()
    image = base64.b64encode(b"pixels").decode()
    df = requests(
        spark,
        ("a", "name", "v" * 10, pdf, "application/pdf"),
        ("b", "name", "v" * 10, image, "image/gif"),
        ("c", "name", "v" * 10, "plain", "text/plain"),
        ("d", "name", "v" * 10, "###", "image/png"),
    )
    pages = {
        (r.request_id, r.page_no): (r.mime_type, r.page and bytes(r.page))
        for r in intake.page_fanout(df).collect()
    }
    assert pages == {
        ("a", 1): ("image/png", b"one"),
        ("a", 2): ("image/png", b"two"),
        ("a", 3): ("image/png", b"three"),
        ("b", 1): ("image/gif", b"pixels"),
        ("c", None): ("text/plain", None),
        ("d", None): ("image/png", None),
    }
    prepared = {
        r.request_id: r
        for r in intake.prepare(df.withColumn("schema_definition", F.lit("{}"))).collect()
    }
    keys = {
        (r.request_id, r.page_no): r.object_key for r in intake.media_manifest(df).collect()
    }
    assert prepared["a"].image_list == [keys[("a", i)] for i in (1, 2, 3)]
    assert prepared["c"].text_data == "plain" and prepared["c"].image_list == []
    assert prepared["d"].error_name == "Error"
    assert prepared["b"].text_data == ""


def test_custom_page_splitter(spark):
    pdf = base64.b64encode(b"%PDF one|two").decode()
    df = requests(spark, ("a", "name", "v" * 10, pdf, "application/pdf"), one())
    pages = intake.pages_with(df, lambda data: data.split(b"|")).collect()
    assert [(r.request_id, r.page_no, bytes(r.page)) for r in pages] == [
        ("a", 1, b"%PDF one"),
        ("a", 2, b"two"),
    ]


def test_deleted_schemas_resolve_unless_told_otherwise(spark):
    df = requests(spark, one(), one(name="other"))
    schemas = spark.createDataFrame(
        [("name", "v" * 10, "{}", "DELETED")],
        "schema_name string, schema_version string, schema_definition string, schema_status string",
    )
    assert intake.resolve(df, schemas).count() == 1
    assert intake.resolve(df, schemas, allow_deleted=False).count() == 0
    assert intake.unresolved(df, schemas).count() == 1
    assert intake.unresolved(df, schemas, allow_deleted=False).count() == 2
