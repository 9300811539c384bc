"""Request validation, MIME routing, page fan-out and schema resolution.

Requests are rows (request_id, schema_name, schema_version, content, mime_type,
created_at). Work on pages happens inside the row of the document (its size is
limited to 10 million characters), so documents are never regrouped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom import model
from recordloom.functions.joins import lookup_join
from recordloom.functions.text import base64_text
from recordloom.operators.registry import KEY, length_problem

PAGE_BREAK = "\f"


def request_problems(enforce_version_length: bool = True) -> Column:
    """Broken presence and length rules of a request, [] for a valid one."""
    version = F.col("schema_version")
    return F.array_compact(
        F.array(
            length_problem("schema_name", model.NAME_LENGTH),
            F.when(version.isNull(), "schema_version: missing").when(
                F.lit(enforce_version_length) & (F.char_length(version) != model.VERSION_LENGTH),
                "schema_version: wrong length",
            ),
            length_problem("content", model.CONTENT_LENGTH),
            length_problem("mime_type", model.MIME_LENGTH),
        )
    )


def check_requests(
    requests: DataFrame, enforce_version_length: bool = True, strict_mime: bool = True
) -> DataFrame:
    """Add error_name and error_message, NULL for a request that may go on."""
    problems = request_problems(enforce_version_length)
    name, message = model.INVALID_MIME_TYPE
    bad_mime = F.lit(strict_mime) & (mime_kind() == "unsupported")
    broken = F.size("_problems") > 0
    return (
        requests.withColumn("_problems", problems)
        .withColumns(
            {
                "error_name": F.when(broken, model.VALIDATION_ERROR).when(bad_mime, name),
                "error_message": F.when(broken, F.array_join("_problems", "; ")).when(
                    bad_mime, message
                ),
            }
        )
        .drop("_problems")
    )


def valid(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("error_name").isNull()).drop("error_name", "error_message")


def invalid(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("error_name").isNotNull()).select(
        "request_id", "schema_name", "schema_version", "error_name", "error_message"
    )


def mime_kind(column: str = "mime_type", webp_is_image: bool = False) -> Column:
    """Text, pdf, image or unsupported."""
    images = list(model.IMAGE_MIMES) + ([model.WEBP_MIME] if webp_is_image else [])
    mime = F.col(column)
    return (
        F.when(mime == model.TEXT_MIME, "text")
        .when(mime == model.PDF_MIME, "pdf")
        .when(mime.isin(*images), "image")
        .otherwise("unsupported")
    )


def text_payload() -> Column:
    """The content of text documents, "" for everything else."""
    return F.when(mime_kind() == "text", F.col("content")).otherwise("")


def decoded(column: str = "content") -> Column:
    """D3: base64 text to bytes, NULL when the text is no base64."""
    return F.try_to_binary(F.col(column), F.lit("base64"))


def decode_content(requests: DataFrame) -> DataFrame:
    """D3: add ``bytes`` for media requests and an error for undecodable ones."""
    media = mime_kind().isin("pdf", "image")
    name, message = model.DECODE_ERROR
    failed = media & F.col("bytes").isNull()
    return (
        requests.withColumn("bytes", F.when(media, decoded()))
        .withColumn("error_name", F.when(failed, name))
        .withColumn("error_message", F.when(failed, message))
    )


def split_text_pages(page_break: str = PAGE_BREAK) -> Callable[[Column], Column]:
    """Built-in page splitter: pages divided by a literal ASCII separator.

    A custom splitter is any function from the document's bytes to an array of
    page bytes; ``pages_with`` takes the ones that need a Python library.
    """

    def split(data: Column) -> Column:
        # One character per byte: any bytes pass through unchanged.
        whole = F.decode(data, "ISO-8859-1")
        parts = F.split(whole, r"\Q" + page_break + r"\E", -1)
        return F.transform(parts, lambda page: F.encode(page, "ISO-8859-1"))

    return split


def page_arrays(requests: DataFrame, splitter: Callable[[Column], Column] | None = None):
    """Add ``pages`` (binary pages in order) and ``page_mime``.

    A PDF becomes its page images, an image becomes one page, text none.
    """
    kind = mime_kind()
    data = decoded()
    split = (splitter or split_text_pages())(data)
    nothing = F.array().cast("array<binary>")
    one = F.when(data.isNotNull(), F.array(data))
    pages = F.when(kind == "pdf", split).when(kind == "image", one).otherwise(nothing)
    return requests.withColumns(
        {
            "pages": F.coalesce(pages, nothing),
            "page_mime": F.when(kind == "pdf", model.PAGE_IMAGE_MIME).otherwise(
                F.col("mime_type")
            ),
        }
    )


def pages_with(requests: DataFrame, split_document: Callable[[bytes], list[bytes]]) -> DataFrame:
    """D7 for binary formats: ``split_document`` runs in Arrow batches on the
    executors; only the key and the bytes of media documents travel to Python.
    Result: (request_id, page_no, page, mime_type) — one row per page, an image
    being its own page, so no page list is ever built for another document.
    ``manifest_of`` and ``prepare_pages`` take it from here."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for request_id, data in zip(*batch.to_pydict().values(), strict=True):
                pages = split_document(data)
                yield pa.RecordBatch.from_pydict(
                    {
                        "request_id": pa.array([request_id] * len(pages), pa.string()),
                        "page_no": pa.array(range(1, len(pages) + 1), pa.int32()),
                        "page": pa.array(pages, pa.binary()),
                    }
                )

    data = decoded()
    documents = requests.filter((mime_kind() == "pdf") & data.isNotNull())
    split = documents.select("request_id", data.alias("data")).mapInArrow(
        run, "request_id string, page_no int, page binary"
    )
    images = requests.filter((mime_kind() == "image") & data.isNotNull())
    return split.withColumn("mime_type", F.lit(model.PAGE_IMAGE_MIME)).unionByName(
        images.select("request_id", F.lit(1).alias("page_no"), data.alias("page"), "mime_type")
    )


def manifest_of(pages: DataFrame) -> DataFrame:
    """D8 from page rows."""
    return pages.select(
        "request_id",
        "page_no",
        object_key(F.col("request_id"), F.col("page_no"), F.col("page")).alias("object_key"),
        "mime_type",
        F.octet_length("page").alias("n_bytes"),
        F.col("page").alias("content"),
    )


def prepare_pages(resolved: DataFrame, manifest: DataFrame) -> DataFrame:
    """D11 with the pages of a custom splitter: ``manifest`` gives the object keys.
    Media without any page has an empty list."""
    entry = F.struct("page_no", "object_key")
    keys = manifest.groupBy("request_id").agg(F.sort_array(F.collect_list(entry)).alias("_keys"))
    undecodable = mime_kind().isin("pdf", "image") & decoded().isNull()
    name, message = model.DECODE_ERROR
    return (
        resolved.join(keys, "request_id", "left")
        .withColumns(
            {
                "text_data": text_payload(),
                "image_list": F.coalesce(
                    F.col("_keys.object_key"), F.array().cast("array<string>")
                ),
                "error_name": F.when(undecodable, name),
                "error_message": F.when(undecodable, message),
            }
        )
        .drop("_keys", "content")
    )


def page_fanout(requests: DataFrame, splitter: Callable[[Column], Column] | None = None):
    """One row per page; documents without pages keep one row."""
    paged = page_arrays(requests, splitter)
    return paged.select(
        "request_id",
        "schema_name",
        "schema_version",
        "page_mime",
        F.posexplode_outer("pages").alias("_pos", "page"),
    ).select(
        "request_id",
        "schema_name",
        "schema_version",
        F.col("page_mime").alias("mime_type"),
        (F.col("_pos") + 1).alias("page_no"),
        "page",
    )


def object_key(request_id: Column, page_no: Column, page: Column) -> Column:
    """Place and content of a page: equal pages of one document have keys of their
    own, and a rerun writes the same ones."""
    return F.concat_ws("/", request_id, F.concat_ws("-", page_no, F.sha2(page, 256)))


def media_manifest(requests: DataFrame, splitter: Callable[[Column], Column] | None = None):
    """The media objects of each request, ready to be written."""
    return manifest_of(page_fanout(requests, splitter).filter(F.col("page").isNotNull()))


def resolve(requests: DataFrame, schemas: DataFrame, allow_deleted: bool = True) -> DataFrame:
    """Attach the schema of each request; deleted ones resolve by default."""
    if not allow_deleted:
        schemas = schemas.filter(F.col("schema_status") != model.DELETED)
    columns = [c for c in schemas.columns if c not in ("created_at", "written_at")]
    return lookup_join(
        requests, schemas.select(*columns), KEY, "inner", spread_by=("request_id",)
    )


def unresolved(requests: DataFrame, schemas: DataFrame, allow_deleted: bool = True) -> DataFrame:
    """Requests whose schema does not exist. They leave no state row."""
    if not allow_deleted:
        schemas = schemas.filter(F.col("schema_status") != model.DELETED)
    name, message = model.SCHEMA_DOES_NOT_EXIST
    keys = requests.select("request_id", *KEY)
    return lookup_join(
        keys, schemas.select(*KEY), KEY, "left_anti", spread_by=("request_id",)
    ).select(
        "request_id", *KEY, F.lit(name).alias("error_name"), F.lit(message).alias("error_message")
    )


def prepare(resolved: DataFrame, splitter: Callable[[Column], Column] | None = None) -> DataFrame:
    """Add text_data and image_list (object keys in page order).

    Media that cannot be decoded carries an error, see ``valid`` and ``invalid``.
    """
    paged = page_arrays(resolved, splitter)
    keys = F.transform(
        "pages", lambda page, at: object_key(F.col("request_id"), at + 1, page)
    )
    undecodable = mime_kind().isin("pdf", "image") & decoded().isNull()
    name, message = model.DECODE_ERROR
    return paged.withColumns(
        {
            "text_data": text_payload(),
            "image_list": keys,
            "error_name": F.when(undecodable, name),
            "error_message": F.when(undecodable, message),
        }
    ).drop("pages", "page_mime", "content")


def page_requests(
    documents: DataFrame,
    schema_name: str,
    schema_version: str,
    splitter: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Each page of a document becomes a request of its own, all with the
    same schema key (two constants, so nothing is joined)."""
    keyed = documents.withColumn("schema_name", F.lit(schema_name)).withColumn(
        "schema_version", F.lit(schema_version)
    )
    pages = page_fanout(keyed, splitter).filter(F.col("page").isNotNull())
    return pages.select(
        F.concat_ws("-", "request_id", "page_no").alias("request_id"),
        *KEY,
        base64_text(F.col("page")).alias("content"),
        "mime_type",
    )
