"""Entities, enumerations and limits shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
# Names, messages and limits that callers compare against; they must stay as is.

ACTIVE = "ACTIVE"
DELETED = "DELETED"

QUEUED = "QUEUED"
RUNNING = "RUNNING"
COMPLETED = "COMPLETED"
FAILED = "FAILED"

TEXT_MIME = "text/plain"
PDF_MIME = "application/pdf"
WEBP_MIME = "image/webp"
PAGE_IMAGE_MIME = "image/png"
IMAGE_MIMES = (
    "image/png",
    "image/jpg",
    "image/jpeg",
    "image/gif",
    "image/bmp",
    "image/tiff",
)

SCHEMA_DOES_NOT_EXIST = ("SchemaDoesNotExist", "Schema does not exist.")
REQUEST_DOES_NOT_EXIST = ("RequestDoesNotExist", "Request does not exist.")
INVALID_MIME_TYPE = ("InvalidMimeType", "Invalid MIME type.")
INVALID_DATA = ("InvalidData", "Data does not match schema")
JSON_DECODE_ERROR = ("JSONDecodeError", "Output is not one JSON object")
DECODE_ERROR = ("Error", "Content is not base64")
VALIDATION_ERROR = "ValidationError"
SCHEMA_ERROR = "SchemaError"
TOO_LARGE = "SchemaDefinitionTooLarge"
CLIENT_ERRORS = (
    "InvalidData",
    "InvalidMimeType",
    "ValidationError",
    "RequestDoesNotExist",
    "SchemaDoesNotExist",
    "SchemaDefinitionTooLarge",
)

NAME_LENGTH = (4, 64)
DESCRIPTION_LENGTH = (8, 1028)
VERSION_LENGTH = 10
CONTENT_LENGTH = (1, 10_000_000)
MIME_LENGTH = (1, 64)
SCHEMA_TOKEN_LIMIT = 2048
MAX_OUTPUT_TOKENS = 4096
ATTEMPT_LIMIT = 3
SEED = 43
TEMPERATURE = 0
TEXT_MODEL = "gpt-4-turbo"
VISION_MODEL = "gpt-4-turbo"

QUEUE_BATCH_SIZE = 10
VISIBILITY_TIMEOUT_SECONDS = 300
RETENTION_DAYS = 14
MONTHLY_QUOTA = 10_000
RATE_PER_SECOND = 10
BURST_LIMIT = 2
LIST_PAGE_SIZE = 50
LIST_PAGE_SIZE_LIMIT = 100
TABLE_PAGE_SIZE = 10
THREAD_MEMORY = 20

JSON_TYPES = ("array", "boolean", "integer", "null", "number", "object", "string")
# --- end of fixed values ----------------------------------------------------

# Order of the states of one request when two rows carry the same timestamp.
STATUS_RANK = {QUEUED: 0, RUNNING: 1, FAILED: 2, COMPLETED: 3}

SCHEMA_ROW = T.StructType(
    [
        T.StructField("schema_name", T.StringType()),
        T.StructField("schema_version", T.StringType()),
        T.StructField("schema_description", T.StringType()),
        T.StructField("schema_definition", T.StringType()),
        T.StructField("schema_status", T.StringType()),
        T.StructField("number_of_tokens", T.IntegerType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("written_at", T.TimestampNTZType()),
    ]
)

QUEUE_EVENT = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField(
            "key",
            T.StructType(
                [
                    T.StructField("schema_name", T.StringType()),
                    T.StructField("schema_version", T.StringType()),
                ]
            ),
        ),
        T.StructField(
            "payload",
            T.StructType(
                [
                    T.StructField("schema_definition", T.StringType()),
                    T.StructField("text_data", T.StringType()),
                    T.StructField("image_list", T.ArrayType(T.StringType())),
                ]
            ),
        ),
        T.StructField("created_at", T.TimestampNTZType()),
    ]
)

STATE_ROW = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
    ]
)

ERROR = T.StructType(
    [
        T.StructField("error_name", T.StringType()),
        T.StructField("error_message", T.StringType()),
    ]
)
