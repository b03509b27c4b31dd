"""Schemas of the engine's tables, and the driver-side results."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: What a container source yields: nothing is decoded or normalised yet.
RAW_SCHEMA = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("folder_path", T.StringType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("body_bytes", T.BinaryType()),
        T.StructField("html_bytes", T.BinaryType()),
        T.StructField("attachment_names", T.ArrayType(T.StringType())),
        T.StructField("native_time", T.TimestampType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("locator", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)

#: One row a message.
MAILS_SCHEMA = T.StructType(
    [
        T.StructField("rowid", T.LongType()),
        T.StructField("message_id", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("folder_path", T.StringType()),
        T.StructField("from_addr", T.StringType()),
        T.StructField("to_addr", T.StringType()),
        T.StructField("cc_addr", T.StringType()),
        T.StructField("date_utc", T.LongType()),
        T.StructField("subject", T.StringType()),
        T.StructField("snippet", T.StringType()),
        T.StructField("has_attachment", T.BooleanType()),
        T.StructField("attachment_names", T.ArrayType(T.StringType())),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("body", T.StringType()),
        T.StructField("raw_body_b64", T.StringType()),
        T.StructField("decode_status", T.StringType()),
        T.StructField("indexed_at", T.LongType()),
        T.StructField("locator_json", T.StringType()),
    ]
)

ERROR_SCHEMA = "file_path string, folder_path string, error_type string, error string, ts long"

#: Canonical search field: the column of ``mails`` that holds it.
FIELD_COLUMNS = {
    "subject": "subject",
    "body": "body",
    "from": "from_addr",
    "to": "to_addr",
    "cc": "cc_addr",
    "attachments": "attachment_names",
}

#: Columns of a hit.
HIT_COLUMNS = ["rowid", "message_id", "file_path", "folder_path", "from_addr", "to_addr", "date_utc", "subject", "snippet", "has_attachment", "attachment_names"]


@dataclass(frozen=True)
class Probe:
    """One condition of a query, counted alone."""

    label: str
    count: str
    culprit: bool


@dataclass
class SearchResult:
    hits: DataFrame
    warnings: list[str] = field(default_factory=list)
    more_available: bool = False
    diagnosis: list[Probe] = field(default_factory=list)
    elapsed_ms: float = 0.0
