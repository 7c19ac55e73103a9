"""Schemas of the vault's tables, as Spark DDL."""

from __future__ import annotations

DOCS = "id STRING, path STRING, title STRING, source STRING, content_type STRING, captured_at TIMESTAMP, updated_at TIMESTAMP, tags ARRAY<STRING>, extra MAP<STRING,STRING>, content_hash STRING, body_hash STRING"
BODIES = f"{DOCS}, body STRING"
WRITES = "seq BIGINT, body STRING, title STRING, source STRING, content_type STRING, captured_at TIMESTAMP, tags ARRAY<STRING>, extra MAP<STRING,STRING>"
CHANGES = "seq BIGINT, kind STRING, id STRING, path STRING, content_hash STRING, occurred_at TIMESTAMP"
SECTION = "STRUCT<level: INT, title: STRING, path: ARRAY<STRING>, body: STRING>"
SECTIONS = "doc_id STRING, ord INT, level INT, title STRING, path ARRAY<STRING>, body STRING"
VECTORS = "doc_id STRING, ord INT, title STRING, path ARRAY<STRING>, content_hash STRING, embedding ARRAY<FLOAT>"
HITS = "doc_id STRING, section_title STRING, section_path ARRAY<STRING>, snippet STRING, score DOUBLE"
FEEDS = "id STRING, url STRING, name STRING, tags ARRAY<STRING>, enabled BOOLEAN, created_at TIMESTAMP, last_sync_at TIMESTAMP, last_status STRING, last_error STRING"
JOBS = "id STRING, url STRING, persist BOOLEAN, frontmatter STRING, html STRING, fallback_title STRING, status STRING, created_at TIMESTAMP, started_at TIMESTAMP, completed_at TIMESTAMP, doc_id STRING, doc_path STRING, body_hash STRING, error STRING, attempts INT"
LABELED = "row_id BIGINT, id STRING, sender STRING, subject STRING, body STRING, label STRING, raw STRING, source STRING, ts BIGINT"
CAPTURE = "STRUCT<url: STRING, title: STRING, content_markdown: STRING, content_type: STRING, author: STRING, sender_email: STRING, captured_at: TIMESTAMP, tags: ARRAY<STRING>>"

CONTENT_TYPES = ["article", "video", "newsletter"]
#: Keys a caller cannot set.
RESERVED = ["id", "captured", "updated", "content_hash", "body_hash"]


def struct_type(fields: str):
    """The StructType of "name type, ..." for plain types and arrays and maps of strings; needs no session."""
    from pyspark.sql import types as t

    kinds = {
        "string": t.StringType(), "bigint": t.LongType(), "int": t.IntegerType(), "double": t.DoubleType(), "boolean": t.BooleanType(), "timestamp": t.TimestampType(), "binary": t.BinaryType(),
        "array<string>": t.ArrayType(t.StringType()), "map<string;string>": t.MapType(t.StringType(), t.StringType()),
    }
    parts = [f.strip().split(" ") for f in fields.replace("map<string,string>", "map<string;string>").split(",")]
    return t.StructType([t.StructField(name, kinds[kind.lower()]) for name, kind in parts])
