"""Content identity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(data: Column) -> Column:
    """``sha256:`` and the hexadecimal digest of a text's bytes."""
    return F.concat(F.lit("sha256:"), F.sha2(data, 256))


def ended(body: Column) -> Column:
    """A body that ends with a line break."""
    return F.when(body.endswith("\n"), body).otherwise(F.concat(body, F.lit("\n")))


def body_hash(body: Column) -> Column:
    """Identity of a body, whether or not its last line ends."""
    return digest(ended(body))


def section_hash(title: Column, body: Column) -> Column:
    """Identity of a section: title, a null byte, body."""
    return digest(F.concat(F.coalesce(title, F.lit("")), F.lit("\0"), body))


def content_hash(title: Column, source: Column, content_type: Column, captured_at: Column, tags: Column, extra: Column, body: Column) -> Column:
    """Identity of a document with its metadata, over one canonical rendering."""
    stamp = F.date_format(captured_at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    entries = F.array_join(F.transform(F.array_sort(F.map_entries(F.coalesce(extra, F.create_map().cast("map<string,string>")))), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), "\x1f")
    parts = [F.coalesce(c, F.lit("")) for c in (title, source, content_type, stamp)]
    return digest(F.concat_ws("\x1e", *parts, F.array_join(F.coalesce(tags, F.array().cast("array<string>")), "\x1f"), entries, ended(body)))


def is_ulid(value: Column) -> Column:
    """Whether a text is a ULID in capitals."""
    return value.rlike("^[0-7][0-9A-HJKMNP-TV-Z]{25}$")


def doc_path(doc_id: Column, captured_at: Column, slug: Column) -> Column:
    """Where a document's file lies: by year and month of capture."""
    return F.concat(F.lit("docs/"), F.date_format(captured_at, "yyyy/MM/"), doc_id, F.lit("-"), slug, F.lit(".md"))


def ulid(at: Column, *salt: Column) -> Column:
    """A ULID of a time in milliseconds and, deterministically, of ``salt``: retries give the same id."""
    alphabet = F.lit("0123456789ABCDEFGHJKMNPQRSTVWXYZ")
    millis = F.unix_millis(at)
    stamp = [F.substring(alphabet, (F.shiftright(millis, 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for k in range(9, -1, -1)]
    hashed = F.sha2(F.concat_ws("\x1f", *[F.coalesce(s.cast("string"), F.lit("")) for s in salt]), 256)
    rest = [F.substring(alphabet, (F.conv(F.substring(hashed, 2 * k + 1, 2), 16, 10).cast("int") % 32 + 1).cast("int"), F.lit(1)) for k in range(16)]
    return F.concat(*stamp, *rest)
