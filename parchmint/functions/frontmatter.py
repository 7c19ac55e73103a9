"""Documents as files: a block of metadata between fences, then the body."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
import yaml
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from parchmint.schemas import struct_type

FENCE = "---\n"
# The order of the known keys; others follow sorted.
ORDER = ["id", "title", "source", "type", "captured", "updated", "tags", "content_hash"]


class FrontmatterError(ValueError):
    """A document without a readable block of metadata."""


def split(text: str) -> tuple[dict, str]:
    """Metadata and body; the one blank line after the block belongs to neither."""
    if not text.startswith(FENCE):
        raise FrontmatterError("no opening fence")
    rest = text[len(FENCE) :]
    block, closed, body = rest.partition("\n---\n")
    if closed:
        body = body.removeprefix("\n")
    elif rest.rstrip("\n").endswith("---"):
        block, body = rest[: rest.rindex("---")].rstrip("\n"), ""
    else:
        raise FrontmatterError("no closing fence")
    try:
        meta = yaml.safe_load(block) or {}
    except yaml.YAMLError as error:
        raise FrontmatterError(str(error)) from None
    if not isinstance(meta, dict):
        raise FrontmatterError("metadata are not a mapping")
    return meta, body


def join(meta: dict, body: str) -> str:
    """The file's text, keys in their order."""
    keys = [k for k in ORDER if k in meta] + sorted(k for k in meta if k not in ORDER)
    block = yaml.safe_dump({k: meta[k] for k in keys}, default_flow_style=False, allow_unicode=True, sort_keys=False)
    return f"{FENCE}{block}{FENCE}\n{body}"


def stamp(value: object) -> dt.datetime | None:
    """A time in UTC of a YAML value, null if it is none."""
    if isinstance(value, str):
        try:
            value = dt.datetime.fromisoformat(value.strip().removesuffix("Z"))
        except ValueError:
            return None
    if isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    if not isinstance(value, dt.datetime):
        return None
    return value.astimezone(dt.UTC).replace(tzinfo=None) if value.tzinfo else value


PARSED = "id string, title string, source string, content_type string, captured_at timestamp, updated_at timestamp, tags array<string>, extra map<string,string>, content_hash string, body_hash string, body string, error string"


def parse_row(text: str | None, strict: bool) -> dict:
    """The columns of :data:`PARSED` of one file; ``error`` says what is wrong with it.

    Not strict, a file without metadata is a body alone.
    """
    row = dict.fromkeys([c.split()[0] for c in PARSED.split(", ")])
    try:
        meta, row["body"] = split(text or "")
    except FrontmatterError as error:
        if strict:
            return row | {"error": str(error)}
        meta, row["body"] = {}, text or ""
    known = {"id": "id", "title": "title", "source": "source", "type": "content_type", "content_hash": "content_hash", "body_hash": "body_hash"}
    for key, column in known.items():
        row[column] = None if meta.get(key) is None else str(meta[key])
    row["captured_at"], row["updated_at"] = stamp(meta.get("captured") or meta.get("captured_at")), stamp(meta.get("updated"))
    tags = meta.get("tags") or []
    row["tags"] = [str(t) for t in tags] if isinstance(tags, list) else [str(tags)]
    row["extra"] = {str(k): str(v) for k, v in meta.items() if k not in {*known, "captured", "captured_at", "updated", "tags"} and v is not None}
    return row


def parser(strict: bool = True):
    """A function from file texts to structs of :data:`PARSED`."""

    @F.pandas_udf(struct_type(PARSED))
    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PARSED.split(", ")]
        for values in batches:
            yield pd.DataFrame([parse_row(v if isinstance(v, str) else None, strict) for v in values], columns=names).assign(
                captured_at=lambda d: pd.to_datetime(d["captured_at"]), updated_at=lambda d: pd.to_datetime(d["updated_at"])
            )

    return parsed


@F.pandas_udf(StringType())
def file_text(doc_id: pd.Series, title: pd.Series, source: pd.Series, kind: pd.Series, captured: pd.Series, updated: pd.Series, tags: pd.Series, extra: pd.Series, content_hash: pd.Series, body: pd.Series) -> pd.Series:
    """A document as its file has it: all its metadata that is there, in their order, then the body."""

    def one(i, t, s, k, c, u, g, e, h, b):
        given = {"id": i, "title": t, "source": s, "type": k, "content_hash": h}
        meta = {n: v for n, v in given.items() if isinstance(v, str)}
        meta |= {n: v.strftime("%Y-%m-%dT%H:%M:%SZ") for n, v in (("captured", c), ("updated", u)) if not pd.isna(v)}
        if g is not None:
            meta["tags"] = list(g)
        return join(meta | {str(k): v for k, v in dict(e or {}).items() if k not in meta}, b if isinstance(b, str) else "")

    return pd.Series([one(*row) for row in zip(doc_id, title, source, kind, captured, updated, tags, extra, content_hash, body)], dtype="object")


FILE_COLUMNS = ["id", "title", "source", "content_type", "captured_at", "updated_at", "tags", "extra", "content_hash", "body"]


@F.pandas_udf(StringType())
def rendered(title: pd.Series, source: pd.Series, kind: pd.Series, captured: pd.Series, tags: pd.Series, author: pd.Series, sender: pd.Series, body: pd.Series) -> pd.Series:
    """A capture as a file's text: metadata, the title as a heading, the content."""

    def one(t, s, k, c, g, a, e, b):
        meta = {"title": t, "source": s, "type": k, "captured": None if pd.isna(c) else c.strftime("%Y-%m-%dT%H:%M:%SZ"), "tags": [] if g is None else list(g)}
        meta |= {n: v for n, v in (("author", a), ("sender_email", e)) if isinstance(v, str) and v}
        block = yaml.safe_dump(meta, default_flow_style=False, allow_unicode=True, sort_keys=False)
        return f"{FENCE}{block}{FENCE}\n# {t}\n\n{b}\n"

    return pd.Series([one(*row) for row in zip(title, source, kind, captured, tags, author, sender, body)], dtype="object")
