"""Mail messages as captures, and the headers the newsletter rules need."""

from __future__ import annotations

import datetime as dt
import email
import email.policy
import email.utils
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from parchmint.schemas import struct_type

from parchmint.functions.pages import to_markdown

HEADER = re.compile(rb"^[A-Za-z][A-Za-z0-9-]*:\s", re.MULTILINE)
PARSED = "url string, title string, html_markdown string, plain string, author string, sender_email string, captured_at timestamp, list_id string, return_path string, from_header string, error string"


def author_of(sender: Column) -> Column:
    """The display name of a From header, or the header itself; null for none."""
    name = F.trim(F.regexp_extract(sender, r'^"?([^"<]+)"?\s*<', 1))
    return F.when(F.coalesce(sender, F.lit("")) == "", None).when(name != "", name).otherwise(F.trim(sender))


def address_of(sender: Column) -> Column:
    """The address of a From header; null if it has none."""
    inside = F.trim(F.regexp_extract(sender, r"<([^>]+)>", 1))
    return F.when(inside != "", inside).when(sender.contains("@"), F.trim(sender))


def domain_of(address: Column) -> Column:
    """What follows the first @, lower-cased."""
    return F.lower(F.when(address.contains("@"), F.regexp_extract(address, r"^[^@]*@(.*)$", 1)).otherwise(""))


def _part(message, kind: str) -> str | None:
    for part in message.walk():
        if part.get_content_type() == kind and not part.is_multipart():
            try:
                return part.get_content()
            except Exception:  # an unknown charset or broken encoding is no content
                return None
    return None


def parse_message(raw: bytes) -> dict:
    """The columns of :data:`PARSED` of one raw message; text before the first header is dropped."""
    found = HEADER.search(raw)
    message = email.message_from_bytes(raw[found.start() :] if found else raw, policy=email.policy.default)
    sender = str(message.get("from", ""))
    inside = re.search(r"<([^>]+)>", sender)
    name = re.match(r'"?([^"<]+)"?\s*<', sender)
    subject = str(message.get("subject", "")) or None
    own_id = str(message.get("message-id", "")).strip().strip("<>")
    address = inside.group(1).strip() if inside else sender.strip() if "@" in sender else None
    try:
        when = email.utils.parsedate_to_datetime(str(message.get("date", "")))
        when = (when if when.tzinfo else when.replace(tzinfo=dt.UTC)).astimezone(dt.UTC).replace(tzinfo=None)
    except (TypeError, ValueError):
        when = None  # the reader fills in the time of reading
    html = _part(message, "text/html")
    return {
        "url": f"email://msg-id/{own_id}" if own_id else f"email://{address or 'unknown'}/{subject or 'untitled'}",
        "title": subject, "html_markdown": re.sub(r"(?m)^#\s+.+\n*", "", to_markdown(html), count=1) if html else None, "plain": _part(message, "text/plain"),
        "author": (name.group(1).strip() if name else sender.strip()) or None, "sender_email": address, "captured_at": when,
        "list_id": str(message["list-id"]) if message.get("list-id") else None, "return_path": str(message["return-path"]) if message.get("return-path") else None, "from_header": sender, "error": None,
    }


@F.pandas_udf(struct_type(PARSED))
def message(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Raw messages as structs; what cannot be read has only ``error``."""
    names = [c.split()[0] for c in PARSED.split(", ")]
    for values in batches:
        rows = []
        for raw in values:
            try:
                rows.append(parse_message(bytes(raw)))
            except Exception as error:  # one broken message must not fail a batch
                rows.append({"error": str(error)[:200]})
        yield pd.DataFrame(rows, columns=names).assign(captured_at=lambda d: pd.to_datetime(d["captured_at"]))
