"""Videos and posts: transcripts, speech recognition and what stands in for them, behind interfaces that are passed in."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Order of languages in which a transcript is taken, the longest sound and the largest file that is transcribed.
LANGUAGES = ["en", "en-US", "en-GB", "de", "fr", "es"]
MOST_SECONDS, MOST_BYTES = 3600, 25 * 2**20
NO_TEXT = "*No text could be extracted. Open the original to see it.*"


class Transcripts(Protocol):
    """Gets a video's metadata (title, author, seconds) and its captions by language."""

    def metadata(self, url: str) -> dict: ...

    def captions(self, url: str) -> dict[str, str]: ...


class Recogniser(Protocol):
    """Gets a video's sound and turns it into text."""

    def size(self, url: str) -> int: ...

    def transcribe(self, url: str) -> str: ...


@dataclass
class NoTranscript(Exception):
    """A video without a usable transcript, with what is known of it."""

    reason: str
    title: str | None = None
    author: str | None = None


def preferred(captions: dict[str, str], languages: list[str] | None = None) -> str | None:
    """The captions of the first preferred language, else of the first there is; none if all are blank."""
    held = {k: v for k, v in captions.items() if v and v.strip()}
    for language in languages or LANGUAGES:
        if language in held:
            return held[language]
    return next(iter(held.values()), None)


def may_transcribe(seconds: float | None, n_bytes: int | None) -> str | None:
    """Why sound is not transcribed: too long, too large, or empty; null if it is."""
    if seconds is not None and seconds > MOST_SECONDS:
        return "too long"
    if n_bytes is not None and n_bytes > MOST_BYTES:
        return "too large"
    return "empty" if n_bytes == 0 else None


def transcript_of(url: str, source: Transcripts, recogniser: Recogniser | None = None, languages: list[str] | None = None) -> tuple[str, str, dict]:
    """(text, how, metadata) of a video: its captions, else recognised speech; else an error with the metadata that was got."""
    try:
        meta = source.metadata(url) or {}
    except Exception as error:
        raise NoTranscript(f"metadata: {error}") from error
    known = {"title": meta.get("title"), "author": meta.get("author")}
    try:
        found = preferred(source.captions(url), languages)
    except Exception:  # no captions is the usual case
        found = None
    if found:
        return found, "captions", meta
    if recogniser is None:
        raise NoTranscript("no captions", **known)
    try:
        reason = may_transcribe(meta.get("seconds"), recogniser.size(url))
        text = None if reason else recogniser.transcribe(url)
    except Exception as error:
        raise NoTranscript(f"recognition: {error}", **known) from error
    if not text or not text.strip():
        raise NoTranscript(reason or "no speech", **known)
    return text, "speech", meta


def transcribed(videos: DataFrame, source: Transcripts, recogniser: Recogniser | None = None, url_col: str = "url") -> DataFrame:
    """``videos`` with ``transcript``, ``how`` (captions, speech; null), ``video_title``, ``video_author`` and ``transcript_error``, in the workers."""
    names = videos.columns
    at = names.index(url_col)
    added = ["transcript", "how", "video_title", "video_author", "transcript_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url in batch.column(at).to_pylist():
                try:
                    text, how, meta = transcript_of(url, source, recogniser)
                    rows.append((text, how, meta.get("title"), meta.get("author"), None))
                except NoTranscript as e:  # what is known stays
                    rows.append((None, None, e.title, e.author, e.reason[:2000]))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[k] for r in rows], pa.string()) for k in range(5))], [*names, *added])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in videos.schema.fields)
    return videos.mapInArrow(run, f"{fields}, " + ", ".join(f"{c} string" for c in added))


def meta_stub(author: Column, description: Column) -> Column:
    """What stands for a post without text: a line for its author, and its description or a fixed hint."""
    line = F.when(F.coalesce(F.trim(author), F.lit("")) != "", F.concat(F.lit("**"), F.trim(author), F.lit("**")))
    said = F.trim(F.coalesce(description, F.lit("")))
    return F.concat_ws("\n\n", line, F.when(said != "", said).otherwise(F.lit(NO_TEXT)))


def post_text(captions: Column, speech: Column, author: Column, description: Column) -> tuple[Column, Column]:
    """(text, how) of a post with a video: captions, else speech, else the stub of its metadata."""
    said = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    how = F.when(said(captions).isNotNull(), "captions").when(said(speech).isNotNull(), "speech").otherwise("meta")
    return F.coalesce(said(captions), said(speech), meta_stub(author, description)), how
