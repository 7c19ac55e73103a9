"""Raw mail messages as captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.functions import text
from parchmint.functions.mail import message


def read_messages(spark: SparkSession, folder: str, pattern: str = "*.eml") -> DataFrame:
    """(path, raw) of the message files of a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", F.col("content").alias("raw"))


def captures_of(messages: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Messages as captures, with the headers that the newsletter rules read.

    HTML is preferred; where nothing of it remains after cleaning, the plain text is taken. A
    message without a readable date has the time of reading; one that cannot be read has ``error``.
    """
    m = messages.withColumn("m", message(raw_col))
    cleaned = F.coalesce(text.clean_newsletter(F.col("m.html_markdown")), F.lit(""))
    body = F.when(cleaned != "", cleaned).otherwise(F.coalesce(text.clean_newsletter(F.col("m.plain")), F.lit("")))
    return m.select(
        *[F.col(c) for c in messages.columns if c != raw_col],
        F.col("m.url").alias("url"), F.coalesce("m.title", F.lit("Untitled")).alias("title"), body.alias("content_markdown"), F.lit("newsletter").alias("content_type"),
        F.col("m.author").alias("author"), F.col("m.sender_email").alias("sender_email"), F.coalesce("m.captured_at", F.current_timestamp()).alias("captured_at"), F.array().cast("array<string>").alias("tags"),
        F.col("m.list_id").alias("list_id"), F.col("m.return_path").alias("return_path"), F.col("m.from_header").alias("from_header"), F.col("m.plain").alias("plain"), F.col("m.error").alias("error"),
    )


def search_criterion(since: str | None = None, raw: str | None = None) -> str:
    """What a mail server is asked for: a raw criterion, or unseen messages, from a day on (ISO date)."""
    if raw:
        return raw
    if not since:
        return "UNSEEN"
    import datetime as dt

    day = dt.date.fromisoformat(since)
    months = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
    return f"UNSEEN SINCE {day.day:02d}-{months[day.month - 1]}-{day.year}"
