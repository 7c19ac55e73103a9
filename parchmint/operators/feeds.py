"""Feeds: what is new in them, what became of it, and the registry of feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmint.staging import staged


def preview(entries: DataFrame, docs: DataFrame, limit: int | None = None) -> DataFrame:
    """Entries (url, pos, ...) with ``status`` new or skip and the ``doc_id`` that has the source already.

    With a limit, only the first entries of a feed's order are looked at.
    """
    rows = entries if limit is None else entries.where(F.col("pos") < limit)
    known = docs.where("source is not null").groupBy(F.col("source").alias("url")).agg(F.min("id").alias("doc_id"))
    return rows.join(known, "url", "left").withColumn("status", F.when(F.col("doc_id").isNull(), "new").otherwise("skip"))


def new_entries(entries: DataFrame, docs: DataFrame) -> DataFrame:
    """Entries whose address no document has as its source."""
    return entries.join(docs.where("source is not null").select(F.col("source").alias("url")), "url", "left_anti")


def seen_entries(entries: DataFrame, docs: DataFrame) -> DataFrame:
    return entries.join(docs.where("source is not null").select(F.col("source").alias("url")), "url", "left_semi")


def sync_report(results: DataFrame) -> DataFrame:
    """(feed_id, captured, skipped, failed, status) of entry results (feed_id, outcome): failed only if nothing was captured and something failed."""
    counts = results.groupBy("feed_id").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("captured", "skipped", "failed")])
    return counts.withColumn("status", F.when((F.col("failed") > 0) & (F.col("captured") == 0), "failed").otherwise("ok"))


def entry_writes(entries: DataFrame, feeds: DataFrame, extracted: DataFrame) -> DataFrame:
    """Writes (seq, body, title, source, content_type, captured_at, tags, extra) of feed entries whose pages were extracted.

    ``entries`` (feed_id, pos, url, title, author, published_at, is_video), ``extracted`` (url, title, content_markdown,
    content_type, author, refused). The entry's title and author stand in for missing ones, tags are the feed's,
    the time of capture is that of publication.
    """
    of_feed = feeds.select(F.col("id").alias("feed_id"), F.col("tags").alias("feed_tags"), F.col("name").alias("feed_name"))
    page = extracted.select("url", F.col("title").alias("p_title"), "content_markdown", F.col("content_type").alias("p_type"), F.col("author").alias("p_author"), "refused")
    met = entries.join(page, "url").join(F.broadcast(of_feed), "feed_id", "left").where(~F.coalesce("refused", F.lit(False)) & F.col("content_markdown").isNotNull())
    author = F.coalesce(F.nullif("p_author", F.lit("")), F.nullif("author", F.lit("")), "feed_name")
    extra = F.map_filter(F.create_map(F.lit("feed_id"), F.col("feed_id"), F.lit("author"), author), lambda k, v: v.isNotNull())
    return met.select(
        F.col("pos").cast("bigint").alias("seq"), F.col("content_markdown").alias("body"), F.coalesce(F.nullif("p_title", F.lit("")), "title").alias("title"), F.col("url").alias("source"),
        F.coalesce("p_type", F.when(F.col("is_video"), "video").otherwise("article")).alias("content_type"), F.col("published_at").alias("captured_at"), F.col("feed_tags").alias("tags"), extra.alias("extra"),
    )


def sync(feeds: DataFrame, entries: DataFrame, docs: DataFrame, extract, write, now: Column, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """One sync of all enabled feeds: (registry, report).

    ``entries`` are those of the feeds that could be read; ``extract`` takes new entries and returns their pages (url, title,
    content_markdown, content_type, author, refused), ``write`` takes writes. A page that is missing or refused fails its
    entry only; a feed without entries is ok with nothing captured. The report is that of :func:`sync_report` for every enabled feed, with an ``error``.
    """
    active = due(feeds).select(F.col("id").alias("feed_id"))
    seen = staged(preview(entries.join(active, "feed_id", "left_semi"), docs, limit), "preview")
    fresh = seen.where("status = 'new'").drop("status", "doc_id")
    got = staged(extract(fresh), "extracted")
    writes = staged(entry_writes(fresh, feeds, got), "entry_writes")
    write(writes)
    done = writes.select(F.col("source").alias("url"), F.lit(True).alias("done")).distinct()
    outcome = F.when(F.col("status") == "skip", "skipped").when(F.col("done"), "captured").otherwise("failed")
    results = seen.join(done, "url", "left").select("feed_id", outcome.alias("outcome"))
    report = active.join(sync_report(results), "feed_id", "left").select(
        "feed_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("captured", "skipped", "failed")], F.coalesce("status", F.lit("ok")).alias("status")
    )
    report = staged(report.withColumn("error", F.when(F.col("status") == "failed", F.concat(F.col("failed").cast("string"), F.lit(" entries failed")))), "report")
    return synced(feeds, report, now), report


def register(feeds: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """The registry after registering (id, url, name, tags): one row an address, tags united and sorted, a name only replaced by one."""
    asked = wanted.groupBy("url").agg(F.min("id").alias("new_id"), F.max("name").alias("new_name"), F.flatten(F.collect_list(F.coalesce("tags", F.array().cast("array<string>")))).alias("new_tags"))
    met = feeds.join(asked, "url", "full_outer")
    none = F.array().cast("array<string>")
    return met.select(
        F.coalesce("id", "new_id").alias("id"), "url", F.coalesce("new_name", "name").alias("name"),
        F.when(F.col("new_tags").isNull(), F.col("tags")).otherwise(F.array_sort(F.array_union(F.coalesce("tags", none), F.coalesce("new_tags", none)))).alias("tags"),
        F.coalesce("enabled", F.lit(True)).alias("enabled"), F.coalesce("created_at", now).alias("created_at"), "last_sync_at", "last_status", "last_error",
    )


def set_enabled(feeds: DataFrame, feed_id: str, enabled: bool) -> DataFrame:
    return feeds.withColumn("enabled", F.when(F.col("id") == feed_id, F.lit(enabled)).otherwise(F.col("enabled")))


def removed(feeds: DataFrame, feed_id: str) -> DataFrame:
    return feeds.where(F.col("id") != feed_id)


def synced(feeds: DataFrame, reports: DataFrame, now: Column) -> DataFrame:
    """The registry after a sync: time, status and error of the feeds in ``reports`` (feed_id, status, error)."""
    r = reports.select(F.col("feed_id").alias("id"), F.col("status").alias("new_status"), F.col("error").alias("new_error"))
    met = feeds.join(F.broadcast(r), "id", "left")
    hit = F.col("new_status").isNotNull()
    return met.withColumns({"last_sync_at": F.when(hit, now).otherwise(F.col("last_sync_at")), "last_status": F.when(hit, F.col("new_status")).otherwise(F.col("last_status")), "last_error": F.when(hit, F.col("new_error")).otherwise(F.col("last_error"))}).drop("new_status", "new_error")


def due(feeds: DataFrame) -> DataFrame:
    """Enabled feeds, oldest registration first."""
    return feeds.where("enabled").orderBy("created_at", "id")
