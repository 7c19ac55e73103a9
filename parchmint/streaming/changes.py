"""Streams of changes, and what follows them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parchmint.operators.documents import latest_changes
from parchmint.schemas import CHANGES


def change_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """The change log of a folder of Parquet files as a stream."""
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def follow(stream: DataFrame, sinks: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, available_now: bool = True, on_error: Callable[[str, Exception], None] | None = None) -> StreamingQuery:
    """Give each batch's last change of every id to all sinks; one sink's failure does not keep the others from theirs.

    Without ``on_error`` the first failure is raised after all sinks ran, so the batch is repeated;
    sinks must therefore bear repetition, as replacing a document's rows does.
    """

    def batch(changes: DataFrame, number: int) -> None:
        last = latest_changes(changes).persist()
        failed: list[tuple[str, Exception]] = []
        try:
            for name, sink in sinks.items():
                try:
                    sink(last, number)
                except Exception as error:  # isolated by contract
                    failed.append((name, error))
        finally:
            last.unpersist()
        for name, error in failed:
            if on_error is None:
                raise error
            on_error(name, error)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()


def debounced_stream(events: DataFrame, key: str = "path", seconds: float = 1.5, lateness: str = "10 seconds") -> DataFrame:
    """(key, kind, started_at, ended_at): the last action of each quiet-bounded run of events of a key, once the watermark passed it."""
    rows = events.withWatermark("occurred_at", lateness)
    gap = F.session_window("occurred_at", f"{int(seconds * 1000)} milliseconds")
    runs = rows.groupBy(key, gap).agg(F.max_by("kind", "occurred_at").alias("kind"), F.min("occurred_at").alias("started_at"), F.max("occurred_at").alias("ended_at"))
    return runs.select(key, "kind", "started_at", "ended_at")


def once_per_source(captures: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """A stream of captures without repetitions of a source within ``lateness``; the write's own join decides for good."""
    return captures.withWatermark("captured_at", lateness).dropDuplicatesWithinWatermark(["url"])


def sessions(events: DataFrame, key: str, at: str, gap: str = "30 minutes") -> DataFrame:
    """(key, started_at, ended_at, n) of runs of events with smaller gaps; batch or stream."""
    w = F.session_window(at, gap)
    return events.groupBy(key, w).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("started_at"), F.col("session_window.end").alias("ended_at"), "n")


def tumbling(events: DataFrame, at: str, width: str, *keys: str) -> DataFrame:
    """(keys, started_at, n) of events in windows of one width; batch or stream."""
    w = F.window(at, width)
    return events.groupBy(*keys, w).agg(F.count("*").alias("n")).select(*keys, F.col("window.start").alias("started_at"), "n")
