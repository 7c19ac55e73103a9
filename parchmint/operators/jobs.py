"""The queue of capture jobs as a table: queued, running, done or failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An error's text is kept up to this length.
ERROR_LENGTH = 2000


#: Workers, seconds a job may take, seconds between looks at an empty queue, and seconds to finish in after a stop; with their bounds.
WORKERS, TIMEOUT, IDLE, GRACE = (1, 1, 8), (90, 10, 600), 1.0, 25.0


def clamped(value: int | None, bounds: tuple[int, int, int]) -> int:
    """A setting within its bounds, or its default."""
    default, least, most = bounds
    return default if value is None else max(least, min(most, value))


def enqueue(jobs: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """The queue with new jobs (id, url, persist, frontmatter, html, fallback_title); an id that is there already is left alone."""
    value = {"status": F.lit("queued"), "created_at": now, "attempts": F.lit(0)}
    fresh = wanted.dropDuplicates(["id"]).join(jobs.select("id"), "id", "left_anti")
    given = [F.col(c) if c in wanted.columns else value.get(c, F.lit(None)) for c in jobs.columns]
    return jobs.unionByName(fresh.select(*[g.cast(jobs.schema[c].dataType).alias(c) for g, c in zip(given, jobs.columns)]))


def expired(jobs: DataFrame, now: Column, timeout: int | None = None) -> DataFrame:
    """The queue after jobs that ran longer than ``timeout`` seconds, 90 unless said, failed."""
    seconds = clamped(timeout, TIMEOUT)
    late = (F.col("status") == "running") & (F.col("started_at") < now - F.make_dt_interval(secs=F.lit(float(seconds))))
    changed = {"error": F.when(late, F.lit(f"timed out after {seconds} s")).otherwise(F.col("error")), "completed_at": F.when(late, now).otherwise(F.col("completed_at")), "status": F.when(late, "failed").otherwise(F.col("status"))}
    return jobs.withColumns(changed)


def claimable(jobs: DataFrame, n: int) -> DataFrame:
    """The ``n`` queued jobs that are next, oldest first, ties by id."""
    return jobs.where("status = 'queued'").orderBy("created_at", "id").limit(n)


def claim(jobs: DataFrame, n: int, now: Column) -> DataFrame:
    """The queue after its next ``n`` jobs began to run."""
    taken = claimable(jobs, n).select("id", F.lit(True).alias("taken"))
    met = jobs.join(F.broadcast(taken), "id", "left")
    hit = F.coalesce("taken", F.lit(False))
    changed = {"status": F.when(hit, "running").otherwise(F.col("status")), "started_at": F.when(hit, now).otherwise(F.col("started_at")), "attempts": F.col("attempts") + hit.cast("int")}
    return met.withColumns(changed).drop("taken")


def finish(jobs: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """The queue after results (id, doc_id, doc_path, body_hash, error): an error fails the job, none completes it."""
    r = results.select("id", *[F.col(c).alias(f"r_{c}") for c in ("doc_id", "doc_path", "body_hash", "error")], F.lit(True).alias("hit"))
    met = jobs.join(r, "id", "left")
    hit = F.coalesce("hit", F.lit(False)) & (F.col("status") == "running")
    value = lambda new, old: F.when(hit, new).otherwise(F.col(old))
    changed = {c: value(F.col(f"r_{c}"), c) for c in ("doc_id", "doc_path", "body_hash")}
    changed |= {"error": value(F.substring("r_error", 1, ERROR_LENGTH), "error"), "completed_at": value(now, "completed_at"), "status": value(F.when(F.col("r_error").isNull(), "done").otherwise("failed"), "status")}
    return met.withColumns(changed).select(*jobs.columns)


def recovered(jobs: DataFrame) -> DataFrame:
    """The queue after a restart: what ran is queued again."""
    return jobs.withColumn("status", F.when(F.col("status") == "running", "queued").otherwise(F.col("status")))


def depth(jobs: DataFrame) -> DataFrame:
    """(queue_depth): the number of queued jobs."""
    return jobs.agg(F.count_if(F.col("status") == "queued").alias("queue_depth"))


def listed(jobs: DataFrame, status: str | None = None, limit: int = 50) -> DataFrame:
    """The newest jobs, without their markup."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be from 1 to 200")
    rows = jobs if status is None else jobs.where(F.col("status") == status)
    return rows.drop("html").orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
