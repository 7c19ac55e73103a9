"""The document table: idempotent writes, a change log, pages of a listing, integrity.

Plain tables have no row updates, so a write is a function from the current snapshot and a batch of
requests to the next snapshot and the changes; the caller writes both. A batch may hold several
requests for one source: they apply in their order, as if sent one after the other, without a loop
over rows.
"""

from __future__ import annotations

import base64
import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchmint.functions import hashing, text
from parchmint.schemas import RESERVED
from parchmint.staging import staged


class StoreError(ValueError):
    """A request that cannot be served."""


class NotFound(StoreError):
    """No such document."""


def _hashed(df: DataFrame) -> DataFrame:
    body = hashing.ended(F.col("body"))
    with_body = df.withColumn("body", body).withColumn("body_hash", hashing.digest(F.col("body")))
    return with_body.withColumn("content_hash", hashing.content_hash(*[F.col(c) for c in ("title", "source", "content_type", "captured_at", "tags", "extra", "body")]))


COLUMNS = ["id", "path", "title", "source", "content_type", "captured_at", "updated_at", "tags", "extra", "content_hash", "body_hash", "body"]


@dataclass(frozen=True)
class Written:
    """The next snapshot, and the changes (kind, id, path, content_hash, occurred_at) that led to it."""

    docs: DataFrame
    changes: DataFrame
    conflicts: DataFrame | None = None


def merged_extra(*maps: Column) -> Column:
    """Maps joined, later entries first in rank; reserved keys left out."""
    none = F.create_map().cast("map<string,string>")
    joined = F.map_concat(*[F.coalesce(m, none) for m in maps])
    return F.map_filter(joined, lambda k, v: ~k.isin(RESERVED))


def create(docs: DataFrame, writes: DataFrame, now: Column) -> Written:
    """Apply writes (:data:`parchmint.schemas.WRITES`) to docs with bodies.

    A write without a source is a new document. The first write of a new source creates, later
    ones with another body update: the last body and metadata count, id, path and time of capture
    stay the first's. A write whose body is the document's is no change, and a batch that ends
    where it began is none. If several documents have one source, the smallest id is the one.
    """
    spark_now = F.date_trunc("second", now)
    rows = writes.withColumn("body", hashing.ended(F.coalesce("body", F.lit(""))))
    sourced = rows.where("source is not null")
    # Aggregates, not a window: maps combine them first, so a source with a tenth of all rows is one row a map task.
    # The values of keys that a later write leaves out stay those of an earlier one.
    given = lambda c: F.when(F.col(c).isNotNull(), F.col("seq"))
    folded = sourced.groupBy("source").agg(
        F.min("seq").alias("seq"), F.max_by("body", "seq").alias("body"), F.min_by("captured_at", given("captured_at")).alias("captured_at"),
        *[F.max_by(c, given(c)).alias(c) for c in ("title", "content_type", "tags", "extra")],
    )
    current = docs.where("source is not null").groupBy("source").agg(F.min_by(F.struct(*COLUMNS), "id").alias("old"))
    met = folded.join(current, "source", "left")
    loose = rows.where("source is null").select("source", "seq", "body", "captured_at", "title", "content_type", "tags", "extra").withColumn("old", F.lit(None).cast(current.schema["old"].dataType))
    met = met.unionByName(loose, allowMissingColumns=True)
    captured = F.date_trunc("second", F.coalesce(F.col("old.captured_at"), "captured_at", spark_now))
    new_id = hashing.ulid(captured, F.col("seq"), F.col("source"), F.col("body"))
    row = met.select(
        F.coalesce(F.col("old.id"), new_id).alias("id"),
        F.col("old").isNotNull().alias("known"),
        F.col("old.body_hash").alias("old_hash"),
        F.col("old.path").alias("path"),
        F.coalesce("title", F.col("old.title")).alias("title"),
        "source",
        F.coalesce("content_type", F.col("old.content_type")).alias("content_type"),
        captured.alias("captured_at"),
        spark_now.alias("updated_at"),
        F.coalesce("tags", F.col("old.tags")).alias("tags"),
        merged_extra(F.col("old.extra"), F.col("extra")).alias("extra"),
        "body",
    )
    row = _hashed(row).withColumn("path", F.coalesce("path", hashing.doc_path(F.col("id"), F.col("captured_at"), text.slug(F.col("title")))))
    row = staged(row.where(~F.col("known") | ~F.col("old_hash").eqNullSafe(F.col("body_hash"))), "written")
    kind = F.when(F.col("known"), "updated").otherwise("created")
    changes = row.select(kind.alias("kind"), "id", "path", "content_hash", F.col("updated_at").alias("occurred_at"))
    kept = docs.select(*COLUMNS).join(row.select("id"), "id", "left_anti")
    return Written(kept.unionByName(row.select(*COLUMNS)), changes)


def update(docs: DataFrame, writes: DataFrame, now: Column) -> Written:
    """Replace bodies by id: ``writes`` has id, body, if_match and optional title, source, content_type, tags, extra.

    ``if_match`` (null: none) must be the content hash; what it is not is returned as conflicts with
    a reason, as are unknown ids. Metadata that a write leaves out stay; id, path and time of
    capture always do. At most one write an id.
    """
    given = {c: F.col(c) if c in writes.columns else F.lit(None) for c in ("title", "source", "content_type", "tags", "extra")}
    asked = writes.select("id", F.col("body").alias("new_body"), "if_match", *[c.cast(docs.schema[n].dataType).alias(f"new_{n}") for n, c in given.items()])
    met = asked.join(docs.select(*COLUMNS), "id", "left")
    reason = F.when(F.col("path").isNull(), "not found").when(F.col("if_match").isNotNull() & (F.col("if_match") != F.col("content_hash")), "conflict")
    met = met.withColumn("reason", reason)
    conflicts = met.where("reason is not null").select("id", "reason")
    row = met.where("reason is null").select(
        "id", "path", *[F.coalesce(f"new_{c}", c).alias(c) for c in ("title", "source", "content_type")], "captured_at",
        F.date_trunc("second", now).alias("updated_at"), F.coalesce("new_tags", "tags").alias("tags"), merged_extra(F.col("extra"), F.col("new_extra")).alias("extra"), F.col("new_body").alias("body"),
    )
    row = staged(_hashed(row), "written")
    changes = row.select(F.lit("updated").alias("kind"), "id", "path", "content_hash", F.col("updated_at").alias("occurred_at"))
    return Written(docs.select(*COLUMNS).join(row.select("id"), "id", "left_anti").unionByName(row.select(*COLUMNS)), changes, conflicts)


def upsert(docs: DataFrame, writes: DataFrame, now: Column) -> Written:
    """Update by id, or create under the caller's id: ``writes`` has id, body, if_match and optional title, source, content_type, tags, extra.

    Conflicts, with a reason: an id that is no ULID ("bad id"), an ``if_match`` that is not the document's hash, or any
    ``if_match`` on a document that does not exist ("conflict"). At most one write an id.
    """
    asked = writes.withColumn("_good", F.coalesce(hashing.is_ulid(F.col("id")), F.lit(False)))
    known = docs.select("id", F.lit(True).alias("_known"))
    met = asked.join(known, "id", "left")
    bad = met.where(~F.col("_good")).select("id", F.lit("bad id").alias("reason"))
    lost = met.where(F.col("_good") & F.col("_known").isNull() & F.col("if_match").isNotNull()).select("id", F.lit("conflict").alias("reason"))
    old = update(docs, met.where(F.col("_good") & F.col("_known")).drop("_good", "_known"), now)
    fresh = met.where(F.col("_good") & F.col("_known").isNull() & F.col("if_match").isNull())
    value = lambda c, kind: (F.col(c) if c in writes.columns else F.lit(None)).cast(kind).alias(c)
    at = F.date_trunc("second", now)
    row = fresh.select(
        "id", value("title", "string"), value("source", "string"), value("content_type", "string"), at.alias("captured_at"), at.alias("updated_at"),
        value("tags", "array<string>"), merged_extra(F.col("extra") if "extra" in writes.columns else F.lit(None).cast("map<string,string>")).alias("extra"), F.coalesce("body", F.lit("")).alias("body"),
    )
    row = staged(_hashed(row).withColumn("path", hashing.doc_path(F.col("id"), F.col("captured_at"), text.slug(F.col("title")))), "created")
    changes = row.select(F.lit("created").alias("kind"), "id", "path", "content_hash", F.col("updated_at").alias("occurred_at"))
    return Written(old.docs.unionByName(row.select(*COLUMNS)), old.changes.unionByName(changes), old.conflicts.unionByName(bad).unionByName(lost))


def delete(docs: DataFrame, asked: DataFrame, now: Column) -> Written:
    """Remove by id (and if_match, null: none); a deletion's change has neither path nor hash."""
    met = asked.select("id", "if_match").join(docs.select("id", "content_hash"), "id", "left")
    reason = F.when(F.col("content_hash").isNull(), "not found").when(F.col("if_match").isNotNull() & (F.col("if_match") != F.col("content_hash")), "conflict")
    met = staged(met.withColumn("reason", reason), "deleted")
    gone = met.where("reason is null").select("id")
    changes = gone.select(F.lit("deleted").alias("kind"), "id", F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("content_hash"), F.date_trunc("second", now).alias("occurred_at"))
    return Written(docs.join(gone, "id", "left_anti"), changes, met.where("reason is not null").select("id", "reason"))


def get(docs: DataFrame, doc_id: str):
    """The row of an id."""
    if not doc_id or len(doc_id) != 26:
        raise NotFound(doc_id)
    row = docs.where(F.col("id") == doc_id).first()
    if row is None:
        raise NotFound(doc_id)
    return row


def find_by_source(docs: DataFrame, source: str) -> DataFrame:
    """The document of a source: at most one row, the smallest id."""
    return docs.where(F.col("source") == source).orderBy("id").limit(1)


# Listing -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Page:
    """Rows of a listing and the cursor of the next page, null at the end."""

    items: list
    cursor: str | None


def encode_cursor(at: dt.datetime, doc_id: str) -> str:
    return base64.urlsafe_b64encode(f"{at.strftime('%Y-%m-%dT%H:%M:%SZ')}|{doc_id}".encode()).decode()


def decode_cursor(cursor: str) -> tuple[dt.datetime, str]:
    try:
        stamp, doc_id = base64.urlsafe_b64decode(cursor.encode()).decode().split("|", 1)
        return dt.datetime.strptime(stamp, "%Y-%m-%dT%H:%M:%SZ"), doc_id
    except Exception:
        raise StoreError(f"bad cursor {cursor!r}") from None


def newest(docs: DataFrame, order: str = "updated_at", since: Column | None = None, after: tuple[Column, Column] | None = None) -> DataFrame:
    """Documents updated at ``since`` or later, newest first by ``order``, beyond the pair ``after``; ties by id, larger first."""
    if order not in ("updated_at", "captured_at"):
        raise StoreError(f"unknown order {order!r}")
    rows = docs
    if since is not None:
        rows = rows.where(F.col("updated_at") >= F.date_trunc("second", since))
    if after is not None:
        at, doc_id = after
        rows = rows.where((F.col(order) < at) | ((F.col(order) == at) & (F.col("id") < doc_id)))
    return rows.orderBy(F.desc(order), F.desc("id"))


def list_docs(docs: DataFrame, order: str = "updated_at", since: dt.datetime | None = None, cursor: str | None = None, limit: int = 100) -> Page:
    """One page of a listing, by keyset: one ordered take of ``limit`` + 1 rows."""
    if not 1 <= limit <= 500:
        raise StoreError("limit must be from 1 to 500")
    after = None
    if cursor:
        at, doc_id = decode_cursor(cursor)
        after = (F.lit(at), F.lit(doc_id))
    rows = newest(docs, order, None if since is None else F.lit(since), after).limit(limit + 1).collect()
    more = len(rows) > limit
    return Page(rows[:limit], encode_cursor(rows[limit - 1][order], rows[limit - 1]["id"]) if more else None)


def by_prefix(docs: DataFrame, prefix: str, newest_only: int = 500) -> DataFrame:
    """Documents among the newest 500 whose id begins with ``prefix``, whatever its case."""
    return newest(docs).limit(newest_only).where(F.col("id").startswith(prefix.upper()))


def ids(docs: DataFrame, source_prefix: str | None = None) -> DataFrame:
    """(id) of all documents, or of those whose source begins with ``source_prefix``."""
    return (docs if source_prefix is None else docs.where(F.col("source").startswith(source_prefix))).select("id")


def ids_of_paths(paths: DataFrame, docs: DataFrame) -> DataFrame:
    """(path, id): which documents the paths of deleted files were; unknown paths are left out."""
    return paths.select("path").distinct().join(docs.select("path", "id"), "path")


def sample(rows: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """``n`` rows, the same for one seed: those of the smallest hashes, ties by key."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def response(docs: DataFrame) -> DataFrame:
    """Documents under both sets of names that clients use."""
    return docs.select("*", F.col("content_type").alias("type"), F.col("captured_at").alias("captured"), F.col("updated_at").alias("updated"))


# Upkeep --------------------------------------------------------------------------------------------


def duplicate_sources(docs: DataFrame) -> DataFrame:
    """(source, keep_id, n): sources of several documents, and the smallest id, which stays."""
    return docs.where("source is not null").groupBy("source").agg(F.min("id").alias("keep_id"), F.count("*").alias("n")).where("n > 1")


def duplicate_totals(docs: DataFrame) -> DataFrame:
    """(n_docs, n_sources, n_repeated, n_extra): documents with a source, their sources, sources of several, and documents beyond each source's first."""
    per = docs.where("source is not null").groupBy("source").agg(F.count("*").alias("n"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return per.agg(total("n").alias("n_docs"), F.count("*").alias("n_sources"), F.count_if(F.col("n") > 1).alias("n_repeated"), total(F.col("n") - 1).alias("n_extra"))


def without_duplicates(docs: DataFrame) -> DataFrame:
    """Documents without the later ones of their source."""
    dup = duplicate_sources(docs)
    return docs.join(dup.select("source", "keep_id"), "source", "left").where("keep_id is null or id = keep_id").drop("keep_id")


def stats(docs: DataFrame, size: Column) -> DataFrame:
    """(n_docs, n_bytes, oldest_at, newest_at) of a vault."""
    return docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(size), F.lit(0)).alias("n_bytes"), F.min("captured_at").alias("oldest_at"), F.max("updated_at").alias("newest_at"))


def integrity(docs: DataFrame, pointers: DataFrame) -> DataFrame:
    """Counts of faults: documents without id, with a malformed id, without pointer, whose path lacks the id, whose hash is not the body's.

    ``docs`` has bodies; ``pointers`` is (id, path).
    """
    met = docs.join(pointers.select(F.col("id").alias("p_id"), F.col("path").alias("p_path")).dropDuplicates(["p_id"]), F.col("id") == F.col("p_id"), "left")
    return met.agg(
        F.count("*").alias("n_docs"),
        F.count_if(F.col("id").isNull()).alias("no_id"),
        F.count_if(~hashing.is_ulid(F.col("id"))).alias("bad_id"),
        F.count_if(F.col("id").isNotNull() & F.col("p_id").isNull()).alias("no_pointer"),
        F.count_if(F.col("p_path") != F.col("path")).alias("wrong_pointer"),
        F.count_if(F.col("body").isNotNull() & (hashing.body_hash(F.col("body")) != F.col("body_hash"))).alias("wrong_hash"),
    )


def asset_names(assets: DataFrame) -> DataFrame:
    """(doc_id, seq, name, stored): safe names; the second and later of one name get -1, -2 and so on."""
    safe = assets.withColumn("safe", text.safe_asset_name(F.col("name")))
    n = F.row_number().over(Window.partitionBy("doc_id", "safe").orderBy("seq")) - 1
    stem, suffix = F.regexp_replace("safe", r"\.[^.]*$", ""), F.regexp_extract("safe", r"(\.[^.]*)$", 1)
    return safe.withColumn("n", n).select("doc_id", "seq", "name", F.when(F.col("n") == 0, F.col("safe")).otherwise(F.concat(stem, F.lit("-"), F.col("n").cast("string"), suffix)).alias("stored"))


#: Largest asset in bytes, and the reasons why one is not kept.
ASSET_LIMIT = 25 * 2**20


def add_assets(docs: DataFrame, assets: DataFrame, wanted: DataFrame, limit: int = ASSET_LIMIT) -> tuple[DataFrame, DataFrame]:
    """The asset table (doc_id, name, content, n_bytes) after ``wanted`` (doc_id, seq, name, content), and what was refused (doc_id, seq, reason).

    Names are made safe; one that the document has already, here or from before, gets the next free number. Refused
    are assets of unknown documents and of more than ``limit`` bytes.
    """
    met = wanted.join(docs.select(F.col("id").alias("doc_id"), F.lit(True).alias("known")), "doc_id", "left").withColumn("n_bytes", F.octet_length("content"))
    reason = F.when(F.col("known").isNull(), "not found").when(F.col("n_bytes") > limit, "too large")
    met = staged(met.withColumn("reason", reason), "assets")
    old = assets.select("doc_id", F.lit(None).cast("bigint").alias("seq"), "name", F.lit(0).alias("turn"))
    new = met.where("reason is null").select("doc_id", F.col("seq").cast("bigint").alias("seq"), "name", F.lit(1).alias("turn"))
    # Old names keep their place: they come first and are numbered as they are stored.
    safe = old.unionByName(new).withColumn("safe", text.safe_asset_name(F.col("name")))
    stem, suffix = F.regexp_replace("safe", r"\.[^.]*$", ""), F.regexp_extract("safe", r"(\.[^.]*)$", 1)
    base = F.when(F.col("turn") == 0, F.concat(F.regexp_replace(stem, r"-\d+$", ""), suffix)).otherwise(F.col("safe"))
    number = F.when(F.col("turn") == 0, F.coalesce(F.expr("try_cast(nullif(regexp_extract(safe, '-([0-9]+)([.][^.]*)?$', 1), '') as int)"), F.lit(0)))
    last = F.max("number").over(Window.partitionBy("doc_id", "base"))
    turn = F.row_number().over(Window.partitionBy("doc_id", "base", "turn").orderBy("seq", "name")) - 1
    taken = safe.withColumn("base", base).withColumn("number", number).withColumns({"last": last, "r": turn}).where("turn = 1").withColumn("k", F.coalesce(F.col("last") + 1, F.lit(0)) + F.col("r"))
    stored = F.when(F.col("k") == 0, F.col("safe")).otherwise(F.concat(stem, F.lit("-"), F.col("k").cast("string"), suffix))
    added = met.where("reason is null").withColumn("seq", F.col("seq").cast("bigint")).drop("name").join(taken.select("doc_id", "seq", stored.alias("name")), ["doc_id", "seq"])
    columns = ["doc_id", "name", "content", "n_bytes"]
    return assets.select(*columns).unionByName(added.select(*columns)), met.where("reason is not null").select("doc_id", "seq", "reason")


def backup(docs: DataFrame, path: str) -> DataFrame:
    """Write a snapshot to ``path`` and return its manifest (n_docs, digest): the digest does not depend on the order of rows."""
    docs.write.mode("errorifexists").parquet(path)
    saved = docs.sparkSession.read.parquet(path)
    row_hash = F.xxhash64("id", "content_hash", "body_hash")
    # A sum: two equal rows count twice, where exclusive or would cancel them.
    return saved.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(row_hash.cast("decimal(20,0)")), F.lit(0)).cast("string").alias("digest"))


# Change log ----------------------------------------------------------------------------------------


def latest_changes(changes: DataFrame) -> DataFrame:
    """The last change of each id, by time and then number; an aggregate, so a busy id is no burden."""
    best = changes.groupBy("id").agg(F.max_by(F.struct(*[c for c in changes.columns if c != "id"]), F.struct("occurred_at", "seq")).alias("c"))
    return best.select("id", "c.*")


def replayed(changes: DataFrame) -> DataFrame:
    """(id, path, content_hash, created_at, updated_at, n_changes) of the documents that a log leaves: those whose last change is no deletion.

    The same event under several numbers counts once.
    """
    once = changes.groupBy("id", "kind", "path", "content_hash", "occurred_at").agg(F.min("seq").alias("seq"))
    last = once.groupBy("id").agg(
        F.max_by(F.struct("kind", "path", "content_hash", "occurred_at"), F.struct("occurred_at", "seq")).alias("c"),
        F.min(F.when(F.col("kind") == "created", F.col("occurred_at"))).alias("created_at"),
        F.count("*").alias("n_changes"),
    )
    return last.where("c.kind <> 'deleted'").select("id", "c.path", "c.content_hash", "created_at", F.col("c.occurred_at").alias("updated_at"), "n_changes")


def debounced(changes: DataFrame, key: str = "path", seconds: float = 1.5) -> DataFrame:
    """(key, kind, started_at, ended_at, n): the last action of each run of events of a key with gaps under ``seconds``."""
    gap = F.session_window("occurred_at", f"{int(seconds * 1000)} milliseconds")
    runs = changes.where(F.col(key).isNotNull()).groupBy(key, gap).agg(
        F.max_by("kind", F.struct("occurred_at", "seq")).alias("kind"), F.min("occurred_at").alias("started_at"), F.max("occurred_at").alias("ended_at"), F.count("*").alias("n")
    )
    return runs.select(key, "kind", "started_at", "ended_at", "n")


def empty(spark: SparkSession) -> DataFrame:
    """A vault without documents."""
    from parchmint.schemas import BODIES

    return spark.createDataFrame([], BODIES)
