"""The engine: one vault's tables and indexes behind the operations a client knows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchmint.functions import frontmatter, pages, text, urls
from parchmint.operators import classify, documents, feeds, jobs, vectors
from parchmint.operators.search import SearchError, SearchIndex
from parchmint.operators.sections import sections_of
from parchmint.staging import staged

#: Longest list that fusion takes from either side.
POOL = 60


def reranked(candidates: DataFrame, scores: dict[int, float] | None, limit: int) -> DataFrame:
    """Candidates (pos, ...) by the scores a reranker gave their positions; without scores, as they were.

    A missing score is 0, ties keep their order, and the new score is the negated one.
    """
    if not scores:
        return candidates.orderBy("pos").limit(limit)
    given = F.create_map(*[F.lit(x) for pair in scores.items() for x in pair])
    judged = candidates.withColumn("judged", F.coalesce(given[F.col("pos")], F.lit(0.0)))
    return judged.orderBy(F.desc("judged"), "pos").limit(limit).withColumn("score", -F.col("judged")).drop("judged")


@dataclass
class VaultEngine:
    """Documents with bodies, and optionally a text index, section vectors, an embedder and a reranker.

    ``rerank`` takes the query and a list of (pos, title, path, text) and returns scores by position.
    """

    spark: SparkSession
    docs: DataFrame
    index: SearchIndex | None = None
    vectors: DataFrame | None = None
    embedder: object | None = None
    rerank: Callable | None = None

    def rebuilt(self) -> VaultEngine:
        """The engine with indexes made anew from the documents."""
        sections = sections_of(self.docs)
        vec = None
        if self.embedder is not None:
            vec = staged(_embedded(sections, self.embedder), "vectors")
        return VaultEngine(self.spark, self.docs, SearchIndex.build(sections), vec, self.embedder, self.rerank)

    # Documents
    def list_docs(self, **options) -> documents.Page:
        return documents.list_docs(self.docs, **options)

    def get(self, doc_id: str):
        return documents.get(self.docs, doc_id)

    def create(self, writes: DataFrame, now: Column | None = None) -> documents.Written:
        return documents.create(self.docs, writes, F.current_timestamp() if now is None else now)

    def update(self, writes: DataFrame, now: Column | None = None) -> documents.Written:
        return documents.update(self.docs, writes, F.current_timestamp() if now is None else now)

    def delete(self, asked: DataFrame, now: Column | None = None) -> documents.Written:
        return documents.delete(self.docs, asked, F.current_timestamp() if now is None else now)

    def upsert(self, writes: DataFrame, now: Column | None = None) -> documents.Written:
        return documents.upsert(self.docs, writes, F.current_timestamp() if now is None else now)

    def raw_document(self, doc_id: str) -> str:
        """A document as its file has it: metadata, then body."""
        return self.docs.where(F.col("id") == documents.get(self.docs, doc_id)["id"]).select(frontmatter.file_text(*frontmatter.FILE_COLUMNS).alias("text")).first()["text"]

    def capture(self, rows: DataFrame) -> DataFrame:
        """Pages (url, html, fallback_title) as captures; ``refused`` marks walls and empty pages, ``route`` the extractor.

        Of optional columns, ``persist`` (null: true) is passed on, and ``frontmatter``, a map, overrides what was extracted:
        title, source, type and tags (separated by commas); a blank title, source or type is as if it were not there.
        """
        made = rows.withColumn("c", pages.article(F.col("html"), F.col("url"), F.col("fallback_title")))
        stub = urls.is_video(F.col("url"))
        front = F.col("frontmatter") if "frontmatter" in rows.columns else F.create_map().cast("map<string,string>")
        given = lambda key: F.nullif(F.trim(front[key]), F.lit(""))
        tags = F.when(front["tags"].isNotNull(), F.filter(F.transform(F.split(front["tags"], ","), lambda t: F.trim(t)), lambda t: t != "")).otherwise(F.array().cast("array<string>"))
        known = ["title", "source", "type", "tags"]
        return made.select(
            "url", F.coalesce(given("title"), F.col("c.title")).alias("title"), F.when(stub, pages.video_stub(F.col("html"))).otherwise(F.col("c.content_markdown")).alias("content_markdown"),
            F.coalesce(given("type"), F.when(stub, "video").otherwise("article")).alias("content_type"), F.when(stub, F.lit(False)).otherwise(F.col("c.refused")).alias("refused"), urls.route(F.col("url"), F.col("html").isNotNull()).alias("route"),
            F.coalesce(given("source"), F.col("url")).alias("source"), tags.alias("tags"), F.map_filter(front, lambda k, v: ~k.isin(known)).alias("extra"),
            (F.coalesce("persist", F.lit(True)) if "persist" in rows.columns else F.lit(True)).alias("persist"),
        )

    def captured(self, rows: DataFrame, now: Column | None = None) -> documents.Written:
        """Capture pages and write those that are to be kept and were not refused."""
        kept = staged(self.capture(rows).where("persist and not refused"), "captures")
        writes = kept.select(F.monotonically_increasing_id().alias("seq"), F.col("content_markdown").alias("body"), "title", "source", "content_type", F.lit(None).cast("timestamp").alias("captured_at"), "tags", "extra")
        return self.create(writes, now)

    def add_assets(self, assets: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        return documents.add_assets(self.docs, assets, wanted)

    # Feeds and jobs
    def sync_feeds(self, registry: DataFrame, entries: DataFrame, extract: Callable, write: Callable, now: Column | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
        return feeds.sync(registry, entries, self.docs, extract, write, F.current_timestamp() if now is None else now, limit)

    def register_feeds(self, registry: DataFrame, wanted: DataFrame, now: Column | None = None) -> DataFrame:
        return feeds.register(registry, wanted, F.current_timestamp() if now is None else now)

    def enable_feed(self, registry: DataFrame, feed_id: str, enabled: bool = True) -> DataFrame:
        return feeds.set_enabled(registry, feed_id, enabled)

    def remove_feed(self, registry: DataFrame, feed_id: str) -> DataFrame:
        return feeds.removed(registry, feed_id)

    def preview_feed(self, entries: DataFrame, limit: int | None = None) -> DataFrame:
        return feeds.preview(entries, self.docs, limit)

    def queue_depth(self, queue: DataFrame) -> DataFrame:
        return jobs.depth(queue)

    def jobs(self, queue: DataFrame, status: str | None = None, limit: int = 50) -> DataFrame:
        return jobs.listed(queue, status, limit)

    # Search
    def search(self, query: str, limit: int = 20, mode: str = "any") -> DataFrame:
        """Sections by words (any, substring, fts), by meaning (semantic) or both (hybrid, by words alone without vectors)."""
        if not 1 <= limit <= 100:
            raise SearchError("limit must be from 1 to 100")
        if mode == "semantic":
            return self.semantic(query, limit)
        if mode == "hybrid":
            return self.search(query, limit, "any") if self.vectors is None else self._hybrid(query, limit, max(3 * limit, 30))
        return self.index.search(query, limit, mode)

    def semantic(self, query: str, limit: int = 20) -> DataFrame:
        if self.vectors is None:
            raise SearchError("there are no vectors")
        near = vectors.knn(self.vectors, vectors.local_vector(self.spark, query, self.embedder), limit)
        return near.select("doc_id", F.nullif("title", F.lit("")).alias("section_title"), F.col("path").alias("section_path"), F.lit("").alias("snippet"), "score")

    def _hybrid(self, query: str, limit: int, pool: int) -> DataFrame:
        lists = [self.index.search(query, min(pool, 1000), "any"), self.semantic(query, min(pool, 1000))]
        w = Window.partitionBy(F.lit(0)).orderBy("score", "doc_id", F.array_join("section_path", "\x1f"))  # at most a pool of rows
        ranked = [staged(r.withColumn("pos", F.row_number().over(w) - 1).withColumn("key", F.concat_ws("\x1e", "doc_id", F.array_join("section_path", "\x1f"))), "ranked") for r in lists]
        best = vectors.fused(ranked[0], ranked[1], limit)
        seen = ranked[0].withColumn("list", F.lit(0)).unionByName(ranked[1].withColumn("list", F.lit(1)))
        first = seen.groupBy("key").agg(F.min_by(F.struct("doc_id", "section_title", "section_path", "snippet"), F.struct("list", "pos")).alias("h"))
        return best.join(first, "key").select("h.*", "score").orderBy("score", "doc_id", F.array_join("section_path", "\x1f"))

    def hybrid(self, query: str, limit: int = 20, rerank: bool = True) -> DataFrame:
        """Both rankings fused, then judged by the reranker if there is one."""
        if self.vectors is None:
            raise SearchError("there are no vectors")
        judge = rerank and self.rerank is not None
        pool = min(max((4 if judge else 3) * limit, 30), POOL)
        if not judge:
            return self._hybrid(query, limit, pool)
        found = self._hybrid(query, pool, pool)
        w = Window.partitionBy(F.lit(0)).orderBy("score", "doc_id", F.array_join("section_path", "\x1f"))
        candidates = staged(found.withColumn("pos", F.row_number().over(w) - 1), "candidates")
        # Only the candidates' documents are looked up, at most a pool of them.
        ids = [r["doc_id"] for r in candidates.select("doc_id").distinct().collect()]
        bodies = self.index.sections.where(F.col("doc_id").isin(ids)).groupBy("doc_id", "path").agg(F.max_by("body", "ord").alias("body"))
        texts = candidates.join(bodies, (candidates["doc_id"] == bodies["doc_id"]) & (candidates["section_path"] == bodies["path"]), "left").select(
            "pos", "section_title", "section_path", F.substring(F.coalesce(F.nullif("body", F.lit("")), "snippet"), 1, 600).alias("text")
        )
        items = [(r["pos"], r["section_title"], list(r["section_path"]), r["text"]) for r in texts.orderBy("pos").collect()]  # at most a pool of rows
        try:
            scores = self.rerank(query, items)
        except Exception:  # a reranker that fails leaves the fused order
            scores = None
        return reranked(candidates, scores, limit).drop("pos")

    def related(self, doc_id: str, limit: int = 20) -> DataFrame:
        if not 1 <= limit <= 100:
            raise SearchError("limit must be from 1 to 100")
        return vectors.related(self.vectors, doc_id, limit)

    def best_sections(self, hits: DataFrame) -> DataFrame:
        """The best hit of each document."""
        w = Window.partitionBy("doc_id").orderBy("score", F.array_join("section_path", "\x1f"))
        return hits.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")

    def chat_context(self, ids: list[str], characters: int = 10_000) -> DataFrame:
        """(context): the quoted documents of a list of ids, in its order, repetitions kept, unknown ids skipped."""
        asked = self.spark.createDataFrame([(k, i) for k, i in enumerate(ids)], "pos int, id string")
        met = F.broadcast(asked).join(self.docs, "id").select("pos", text.chunk_of_chat(F.col("id"), F.col("title"), F.col("body"), characters).alias("chunk"))
        return met.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk"))), lambda s: s["chunk"]), "\n\n").alias("context"))

    # Upkeep
    def stats(self) -> DataFrame:
        return documents.stats(self.docs, F.octet_length("body"))

    def integrity(self, pointers: DataFrame) -> DataFrame:
        return documents.integrity(self.docs, pointers)

    def backup(self, path: str) -> DataFrame:
        return documents.backup(self.docs, path)

    def reindexed(self, force: bool = False) -> VaultEngine:
        """The engine with indexes: made anew if ``force``, else only where there are none."""
        if not force and self.index is not None and (self.vectors is not None or self.embedder is None):
            return self
        return self.rebuilt()

    def retrain(self, examples: DataFrame, holdout: DataFrame, path: str, force: bool = False) -> classify.Retrained:
        return classify.retrain(examples, holdout, path, force)

    def classifier_diff(self, rows: DataFrame, label: str, old: str, new: str) -> DataFrame:
        return classify.difference(rows, label, old, new)

    def sinks(self) -> dict[str, Callable[[DataFrame, int], None]]:
        """What :func:`parchmint.streaming.changes.follow` feeds: one sink that keeps this engine's indexes up to date."""

        def index(changes: DataFrame, number: int) -> None:
            after = self.apply_changes(changes)
            self.index, self.vectors = after.index, after.vectors

        return {"index": index}

    def apply_changes(self, changes: DataFrame) -> VaultEngine:
        """The engine after the documents of ``changes`` (id, ...) changed: only their sections are indexed anew.

        Only documents whose sections' texts are others than before get new vectors.
        """
        ids = staged(changes.select(F.col("id").alias("doc_id")).distinct(), "changed")
        fresh = staged(sections_of(self.docs.join(ids.withColumnRenamed("doc_id", "id"), "id", "left_semi")), "fresh_sections")
        vec = self.vectors
        if vec is not None:
            hashes = lambda df: df.select("doc_id", _section_hash().alias("content_hash"))
            same = unchanged_sections(hashes(self.index.sections.join(ids, "doc_id", "left_semi")), hashes(fresh)) if self.index is not None else ids.where("false")
            other = staged(ids.join(same, "doc_id", "left_anti"), "reembedded")
            new = _embedded(fresh.join(other, "doc_id", "left_semi"), self.embedder)
            vec = staged(vec.join(other, "doc_id", "left_anti").unionByName(new), "vectors")
        index = None if self.index is None else self.index.replaced(ids, fresh)
        return VaultEngine(self.spark, self.docs, index, vec, self.embedder, self.rerank)


def _section_hash() -> Column:
    """What a section's vector depends on: its path, title and text."""
    return F.sha2(F.concat_ws("\x1f", F.array_join("path", "\x1e"), F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))), 256)


def _embedded(sections: DataFrame, embedder) -> DataFrame:
    return vectors.embedded(sections.select("doc_id", "ord", "title", "path", "body"), text.truncated_for_embedding(text.section_text(F.col("path"), F.col("title"), F.col("body"))), embedder)


def unchanged_sections(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id): documents whose sections' hashes (doc_id, content_hash) are the same set before and after, and not empty; they need no new vectors."""
    sets = [df.groupBy("doc_id").agg(F.array_sort(F.collect_set("content_hash")).alias(name)) for df, name in ((old, "a"), (new, "b"))]
    return sets[0].join(sets[1], "doc_id").where((F.col("a") == F.col("b")) & (F.size("a") > 0)).select("doc_id")


def as_utc(value: dt.datetime) -> dt.datetime:
    """A time without zone is UTC; others are converted."""
    return value.astimezone(dt.UTC).replace(tzinfo=None) if value.tzinfo else value
