"""Registered queries of writing, upkeep, feeds, captures and the index's changes, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.functions import text
from parchmint.operators import classify, documents, feeds, jobs
from parchmint.operators.search import SearchIndex, compile_query
from parchmint.plans.engine import VaultEngine
from parchmint.plans.queries import GUESSES, JOBS, STAMP, _guesses, _jobs, _stamp, query
from parchmint.schemas import BODIES
from parchmint.sources import media
from parchmint.tables import table

NOW = "2026-07-01"
BODY = "CASE WHEN ends_with({0}, chr(10)) THEN {0} ELSE {0} || chr(10) END"
HASH = "'sha256:' || sha256(" + BODY + ")"

# A vault of the captures of even numbers, the first of each address.
VAULT = f"""v AS (SELECT url AS source, min(capture_id) AS c FROM captured_content WHERE capture_id % 2 = 0 GROUP BY url),
    old AS (SELECT v.source, lpad(v.c::VARCHAR, 26, '0') AS id, any_value(x.content_markdown) AS body, any_value(x.title) AS title FROM v JOIN captured_content x ON x.capture_id = v.c GROUP BY v.source, v.c)"""


def _vault(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with bodies: the first capture of each address among those of even numbers."""
    c = table(spark, folder, "captured_content").where("capture_id % 2 = 0")
    first = c.groupBy("url").agg(F.min_by(F.struct("capture_id", "title", "content_markdown", "content_type", "captured_at"), "capture_id").alias("c"))
    body = F.when(F.col("c.content_markdown").endswith("\n"), F.col("c.content_markdown")).otherwise(F.concat(F.col("c.content_markdown"), F.lit("\n")))
    rows = first.select(
        F.lpad(F.col("c.capture_id").cast("string"), 26, "0").alias("id"), F.concat(F.lit("p/"), F.col("c.capture_id").cast("string")).alias("path"), F.col("c.title").alias("title"), F.col("url").alias("source"), F.col("c.content_type").alias("content_type"),
        F.col("c.captured_at").alias("captured_at"), F.col("c.captured_at").alias("updated_at"), F.array().cast("array<string>").alias("tags"), F.create_map().cast("map<string,string>").alias("extra"),
        F.lit("h").alias("content_hash"), F.concat(F.lit("sha256:"), F.sha2(body, 256)).alias("body_hash"), body.alias("body"),
    )
    return spark.createDataFrame([], BODIES).unionByName(rows)


@query(
    f"""WITH {VAULT}, w AS (SELECT url AS source, arg_max(content_markdown, capture_id) AS body, arg_max(title, capture_id) FILTER (title IS NOT NULL) AS title FROM captured_content GROUP BY url)
    SELECT w.source, CASE WHEN old.id IS NULL THEN 'created' WHEN {HASH.format("old.body")} = {HASH.format("w.body")} THEN 'unchanged' ELSE 'updated' END AS kind, old.id AS old_id, {HASH.format("w.body")} AS body_hash,
        CASE WHEN old.id IS NOT NULL AND {HASH.format("old.body")} = {HASH.format("w.body")} THEN old.title ELSE coalesce(w.title, old.title) END AS title FROM w LEFT JOIN old USING (source)"""
)
def idempotent_write(spark: SparkSession, folder: str) -> DataFrame:
    """All captures written to a vault that has half of the addresses: what is created, updated or left as it is."""
    c, vault = table(spark, folder, "captured_content"), _vault(spark, folder)
    writes = c.select(F.col("capture_id").alias("seq"), F.col("content_markdown").alias("body"), "title", F.col("url").alias("source"), "content_type", "captured_at", "tags", F.create_map().cast("map<string,string>").alias("extra"))
    done = documents.create(vault, writes, F.lit(NOW).cast("timestamp"))
    known = vault.select("source", F.col("id").alias("old_id"))
    after = done.docs.join(done.changes.select("id", "kind"), "id", "left").join(known, "source", "left")
    return after.select("source", F.coalesce("kind", F.lit("unchanged")).alias("kind"), "old_id", "body_hash", "title")


@query(
    f"""WITH {VAULT}, a AS (SELECT lpad(capture_id::VARCHAR, 26, '0') AS id, any_value(content_markdown) AS body, CASE WHEN capture_id % 5 = 0 THEN 'x' WHEN capture_id % 7 = 0 THEN 'h' END AS if_match FROM captured_content GROUP BY capture_id)
    SELECT a.id, CASE WHEN old.id IS NULL AND if_match IS NOT NULL THEN 'conflict' WHEN old.id IS NULL THEN 'created' WHEN if_match = 'x' THEN 'conflict' ELSE 'updated' END AS outcome FROM a LEFT JOIN old ON old.id = a.id"""
)
def upsert_by_id(spark: SparkSession, folder: str) -> DataFrame:
    """Captures written under ids of the caller's, some with a hash to match: what became of each."""
    asked = table(spark, folder, "captured_content").groupBy("capture_id").agg(F.min("content_markdown").alias("body"))
    match = F.when(F.col("capture_id") % 5 == 0, "x").when(F.col("capture_id") % 7 == 0, "h")
    done = documents.upsert(_vault(spark, folder), asked.select(F.lpad(F.col("capture_id").cast("string"), 26, "0").alias("id"), "body", match.alias("if_match")), F.lit(NOW).cast("timestamp"))
    return done.changes.select("id", F.col("kind").alias("outcome")).unionByName(done.conflicts.select("id", F.col("reason").alias("outcome")))


@query("SELECT count(*) AS n_docs, count(DISTINCT source) AS n_sources, (SELECT count(*) FROM (SELECT source FROM docs WHERE source IS NOT NULL GROUP BY source HAVING count(*) > 1)) AS n_repeated, count(*) - count(DISTINCT source) AS n_extra FROM docs WHERE source IS NOT NULL")
def duplicate_totals(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents repeat a source."""
    return documents.duplicate_totals(table(spark, folder, "docs"))


@query("SELECT DISTINCT c.path, d.id FROM doc_changes c JOIN docs d ON d.path = c.path")
def deleted_paths_to_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Which documents the log's paths are."""
    return documents.ids_of_paths(table(spark, folder, "doc_changes").where("path is not null"), table(spark, folder, "docs"))


@query("SELECT id FROM docs WHERE starts_with(source, 'email:')")
def ids_by_source_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that came by mail."""
    return documents.ids(table(spark, folder, "docs"), "email:")


@query(
    """WITH a AS (SELECT doc_id, capture_id AS seq, coalesce(author, 'x') || '.png' AS name FROM (SELECT DISTINCT doc_id, capture_id, author FROM captured_content)) SELECT doc_id, seq, octet_length(encode(name)) > 20 AS too_large FROM a WHERE doc_id NOT IN (SELECT id FROM docs) OR octet_length(encode(name)) > 20"""
)
def assets_refused(spark: SparkSession, folder: str) -> DataFrame:
    """Assets that are too large or whose document is not there."""
    a = table(spark, folder, "captured_content").select("doc_id", F.col("capture_id").alias("seq"), F.concat(F.coalesce("author", F.lit("x")), F.lit(".png")).alias("name")).distinct()
    wanted = a.withColumn("content", F.encode("name", "UTF-8"))
    none = spark.createDataFrame([], "doc_id string, name string, content binary, n_bytes int")
    refused = documents.add_assets(table(spark, folder, "docs"), none, wanted, 20)[1]
    return refused.select("doc_id", "seq", (F.col("reason") == "too large").alias("too_large"))


# Feeds and jobs ------------------------------------------------------------------------------------

ENTRIES = """c AS (SELECT DISTINCT capture_id, url, title, content_markdown FROM captured_content), f AS (SELECT id, enabled, row_number() OVER (ORDER BY id) - 1 AS k, count(*) OVER () AS n FROM feeds),
    e AS (SELECT f.id AS feed_id, c.* FROM c JOIN f ON c.capture_id % f.n = f.k WHERE f.enabled), d AS (SELECT DISTINCT source AS url FROM docs WHERE right(id, 1) < 'G' AND source IS NOT NULL),
    r AS (SELECT e.*, CASE WHEN d.url IS NOT NULL THEN 'skipped' WHEN length(content_markdown) < 300 THEN 'failed' ELSE 'captured' END AS outcome FROM e LEFT JOIN d USING (url))"""


def _sync(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """A sync in which each feed has every n-th capture as an entry, and pages under 300 characters are refused."""
    registry = table(spark, folder, "feeds")
    numbered = {r["id"]: k for k, r in enumerate(registry.select("id").orderBy("id").collect())}  # a registry is small
    of = spark.createDataFrame(list(numbered.items()), "feed_id string, k long")
    c = table(spark, folder, "captured_content").select("capture_id", "url", "title", "content_markdown").distinct()
    entries = c.join(F.broadcast(of), F.col("capture_id") % len(numbered) == F.col("k")).select("feed_id", F.col("capture_id").alias("pos"), "url", "title", F.lit(None).cast("string").alias("author"), F.lit(None).cast("timestamp").alias("published_at"), F.lit(False).alias("is_video"))
    docs = table(spark, folder, "docs").where("right(id, 1) < 'G'")
    pages = c.select("url", "title", "content_markdown", F.lit("article").alias("content_type"), F.lit(None).cast("string").alias("author"), (F.length("content_markdown") < 300).alias("refused"))
    return feeds.sync(registry, entries, docs, lambda fresh: pages.join(fresh.select("url").distinct(), "url", "left_semi"), lambda writes: None, F.lit(NOW).cast("timestamp"))


@query(
    f"""WITH {ENTRIES}, g AS (SELECT feed_id, count(*) FILTER (outcome = 'captured') AS captured, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'failed') AS failed FROM r GROUP BY 1)
    SELECT f.id AS feed_id, coalesce(captured, 0) AS captured, coalesce(skipped, 0) AS skipped, coalesce(failed, 0) AS failed, CASE WHEN failed > 0 AND captured = 0 THEN 'failed' ELSE 'ok' END AS status FROM f LEFT JOIN g ON g.feed_id = f.id WHERE f.enabled"""
)
def feed_sync_report(spark: SparkSession, folder: str) -> DataFrame:
    """What a sync of all enabled feeds did."""
    return _sync(spark, folder)[1].select("feed_id", "captured", "skipped", "failed", "status")


@query(
    f"""WITH {ENTRIES}, g AS (SELECT feed_id, count(*) FILTER (outcome = 'captured') AS captured, count(*) FILTER (outcome = 'failed') AS failed FROM r GROUP BY 1)
    SELECT s.id, CASE WHEN NOT s.enabled THEN s.last_status WHEN failed > 0 AND captured = 0 THEN 'failed' ELSE 'ok' END AS last_status, CASE WHEN s.enabled THEN '2026-07-01 00:00:00' ELSE {STAMP.format("s.last_sync_at")} END AS last_sync_at FROM feeds s LEFT JOIN g ON g.feed_id = s.id"""
)
def feed_registry_after_sync(spark: SparkSession, folder: str) -> DataFrame:
    """The registry after that sync."""
    return _sync(spark, folder)[0].select("id", "last_status", _stamp("last_sync_at"))


@query(f"WITH {JOBS} SELECT CASE WHEN status = 'running' AND created_at < TIMESTAMPTZ '2025-01-01 00:00:00+00' - INTERVAL 90 SECOND THEN 'failed' ELSE status END AS status, count(*) AS n FROM j GROUP BY 1")
def queue_timeouts(spark: SparkSession, folder: str) -> DataFrame:
    """The queue, by status, after jobs that ran too long failed."""
    q = _jobs(spark, folder).withColumn("started_at", F.col("created_at"))
    return jobs.expired(q, F.lit("2025-01-01").cast("timestamp")).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {JOBS} SELECT count(*) AS n_jobs, (SELECT count(*) FROM docs) AS n_new, (SELECT count(*) FROM docs) + count(*) FILTER (status = 'queued') AS n_queued FROM j")
def queue_enqueue(spark: SparkSession, folder: str) -> DataFrame:
    """The queue with a job for every document added, twice."""
    q = _jobs(spark, folder)
    wanted = table(spark, folder, "docs").select("id", F.col("source").alias("url"))
    after = jobs.enqueue(jobs.enqueue(q, wanted, F.lit(NOW).cast("timestamp")), wanted, F.lit(NOW).cast("timestamp"))
    old = after.join(q.select("id", F.lit(True).alias("old")), "id", "left")
    return old.agg(F.count("old").alias("n_jobs"), F.count_if(F.col("old").isNull()).alias("n_new"), F.count_if(F.col("status") == "queued").alias("n_queued"))


# Labels --------------------------------------------------------------------------------------------


@query(
    f"""WITH {GUESSES}, l AS (SELECT unnest(['KEEP', 'SKIP']) AS name), c AS (SELECT name, count(*) FILTER (label = name) AS n, count(*) FILTER (new = name) AS said, count(*) FILTER (label = name AND new = name) AS hit FROM g, l WHERE label IS NOT NULL GROUP BY name)
    SELECT name AS label, n, round(hit / nullif(said, 0), 9) AS precision, round(hit / nullif(n, 0), 9) AS recall, round(2 * hit / nullif(said + n, 0), 9) AS f1 FROM c"""
)
def holdout_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Precision, recall and F1 of a rule by label."""
    q = classify.quality(_guesses(spark, folder), guess="new")
    return q.select("label", "n", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(
    """WITH d AS (SELECT 'newsletter' AS list, unnest(['substack.com', 'beehiiv.com']) AS domain, 0 AS rank), o AS (SELECT CASE WHEN label = 'KEEP' THEN 'newsletter' ELSE 'promo' END AS list, lower(trim(split_part(sender, '@', 2))) AS domain, 1 AS rank FROM labeled)
    SELECT list, domain, CASE WHEN min(rank) = 0 THEN 'bundled' ELSE 'user' END AS origin FROM (SELECT * FROM d UNION ALL SELECT * FROM o) WHERE domain <> '' GROUP BY 1, 2"""
)
def domain_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Bundled domains, and the senders' as a user's own."""
    own = table(spark, folder, "labeled").select(F.when(F.col("label") == "KEEP", "newsletter").otherwise("promo").alias("list"), F.split_part("sender", F.lit("@"), F.lit(2)).alias("domain"))
    return classify.domain_lists(spark.createDataFrame([("newsletter", "substack.com"), ("newsletter", "beehiiv.com")], "list string, domain string"), own)


# Captures ------------------------------------------------------------------------------------------


@query(
    """WITH c AS (SELECT DISTINCT capture_id, author, title, content_markdown AS b FROM captured_content) SELECT capture_id, CASE WHEN capture_id % 3 = 0 AND trim(coalesce(b, '')) <> '' THEN 'captions' WHEN capture_id % 3 = 1 AND trim(coalesce(title, '')) <> '' THEN 'speech' ELSE 'meta' END AS how,
    md5(CASE WHEN capture_id % 3 = 0 AND trim(coalesce(b, '')) <> '' THEN trim(b) WHEN capture_id % 3 = 1 AND trim(coalesce(title, '')) <> '' THEN trim(title) ELSE concat_ws(chr(10) || chr(10), CASE WHEN trim(coalesce(author, '')) <> '' THEN '**' || trim(author) || '**' END,
        CASE WHEN trim(coalesce(title, '')) <> '' THEN trim(title) ELSE '*No text could be extracted. Open the original to see it.*' END) END) AS text FROM c"""
)
def post_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """What stands for a post: captions, else speech, else the stub of its metadata; as a digest."""
    c = table(spark, folder, "captured_content").select("capture_id", "author", "title", "content_markdown").distinct()
    captions, speech = F.when(F.col("capture_id") % 3 == 0, F.col("content_markdown")), F.when(F.col("capture_id") % 3 == 1, F.col("title"))
    found, how = media.post_text(captions, speech, F.col("author"), F.col("title"))
    return c.select("capture_id", how.alias("how"), F.md5(found).alias("text"))


@query(
    r"""WITH d AS (SELECT doc_id, regexp_replace(text, '([aeiou])(\w)', '<mark>\1</mark>\2', 'g') || ' <b>&"''' AS s FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, md5(replace(replace(replace(replace(replace(replace(replace(s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;'), '&lt;mark&gt;', '<mark>'), '&lt;/mark&gt;', '</mark>')) AS html FROM d"""
)
def safe_snippets(spark: SparkSession, folder: str) -> DataFrame:
    """Marked texts as HTML in which only the marks are markup, as digests."""
    d = table(spark, folder, "documents").where("text is not null")
    marked = F.concat(F.regexp_replace("text", r"([aeiou])([0-9A-Za-z_])", "<mark>$1</mark>$2"), F.lit(" <b>&\"'"))
    return d.select("doc_id", F.md5(text.safe_snippet(marked)).alias("html"))


@query(
    """WITH d AS (SELECT id, source, type, tags FROM (SELECT id, source, content_type AS type, tags FROM docs WHERE source IS NOT NULL))
    SELECT id, CASE WHEN trim(coalesce(type, '')) = '' THEN 'article' ELSE trim(type) END AS content_type, coalesce(array_to_string([trim(t) FOR t IN string_split(array_to_string([x FOR x IN tags IF x IS NOT NULL], ','), ',') IF trim(t) <> ''], '|'), '') AS tags FROM d"""
)
def capture_override(spark: SparkSession, folder: str) -> DataFrame:
    """Captures whose type and tags come from the request's metadata; a blank type is as if it were not there."""
    d = table(spark, folder, "docs").where("source is not null")
    front = F.map_filter(F.create_map(F.lit("type"), F.col("content_type"), F.lit("tags"), F.array_join("tags", ","), F.lit("key"), F.col("id")), lambda k, v: v.isNotNull())
    rows = d.select(F.lit("https://a.example/x").alias("url"), F.lit("<html><head><title>T</title></head><body><p>Some text.</p></body></html>").alias("html"), F.lit("T").alias("fallback_title"), front.alias("frontmatter"))
    made = VaultEngine(spark, d).capture(rows)
    return made.select(F.col("extra")["key"].alias("id"), "content_type", F.array_join("tags", "|").alias("tags"))


# The index's changes -------------------------------------------------------------------------------

WORDS = r"regexp_extract_all(replace(strip_accents(lower({})), 'ς', 'σ'), '[\p{{L}}\p{{N}}]+')"


@query(
    f"""WITH now AS (SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN text || ' museum museum' ELSE text END AS text FROM documents WHERE text IS NOT NULL AND doc_id % 5 <> 0), d AS (SELECT doc_id, {WORDS.format("text")} AS w FROM now),
    n AS (SELECT count(*) AS rows, avg(len(w)) AS average FROM d), c AS (SELECT doc_id, len(w) AS n_tokens, len(list_filter(w, lambda x: x = 'museum')) AS f0 FROM d), s AS (SELECT count(*) FILTER (f0 > 0) AS d0 FROM c)
    SELECT doc_id, round(-(greatest(ln((rows - d0 + 0.5) / (d0 + 0.5)), 1e-6) * 2.2 * f0 / (f0 + 1.2 * (0.25 + 0.75 * n_tokens / average))), 6) AS score FROM c, s, n WHERE f0 > 0"""
)
def index_after_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Scores from an index of which a fifth of the documents were deleted and a fifth replaced, twice."""
    rows = table(spark, folder, "documents").where("text is not null").select("doc_id", "text")
    section = lambda df, body: df.select("doc_id", F.lit(0).alias("ord"), F.lit("").alias("title"), F.array().cast("array<string>").alias("path"), body.alias("body"))
    index = SearchIndex.build(section(rows, F.col("text")))
    gone, changed = rows.where("doc_id % 5 = 0"), rows.where("doc_id % 5 = 1")
    index = index.replaced(changed, section(changed, F.lit("for a while museum"))).replaced(gone, section(gone.where("false"), F.col("text")))
    index = index.replaced(changed, section(changed, F.concat("text", F.lit(" museum museum"))))
    return index.matches(compile_query("museum", "any", lambda t: t.lower().split())).select("doc_id", F.round("score", 6).alias("score"))
