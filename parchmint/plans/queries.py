"""The registered queries of the vault's own operators, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchmint.functions import hashing, pages, text, urls
from parchmint.operators import classify, documents, feeds, jobs, vectors
from parchmint.operators.search import SearchIndex, bm25_scan, compile_query
from parchmint.operators.sections import sections_of
from parchmint.schemas import BODIES
from parchmint.session import prepare
from parchmint.staging import spread

from parchmint.streaming import changes as streams
from parchmint.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: The words of the search queries.
TERMS = ["reservoir", "printer", "museum", "archives", "turbine", "colección", "conseil"]
FOLDED = [t.replace("ó", "o") for t in TERMS]


def query(sql: str | None = None):
    """Register a query under its function's name, with SQL that gives the same rows if there is any."""

    def add(f: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return f(prepare(spark), folder)

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# Search --------------------------------------------------------------------------------------------

WORDS = r"regexp_extract_all(replace(strip_accents(lower({})), 'ς', 'σ'), '[\p{{L}}\p{{N}}]+')"
TOKENS = f"d AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL), n AS (SELECT count(*) AS rows, avg(len(w)) AS average FROM d)"


def _bm25_sql(columns: list[str], wanted: str, order: str = "") -> str:
    """SQL that scores the rows for which ``wanted`` holds; a column is the count of one phrase, f0, f1, ..."""
    f = ", ".join(f"{c} AS f{i}" for i, c in enumerate(columns))
    df = ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(columns)))
    gain = " + ".join(f"greatest(ln((rows - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * 2.2 * f{i} / (f{i} + 1.2 * (0.25 + 0.75 * n_tokens / average))" for i in range(len(columns)))
    return f"""WITH {TOKENS}, c AS (SELECT doc_id, len(w) AS n_tokens, {f} FROM d), s AS (SELECT {df} FROM c)
    SELECT doc_id, round(-({gain}), 6) AS score FROM c, s, n WHERE {wanted} {order}"""


def _count(term: str) -> str:
    return f"len(list_filter(w, lambda x: x = '{term}'))"


ANY = _bm25_sql([_count(t) for t in FOLDED], " OR ".join(f"f{i} > 0" for i in range(len(FOLDED))))


@query(f"SELECT doc_id, score FROM ({ANY}) ORDER BY score, doc_id LIMIT 20")
def bm25_any_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty documents that fit best to any of some words."""
    best = bm25_scan(table(spark, folder, "documents"), "doc_id", "text", FOLDED)
    return best.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score")).orderBy("score", "doc_id").limit(20)


@query(ANY)
def bm25_any_all(spark: SparkSession, folder: str) -> DataFrame:
    """Every document that has any of some words, scored."""
    return bm25_scan(table(spark, folder, "documents"), "doc_id", "text", FOLDED).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def _index(spark: SparkSession, folder: str) -> SearchIndex:
    rows = table(spark, folder, "documents").where("text is not null")
    return SearchIndex.build(rows.select("doc_id", F.lit(0).alias("ord"), F.lit("").alias("title"), F.array().cast("array<string>").alias("path"), F.col("text").alias("body")))


def _scored(spark: SparkSession, folder: str, text_of_query: str, mode: str) -> DataFrame:
    index = _index(spark, folder)
    tree = compile_query(text_of_query, mode, lambda t: [x.translate(str.maketrans("óé", "oe")) for x in t.lower().split()])
    return index.matches(tree).select("doc_id", F.round("score", 6).alias("score"))


@query(ANY)
def bm25_index_any(spark: SparkSession, folder: str) -> DataFrame:
    """The same scores from an inverted index."""
    return _scored(spark, folder, " ".join(TERMS), "any")


@query(_bm25_sql([_count("reservoir"), _count("printer")], "f0 > 0 AND f1 > 0"))
def bm25_substring_and(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that have all of the words."""
    return _scored(spark, folder, "reservoir printer", "substring")


def _phrase(*terms: str) -> str:
    same = " AND ".join(f"w[i + {k}] = '{t}'" for k, t in enumerate(terms))
    return f"len([i for i in range(1, len(w) - {len(terms) - 2}) if {same}])"


@query(_bm25_sql([_phrase("without", "asking", "the", "board")], "f0 > 0"))
def bm25_phrase(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that have a phrase."""
    return _scored(spark, folder, '"without asking the board"', "fts")


@query(_bm25_sql(["len(list_filter(w, lambda x: starts_with(x, 'reserv')))"], "f0 > 0"))
def bm25_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that have a word with a prefix."""
    return _scored(spark, folder, "reserv*", "fts")


@query(
    f"""WITH {TOKENS}, c AS (SELECT doc_id, len(w) AS n_tokens, {_count("museum")} AS f0, {_count("printer")} AS f1, {_count("ferry")} AS f2, {_count("glacier")} AS f3 FROM d),
    s AS (SELECT count(*) FILTER (f0 > 0) AS d0, count(*) FILTER (f1 > 0) AS d1, count(*) FILTER (f2 > 0) AS d2 FROM c),
    g AS (SELECT doc_id, f0, f1, f2, f3, """
    + ", ".join(f"greatest(ln((rows - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * 2.2 * f{i} / (f{i} + 1.2 * (0.25 + 0.75 * n_tokens / average)) AS g{i}" for i in range(3))
    + """ FROM c, s, n)
    SELECT doc_id, round(-(CASE WHEN f1 > 0 AND f2 > 0 THEN g1 + g2 ELSE 0 END + g0), 6) AS score FROM g WHERE ((f1 > 0 AND f2 > 0) OR f0 > 0) AND f3 = 0"""
)
def bm25_tree(spark: SparkSession, folder: str) -> DataFrame:
    """A query of AND, OR and NOT, where a word counts only if all around it match."""
    return _scored(spark, folder, "((printer ferry) OR museum) NOT glacier", "fts")


def _near_places(one: str, other: str, distance: int) -> str:
    places = lambda t: f"[i for i in range(1, len(w) + 1) if w[i] = '{t}']"
    return f"len([x for x in {places(one)} if len([y for y in {places(other)} if abs(x - y) <= {distance + 1}]) > 0])"


def _near_sql(one: str, other: str, distance: int) -> str:
    """A word's rarity does not depend on its neighbours, its count does."""
    gain = " + ".join(f"greatest(ln((rows - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * 2.2 * f{i} / (f{i} + 1.2 * (0.25 + 0.75 * n_tokens / average))" for i in range(2))
    return f"""WITH {TOKENS}, c AS (SELECT doc_id, len(w) AS n_tokens, {_near_places(one, other, distance)} AS f0, {_near_places(other, one, distance)} AS f1, {_count(one)} AS a0, {_count(other)} AS a1 FROM d),
    s AS (SELECT count(*) FILTER (a0 > 0) AS d0, count(*) FILTER (a1 > 0) AS d1 FROM c) SELECT doc_id, round(-({gain}), 6) AS score FROM c, s, n WHERE f0 > 0 AND f1 > 0"""


@query(_near_sql("printer", "reservoir", 6))
def bm25_near(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in which two words stand near each other."""
    return _scored(spark, folder, "NEAR(printer reservoir, 6)", "fts")


# Line by line: the open fence, and whether the line was a title's underline.
_SPACES = r"\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"
SECTIONS = r"""WITH RECURSIVE t AS (SELECT doc_id, string_split(regexp_replace(text, '[\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]', chr(10), 'g'), chr(10)) AS l FROM documents WHERE text IS NOT NULL),
    k AS (SELECT doc_id, l, len(l) - CASE WHEN l[-1] = '' THEN 1 ELSE 0 END AS n FROM t),
    s AS (SELECT doc_id, l, n, 0 AS i, '' AS fence, false AS skip, 0 AS level, '' AS title FROM k
        UNION ALL
        SELECT doc_id, l, n, i + 1,
            CASE WHEN skip THEN fence WHEN fence = '' THEN regexp_extract(l[i + 1], '^\s*(```|~~~)', 1) WHEN starts_with(ltrim(l[i + 1], chr(9) || ' '), fence) THEN '' ELSE fence END,
            NOT skip AND fence = '' AND NOT regexp_matches(l[i + 1], '^\s*(```|~~~)') AND NOT regexp_matches(l[i + 1], '^#{1,6}SP') AND regexp_matches(l[i + 1], '[^SQ]') AND i + 2 <= n AND regexp_matches(l[i + 2], '^(=+|-+)\s*$'),
            CASE WHEN skip OR fence <> '' OR regexp_matches(l[i + 1], '^\s*(```|~~~)') THEN 0 WHEN regexp_matches(l[i + 1], '^#{1,6}SP') THEN length(regexp_extract(l[i + 1], '^(#{1,6})SP', 1))
                WHEN regexp_matches(l[i + 1], '[^SQ]') AND i + 2 <= n AND regexp_matches(l[i + 2], '^=+\s*$') THEN 1 WHEN regexp_matches(l[i + 1], '[^SQ]') AND i + 2 <= n AND regexp_matches(l[i + 2], '^-+\s*$') THEN 2 ELSE 0 END,
            CASE WHEN regexp_matches(l[i + 1], '^#{1,6}SP') THEN regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(l[i + 1], '^#+', ''), '^SP+|SP+$', '', 'g'), '^#+$', ''), 'SP#+$', ''), '^SP+|SP+$', '', 'g') ELSE regexp_replace(l[i + 1], '^SP+|SP+$', '', 'g') END
        FROM s WHERE i < n),
    h AS (SELECT doc_id, i AS line, level, title, CASE WHEN regexp_matches(l[i], '^#{1,6}SP') THEN i + 1 ELSE i + 2 END AS starts, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS ord FROM s WHERE level > 0),
    a AS (SELECT doc_id, 0 AS ord, 0 AS level, CAST(NULL AS VARCHAR) AS title, 1 AS starts, 0 AS line FROM k UNION ALL SELECT doc_id, ord, level, title, starts, line FROM h),
    b AS (SELECT a.*, coalesce(lead(line) OVER (PARTITION BY a.doc_id ORDER BY ord), k.n + 1) AS ends, k.n, k.l FROM a JOIN k USING (doc_id)),
    o AS (SELECT x.doc_id, x.ord, count(*) AS open FROM h x, unnest(range(1, 7)) AS g(k), LATERAL (SELECT arg_max(y.level, y.ord) AS last FROM h y WHERE y.doc_id = x.doc_id AND y.ord < x.ord AND y.level <= g.k) z WHERE g.k < x.level AND z.last = g.k GROUP BY 1, 2)
    SELECT b.doc_id, CAST(b.ord AS INTEGER) AS ord, CAST(b.level AS INTEGER) AS level, b.title, CAST(CASE WHEN b.level > 0 THEN 1 ELSE 0 END + coalesce(o.open, 0) AS INTEGER) AS depth,
        CAST(coalesce(list_sum([length(x) + 1 for x in l[starts : ends - 1]]), 0) - CASE WHEN ends = n + 1 AND ends > starts AND len(l) = n THEN 1 ELSE 0 END AS INTEGER) AS n_chars
    FROM b LEFT JOIN o ON o.doc_id = b.doc_id AND o.ord = b.ord""".replace("SP", f"[{_SPACES}]").replace("[^SQ]", f"[^{_SPACES}]")


@query(SECTIONS)
def section_explode(spark: SparkSession, folder: str) -> DataFrame:
    """The sections of every document: number, level, title, depth of path, length."""
    rows = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    s = sections_of(rows, title_col=None)
    return s.select("doc_id", "ord", "level", "title", F.size("path").alias("depth"), F.length("body").alias("n_chars"))


@query()
def search_snippets(spark: SparkSession, folder: str) -> DataFrame:
    """Sections of captures that fit best to a query, with snippets."""
    captures = table(spark, folder, "captured_content").dropDuplicates(["capture_id"])
    sections = sections_of(captures, "capture_id", "title", "content_markdown")
    found = SearchIndex.build(sections).search("careful turbine and museum", 50, "any")
    return found.select("doc_id", "section_title", F.array_join("section_path", " > ").alias("section_path"), "snippet", F.round("score", 6).alias("score"))


# Vectors -------------------------------------------------------------------------------------------


def _knn_sql(distance: str) -> str:
    return f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
    p AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {distance} AS score FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), id) AS rank FROM p)
    SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(score, 4) AS score FROM r WHERE rank <= 10"""


def _knn(spark: SparkSession, folder: str, metric: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    return vectors.knn_join(e, e.where("vec_id % 100 = 0"), 10, metric).select("query_id", "id", "rank", F.round("score", 4).alias("score"))


@query(_knn_sql("list_distance(q.v, e.v)"))
def knn_l2(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors of every query vector, against all."""
    return _knn(spark, folder, "l2")


@query(_knn_sql("1 - list_cosine_similarity(q.v, e.v)"))
def knn_cosine(spark: SparkSession, folder: str) -> DataFrame:
    """The same by cosine."""
    return _knn(spark, folder, "cosine")


CENTROIDS = """x AS (SELECT label, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
    m AS (SELECT label, pos, avg(x) AS m FROM x GROUP BY 1, 2), l AS (SELECT label, sqrt(sum(m * m)) AS norm FROM m GROUP BY 1)"""


@query(f"WITH {CENTROIDS} SELECT label, CAST(pos AS INTEGER) AS pos, round(CASE WHEN norm > 0 THEN m / norm ELSE m END, 5) AS x FROM m JOIN l USING (label)")
def doc_centroid(spark: SparkSession, folder: str) -> DataFrame:
    """The centroid of each label's vectors, coordinate by coordinate."""
    c = vectors.centroids(table(spark, folder, "embeddings"), "label")
    return c.select("label", F.posexplode("centroid").alias("pos", "x")).select("label", "pos", F.round("x", 5).alias("x"))


@query(
    f"""WITH {CENTROIDS}, c AS (SELECT label, list(CASE WHEN norm > 0 THEN m / norm ELSE m END ORDER BY pos) AS v FROM m JOIN l USING (label) GROUP BY label),
    p AS (SELECT c.label AS label, e.vec_id AS id, list_distance(c.v, e.embedding::DOUBLE[]) AS score FROM c JOIN embeddings e ON e.label <> c.label),
    r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(score, 9), id) AS rank FROM p)
    SELECT label, id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 200"""
)
def related_docs(spark: SparkSession, folder: str) -> DataFrame:
    """The 200 vectors nearest to each label's centroid that are not its own."""
    e = table(spark, folder, "embeddings").where("embedding is not null")
    asked = vectors.centroids(e, "label").select((-1 - F.col("label")).cast("bigint").alias("vec_id"), F.col("centroid").alias("embedding"), "label")
    near = vectors.knn_join(e, asked, 200, apart="label")
    return near.select((-1 - F.col("query_id")).cast("int").alias("label"), "id", "rank")


@query(
    f"""WITH a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score, doc_id) - 1 AS pos FROM ({ANY}) ORDER BY score, doc_id LIMIT 60),
    q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT 1),
    b AS (SELECT vec_id AS id, row_number() OVER (ORDER BY round(list_distance(q.v, e.embedding::DOUBLE[]), 9), vec_id) - 1 AS pos FROM embeddings e, q QUALIFY pos < 60),
    u AS (SELECT id, pos, 0 AS list FROM a UNION ALL SELECT id, pos, 1 FROM b), g AS (SELECT id, sum(1.0::DOUBLE / (61 + pos)) AS gain, min(list * 1000 + pos) AS seen FROM u GROUP BY id)
    SELECT id, round(-gain, 9) AS score FROM g ORDER BY round(gain, 12) DESC, seen LIMIT 20"""
)
def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """A word ranking and a vector ranking as one, by reciprocal ranks."""
    words = bm25_scan(table(spark, folder, "documents"), "doc_id", "text", FOLDED).select("id", F.round("score", 6).alias("score")).orderBy("score", "id").limit(60)
    e = table(spark, folder, "embeddings")
    first = list(e.orderBy("vec_id").first()["embedding"])
    near = vectors.knn(e, first, 60, id_col="vec_id").select(F.col("vec_id").alias("id"), F.round("score", 9).alias("score"))
    w = Window.partitionBy(F.lit(0)).orderBy("score", "id")  # sixty rows
    lists = [x.select(F.col("id").alias("key"), (F.row_number().over(w) - 1).alias("pos")) for x in (words, near)]
    return vectors.fused(*lists, limit=20).select(F.col("key").alias("id"), F.round("score", 9).alias("score"))


# Documents -----------------------------------------------------------------------------------------

STAMP = "strftime({} AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S')"


def _stamp(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


@query(f"SELECT id, title, {STAMP.format('updated_at')} AS updated_at FROM docs ORDER BY docs.updated_at DESC, id DESC LIMIT 101")
def list_page_first(spark: SparkSession, folder: str) -> DataFrame:
    """The first page of the listing and the row that tells whether there is a next."""
    return documents.newest(table(spark, folder, "docs")).limit(101).select("id", "title", _stamp("updated_at"))


@query(
    f"""WITH c AS (SELECT captured_at, id FROM docs ORDER BY captured_at DESC, id DESC LIMIT 1 OFFSET 99)
    SELECT d.id, title, {STAMP.format("d.captured_at")} AS captured_at FROM docs d, c WHERE d.updated_at >= TIMESTAMPTZ '2024-03-01 00:00:00+00' AND (d.captured_at < c.captured_at OR (d.captured_at = c.captured_at AND d.id < c.id))
    ORDER BY d.captured_at DESC, d.id DESC LIMIT 101"""
)
def list_page_next(spark: SparkSession, folder: str) -> DataFrame:
    """The page behind a cursor, of documents updated since a day, by time of capture."""
    docs = table(spark, folder, "docs")
    last = documents.newest(docs, "captured_at").limit(100).orderBy("captured_at", "id").first()
    since = F.lit("2024-03-01").cast("timestamp")
    rows = documents.newest(docs, "captured_at", since, (F.lit(last["captured_at"]), F.lit(last["id"]))).limit(101)
    return rows.select("id", "title", _stamp("captured_at"))


@query("SELECT source, min(id) AS keep_id, count(*) AS n FROM docs WHERE source IS NOT NULL GROUP BY source HAVING count(*) > 1")
def dedupe_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """Sources of several documents and the id that stays."""
    return documents.duplicate_sources(table(spark, folder, "docs"))


@query("SELECT doc_id, 'sha256:' || sha256(CASE WHEN ends_with(text, chr(10)) THEN text ELSE text || chr(10) END) AS body_hash FROM documents")
def body_hash(spark: SparkSession, folder: str) -> DataFrame:
    """Identity of each text."""
    return table(spark, folder, "documents").select("doc_id", hashing.body_hash(F.col("text")).alias("body_hash"))


@query("SELECT sha256(text) AS text_hash, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def dup_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that several documents have."""
    return table(spark, folder, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query(
    """WITH w AS (SELECT url AS source, arg_max(content_markdown, capture_id) AS body, arg_max(title, capture_id) FILTER (title IS NOT NULL) AS title, arg_min(captured_at, capture_id) AS captured_at FROM captured_content GROUP BY url)
    SELECT source, title, 'sha256:' || sha256(CASE WHEN ends_with(body, chr(10)) THEN body ELSE body || chr(10) END) AS body_hash, strftime(date_trunc('second', captured_at) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS captured_at, 'created' AS kind FROM w"""
)
def idempotent_create(spark: SparkSession, folder: str) -> DataFrame:
    """All captures written to an empty vault: one document a source, the last body, the first time."""
    c = table(spark, folder, "captured_content")
    writes = c.select(F.col("capture_id").alias("seq"), F.col("content_markdown").alias("body"), "title", F.col("url").alias("source"), "content_type", "captured_at", "tags", F.create_map().cast("map<string,string>").alias("extra"))
    done = documents.create(spark.createDataFrame([], BODIES), writes, F.lit("2026-07-01").cast("timestamp"))
    return done.docs.join(done.changes.select("id", "kind"), "id").select("source", "title", "body_hash", _stamp("captured_at"), "kind")


@query(
    f"""SELECT id, kind, path, content_hash, {STAMP.format("occurred_at")} AS occurred_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY occurred_at DESC, seq DESC) AS n FROM doc_changes) WHERE n = 1"""
)
def latest_change_per_id(spark: SparkSession, folder: str) -> DataFrame:
    """The last change of each document."""
    return documents.latest_changes(table(spark, folder, "doc_changes")).select("id", "kind", "path", "content_hash", _stamp("occurred_at"))


@query(
    """WITH o AS (SELECT id, kind, path, content_hash, occurred_at, min(seq) AS seq FROM doc_changes GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY occurred_at DESC, seq DESC) AS n, count(*) OVER (PARTITION BY id) AS n_changes FROM o)
    SELECT id, path, content_hash, n_changes FROM r WHERE n = 1 AND kind <> 'deleted'"""
)
def replayed_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that the change log leaves."""
    return documents.replayed(table(spark, folder, "doc_changes")).select("id", "path", "content_hash", "n_changes")


@query(
    """WITH e AS (SELECT *, CASE WHEN occurred_at - lag(occurred_at) OVER w < INTERVAL 3600 SECOND THEN 0 ELSE 1 END AS starts FROM doc_changes WINDOW w AS (PARTITION BY id ORDER BY occurred_at, seq)),
    g AS (SELECT *, sum(starts) OVER (PARTITION BY id ORDER BY occurred_at, seq) AS run FROM e)
    SELECT id, arg_max(kind, (occurred_at, seq)) AS kind, strftime(min(occurred_at) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS started_at, strftime(max(occurred_at) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS ended_at, count(*) AS n FROM g GROUP BY id, run"""
)
def debounced_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of changes of a document with gaps under an hour, and the last action of each."""
    runs = documents.debounced(table(spark, folder, "doc_changes"), "id", 3600)
    return runs.select("id", "kind", _stamp("started_at"), _stamp("ended_at"), "n")


@query(
    f"""WITH c AS (SELECT DISTINCT capture_id, doc_id, content_markdown FROM captured_content)
    SELECT count(*) AS n_docs, CAST(sum(coalesce(length(content_markdown), 0)) AS BIGINT) AS n_chars, {STAMP.format("min(d.captured_at)")} AS oldest_at, {STAMP.format("max(d.updated_at)")} AS newest_at FROM docs d LEFT JOIN c ON c.doc_id = d.id"""
)
def vault_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Number, size and age of the vault's documents."""
    c = table(spark, folder, "captured_content").select("capture_id", "doc_id", "content_markdown").distinct()
    rows = table(spark, folder, "docs").join(c, F.col("id") == F.col("doc_id"), "left")
    s = documents.stats(rows, F.coalesce(F.length("content_markdown"), F.lit(0)))
    return s.select("n_docs", F.col("n_bytes").cast("bigint").alias("n_chars"), _stamp("oldest_at"), _stamp("newest_at"))


@query(
    """WITH c AS (SELECT doc_id, any_value(content_markdown) AS body FROM captured_content GROUP BY doc_id), p AS (SELECT id, min(path) AS path FROM doc_changes WHERE path IS NOT NULL GROUP BY id)
    SELECT count(*) AS n_docs, count(*) FILTER (d.id IS NULL) AS no_id, count(*) FILTER (NOT regexp_matches(d.id, '^[0-7][0-9A-HJKMNP-TV-Z]{25}$')) AS bad_id, count(*) FILTER (p.id IS NULL) AS no_pointer, count(*) FILTER (p.path <> d.path) AS wrong_pointer,
        count(*) FILTER (body IS NOT NULL AND 'sha256:' || sha256(CASE WHEN ends_with(body, chr(10)) THEN body ELSE body || chr(10) END) <> body_hash) AS wrong_hash
    FROM docs d LEFT JOIN c ON c.doc_id = d.id LEFT JOIN p ON p.id = d.id"""
)
def integrity_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Faults of documents, pointers and hashes."""
    bodies = table(spark, folder, "captured_content").groupBy("doc_id").agg(F.first("content_markdown").alias("body"))
    pointers = table(spark, folder, "doc_changes").where("path is not null").groupBy("id").agg(F.min("path").alias("path"))
    return documents.integrity(table(spark, folder, "docs").join(bodies, F.col("id") == F.col("doc_id"), "left"), pointers)


# Feeds and jobs ------------------------------------------------------------------------------------

KNOWN = "k AS (SELECT source AS url, min(id) AS doc_id FROM docs WHERE source IS NOT NULL GROUP BY source), e AS (SELECT DISTINCT capture_id, url FROM captured_content)"


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "captured_content").select("capture_id", "url").distinct().withColumn("pos", F.col("capture_id"))


@query(f"WITH {KNOWN} SELECT capture_id, url, k.doc_id, CASE WHEN k.doc_id IS NULL THEN 'new' ELSE 'skip' END AS status FROM e LEFT JOIN k USING (url)")
def feed_preview_new_skip(spark: SparkSession, folder: str) -> DataFrame:
    """Which captured addresses the vault has already."""
    return feeds.preview(_entries(spark, folder), table(spark, folder, "docs")).select("capture_id", "url", "doc_id", "status")


@query(f"WITH {KNOWN} SELECT capture_id, url FROM e ANTI JOIN k USING (url)")
def feed_new_anti(spark: SparkSession, folder: str) -> DataFrame:
    """Captured addresses that are no document's source."""
    return feeds.new_entries(_entries(spark, folder), table(spark, folder, "docs")).select("capture_id", "url")


@query(f"WITH {KNOWN} SELECT capture_id, url FROM e SEMI JOIN k USING (url)")
def feed_skip_semi(spark: SparkSession, folder: str) -> DataFrame:
    """Captured addresses that are a document's source."""
    return feeds.seen_entries(_entries(spark, folder), table(spark, folder, "docs")).select("capture_id", "url")


@query(
    """WITH t AS (SELECT extra['feed_id'] AS id, unnest(tags) AS tag FROM docs WHERE extra['feed_id'] IS NOT NULL AND extra['feed_id'] <> 'manual'), w AS (SELECT id, list(DISTINCT tag) AS tags FROM t WHERE tag IS NOT NULL GROUP BY id)
    SELECT f.id, f.url, array_to_string(list_sort(list_distinct(list_concat(coalesce(f.tags, []), coalesce(w.tags, [])))), '|') AS tags FROM feeds f JOIN w ON w.id = f.id"""
)
def feed_register(spark: SparkSession, folder: str) -> DataFrame:
    """Feeds registered again with the tags of their documents: tags united."""
    f, docs = table(spark, folder, "feeds"), table(spark, folder, "docs")
    tags = docs.select(F.col("extra")["feed_id"].alias("id"), F.explode("tags").alias("tag")).where("id is not null and id <> 'manual' and tag is not null")
    wanted = tags.groupBy("id").agg(F.collect_set("tag").alias("tags")).join(f.select("id", "url", "name"), "id")
    after = feeds.register(f, wanted, F.current_timestamp())
    return after.join(wanted.select("id"), "id", "left_semi").select("id", "url", F.array_join(F.array_sort(F.array_distinct("tags")), "|").alias("tags"))


@query(f"SELECT id, url, {STAMP.format('created_at')} AS created_at FROM feeds WHERE enabled")
def feeds_due(spark: SparkSession, folder: str) -> DataFrame:
    """Enabled feeds."""
    return feeds.due(table(spark, folder, "feeds")).select("id", "url", _stamp("created_at"))


@query("SELECT coalesce(last_status, 'never') AS status, count(*) AS n, count(*) FILTER (enabled) AS n_enabled FROM feeds GROUP BY 1")
def feed_status(spark: SparkSession, folder: str) -> DataFrame:
    """How the feeds' last syncs went."""
    return table(spark, folder, "feeds").groupBy(F.coalesce("last_status", F.lit("never")).alias("status")).agg(F.count("*").alias("n"), F.count_if("enabled").alias("n_enabled"))


def _jobs(spark: SparkSession, folder: str) -> DataFrame:
    """The change log as a queue: what was created is queued, an update ran, a deletion is done."""
    status = F.when(F.col("kind") == "created", "queued").when(F.col("kind") == "updated", "running").otherwise("done")
    nothing = {c: F.lit(None).cast(t) for c, t in (("url", "string"), ("html", "string"), ("doc_id", "string"), ("doc_path", "string"), ("body_hash", "string"), ("error", "string"), ("started_at", "timestamp"), ("completed_at", "timestamp"))}
    rows = table(spark, folder, "doc_changes").groupBy("seq").agg(F.min_by("kind", "kind").alias("kind"), F.min("occurred_at").alias("created_at"))
    return rows.select(F.lpad(F.col("seq").cast("string"), 26, "0").alias("id"), status.alias("status"), "created_at", F.lit(0).alias("attempts"), *[c.alias(n) for n, c in nothing.items()])


JOBS = "j AS (SELECT lpad(seq::VARCHAR, 26, '0') AS id, CASE min(kind) WHEN 'created' THEN 'queued' WHEN 'updated' THEN 'running' ELSE 'done' END AS status, min(occurred_at) AS created_at FROM doc_changes GROUP BY seq)"


@query(f"WITH {JOBS} SELECT id, {STAMP.format('created_at')} AS created_at FROM (SELECT * FROM j WHERE status = 'queued' ORDER BY created_at, id LIMIT 100)")
def queue_claim_order(spark: SparkSession, folder: str) -> DataFrame:
    """The next hundred jobs of the queue."""
    return jobs.claimable(_jobs(spark, folder), 100).select("id", _stamp("created_at"))


@query(f"WITH {JOBS} SELECT count(*) FILTER (status = 'queued') AS queue_depth FROM j")
def queue_depth(spark: SparkSession, folder: str) -> DataFrame:
    """How many jobs wait."""
    return jobs.depth(_jobs(spark, folder))


@query(
    f"""WITH {JOBS}, r AS (SELECT id, created_at, CASE status WHEN 'running' THEN 'queued' ELSE status END AS status FROM j), c AS (SELECT id FROM r WHERE status = 'queued' ORDER BY created_at, id LIMIT 50)
    SELECT CASE WHEN c.id IS NOT NULL THEN 'running' ELSE status END AS status, CAST(count(c.id) AS BIGINT) AS attempts, count(*) AS n FROM r LEFT JOIN c USING (id) GROUP BY 1"""
)
def queue_after_restart(spark: SparkSession, folder: str) -> DataFrame:
    """The queue after a restart and the claim of fifty jobs, by status."""
    q = jobs.claim(jobs.recovered(_jobs(spark, folder)), 50, F.lit("2026-01-01").cast("timestamp"))
    return q.groupBy("status").agg(F.sum("attempts").cast("bigint").alias("attempts"), F.count("*").alias("n"))


# Text functions ------------------------------------------------------------------------------------


@query(
    r"""WITH a AS (SELECT id, regexp_replace(trim(lower(coalesce(title, ''))), '[^\p{L}\p{M}\p{Nd}\p{Pc}\s-]', '', 'g') AS s FROM docs),
    b AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(s, '[\s_]+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS s FROM a) SELECT id, CASE WHEN s = '' THEN 'untitled' ELSE substr(s, 1, 80) END AS slug FROM b"""
)
def slugify(spark: SparkSession, folder: str) -> DataFrame:
    """A file name for each document."""
    return table(spark, folder, "docs").select("id", text.slug(F.col("title")).alias("slug"))


@query(
    r"""SELECT DISTINCT capture_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content_markdown, '!\[.*?\]\([^)]*\)', ' ', 'g'), '\[([^\]]+)\]\([^)]*\)', '\1', 'g'), '(?m)^#+\s*', '', 'g'), '`+', '', 'g'), '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))) AS plain
    FROM captured_content"""
)
def strip_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Plain text of every capture, as its digest."""
    return spread(table(spark, folder, "captured_content").select("capture_id", "content_markdown")).select("capture_id", F.md5(text.strip_markdown(F.col("content_markdown"))).alias("plain")).distinct()


def _any_of(column: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in phrases) + ")"


CLEAN = rf"""WITH c AS (SELECT DISTINCT capture_id, content_markdown AS m FROM captured_content WHERE content_type = 'newsletter'),
    l AS (SELECT *, [x for x in string_split(m, chr(10)) if not {_any_of("lower(x)", text.PREHEADERS)}] AS l FROM c),
    f AS (SELECT *, coalesce(list_position([{_any_of("lower(x)", text.FOOTERS)} for x in l], true), 0) AS f FROM l),
    b AS (SELECT *, replace(regexp_replace(array_to_string(CASE WHEN f > 0 THEN l[1 : f - 1] ELSE l END, chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), chr(8203), '') AS b FROM f),
    k AS (SELECT *, string_split(rtrim(b, ' '), chr(10)) AS k FROM b),
    r AS (SELECT *, [trim(x, ' ') = '' OR regexp_matches(trim(x, ' '), '{text.ADDRESS}') OR starts_with(lower(trim(x, ' ')), '©') OR starts_with(lower(trim(x, ' ')), 'copyright') for x in k] AS r FROM k)
    SELECT capture_id, CAST(length(m) AS INTEGER) AS n_before, CAST(CASE WHEN m IS NULL THEN NULL WHEN list_contains(r, false) THEN length(regexp_replace(array_to_string(k[1 : len(k) - list_position(list_reverse(r), false) + 1], chr(10)), '^\s+|\s+$', '', 'g')) ELSE 0 END AS INTEGER) AS n_after FROM r"""


@query(CLEAN)
def clean_newsletters(spark: SparkSession, folder: str) -> DataFrame:
    """Newsletters without their frame: characters before and after."""
    c = table(spark, folder, "captured_content").where("content_type = 'newsletter'").select("capture_id", "content_markdown").distinct()
    return c.select("capture_id", F.length("content_markdown").alias("n_before"), F.length(text.clean_newsletter(F.col("content_markdown"))).alias("n_after"))


WALL = " OR ".join(f"contains(t, '{s.replace(chr(39), chr(39) * 2)}')" for s in pages.WALL_TITLES)


MISSES = " OR ".join(f"contains(t, '{p.replace(chr(39), chr(39) * 2)}') OR contains(lower(b), '{p.replace(chr(39), chr(39) * 2)}')" for p in pages.MIRROR_MISSES)


@query(
    f"""WITH c AS (SELECT DISTINCT capture_id, lower(trim(coalesce(title, ''))) AS t, trim(coalesce(content_markdown, '')) AS b FROM captured_content)
    SELECT capture_id FROM c WHERE CASE WHEN capture_id % 4 = 0 THEN {MISSES} OR capture_id % 8 = 0 ELSE capture_id % 4 = 1 OR {WALL} OR (t IN ('', 'untitled') AND length(b) < 400) END"""
)
def wall_detect(spark: SparkSession, folder: str) -> DataFrame:
    """Captures that are walls by their title, a thin body, their markup (every fourth has a widget), or, as pages of a mirror, by another account."""
    c = table(spark, folder, "captured_content").select("capture_id", "title", "content_markdown").distinct()
    k = F.col("capture_id")
    markup = F.when(k % 4 == 1, '<div class="g-recaptcha"></div>').otherwise("<p>text</p>")
    mirror = k % 4 == 0
    url = F.when(mirror, "https://nitter.net/alice/status/1").otherwise("https://a.example/x")
    title = F.when(mirror & (k % 8 == 0), F.concat(F.lit("Bob (@bob)"), F.coalesce("title", F.lit("")))).otherwise(F.col("title"))
    return c.where(pages.is_wall(F.col("content_markdown"), title, markup, url)).select("capture_id")


@query(
    r"""WITH c AS (SELECT DISTINCT capture_id, title, content_markdown AS b FROM captured_content), w AS (SELECT capture_id, list_distinct(list_filter(regexp_extract_all(lower(title), '[\p{L}\p{M}\p{Nd}\p{Pc}]+'), lambda x: length(x) > 2)) AS t, regexp_extract_all(lower(substr(b, 1, 1500)), '[\p{L}\p{M}\p{Nd}\p{Pc}]+') AS b FROM c WHERE title <> '' AND b <> '')
    SELECT capture_id FROM w WHERE len(t) > 0 AND len(list_filter(t, lambda x: list_contains(b, x))) / len(t) >= 0.5"""
)
def title_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Captures whose title their body bears out."""
    c = table(spark, folder, "captured_content").select("capture_id", "title", "content_markdown").distinct()
    return c.where(text.title_in_body(F.col("title"), F.col("content_markdown"))).select("capture_id")


@query(
    r"""SELECT route, count(*) AS n, count(DISTINCT host) AS n_hosts FROM (SELECT CASE WHEN regexp_matches(source, '(youtube\.com/watch\?v=|youtu\.be/|youtube\.com/embed/|youtube\.com/shorts/)[\w-]{11}') THEN 'video' WHEN regexp_matches(source, '://(www\.)?linkedin\.com/posts/') THEN 'post' WHEN right(id, 1) < 'G' THEN 'html' ELSE 'fetch' END AS route,
    nullif(regexp_replace(lower(regexp_extract(source, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', ''), '') AS host FROM docs WHERE source IS NOT NULL) GROUP BY route"""
)
def routes(spark: SparkSession, folder: str) -> DataFrame:
    """Which extractor the vault's sources go to, some with their markup and some without, and of how many hosts."""
    d = table(spark, folder, "docs").where("source is not null").select(urls.route(F.col("source"), F.right("id", F.lit(1)) < "G").alias("route"), urls.host(F.col("source")).alias("host"))
    return d.groupBy("route").agg(F.count("*").alias("n"), F.count_distinct("host").alias("n_hosts"))


@query("SELECT doc_id, sha256('<doc id=\"' || doc_id || '\" title=\"' || coalesce(source, '') || '\">' || chr(10) || substr(text, 1, 10000) || chr(10) || '</doc>') AS chunk FROM documents WHERE text IS NOT NULL")
def chat_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Each document as a chat quotes it (its first 10,000 characters are the quotation), as a digest."""
    d = table(spark, folder, "documents").where("text is not null")
    return d.select("doc_id", F.sha2(text.chunk_of_chat(F.col("doc_id").cast("string"), F.col("source"), F.col("text")), 256).alias("chunk"))


# Labels --------------------------------------------------------------------------------------------


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN source IS NULL THEN 0 ELSE 1 END DESC, coalesce(ts, 0) DESC, row_id DESC) AS n FROM labeled WHERE id IS NOT NULL AND id <> '')
    SELECT row_id, id, label FROM r WHERE n = 1 UNION ALL SELECT row_id, id, label FROM labeled WHERE id IS NULL OR id = ''"""
)
def label_merge_last_wins(spark: SparkSession, folder: str) -> DataFrame:
    """Examples by id, feedback over bootstrap labels."""
    rows = table(spark, folder, "labeled")
    return classify.merged_examples(rows.where("source is null"), rows.where("source is not null")).select("row_id", "id", "label")


@query("SELECT coalesce(CASE WHEN upper(trim(label)) IN ('KEEP', 'SKIP') THEN upper(trim(label)) END, '?') AS label, count(*) AS n FROM labeled GROUP BY 1")
def label_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How often each label occurs, whatever its spelling."""
    return table(spark, folder, "labeled").groupBy(F.coalesce(classify.tidy_label(F.col("label")), F.lit("?")).alias("label")).agg(F.count("*").alias("n"))




DOMAIN = lambda names: " OR ".join(f"ends_with(split_part(a, '@', 2), '{d}') OR ends_with(split_part(r, '@', 2), '{d}')" for d in names)


@query(
    f"""WITH v AS (SELECT row_id, lower(regexp_extract(coalesce(sender, ''), '<?\\s*([^<>\\s]+@[^<>\\s]+)\\s*>?', 1)) AS a, CASE row_id % 6 WHEN 0 THEN 'bounce@mg.substack.com' WHEN 1 THEN 'x@klaviyomail.com' WHEN 2 THEN 'b@c.example' ELSE '' END AS r, CASE WHEN row_id % 4 = 3 THEN '' ELSE 'list' END AS list,
        CASE WHEN row_id % 5 = 0 THEN row_id % 2 = 0 END AS judged, len(list_filter(regexp_split_to_array(coalesce(body, ''), '\\s+'), lambda x: x <> '')) AS n FROM labeled)
    SELECT row_id, CASE WHEN {DOMAIN(classify.PROMOTIONS)} THEN false WHEN starts_with(a, 'noreply@') OR starts_with(a, 'no-reply@') THEN false
        WHEN {DOMAIN(classify.PLATFORMS)} THEN true WHEN list <> '' THEN coalesce(judged, n >= 500) ELSE false END AS keep FROM v"""
)
def domain_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The newsletter rules over all examples, with return paths, lists and verdicts that differ by row."""
    rows, k = table(spark, folder, "labeled"), F.col("row_id")
    back = F.when(k % 6 == 0, "<bounce@mg.substack.com>").when(k % 6 == 1, "x@klaviyomail.com").when(k % 6 == 2, "B@c.example")
    keep = classify.verdict(F.col("sender"), back, F.when(k % 4 != 3, "list"), F.col("body"), F.when(k % 5 == 0, k % 2 == 0))
    return rows.select("row_id", keep.alias("keep"))


GUESSES = "g AS (SELECT CASE WHEN upper(trim(label)) IN ('KEEP', 'SKIP') THEN upper(trim(label)) END AS label, CASE WHEN length(coalesce(body, '')) >= 1000 THEN 'KEEP' ELSE 'SKIP' END AS old, CASE WHEN sender LIKE '%noreply%' OR coalesce(sender, '') = '' THEN 'SKIP' ELSE 'KEEP' END AS new FROM holdout)"


def _guesses(spark: SparkSession, folder: str) -> DataFrame:
    h = table(spark, folder, "holdout")
    old = F.when(F.length(F.coalesce("body", F.lit(""))) >= 1000, "KEEP").otherwise("SKIP")
    new = F.when(F.col("sender").contains("noreply") | (F.coalesce("sender", F.lit("")) == ""), "SKIP").otherwise("KEEP")
    return h.select(classify.tidy_label(F.col("label")).alias("label"), old.alias("old"), new.alias("new")).where("label is not null")


@query(f"WITH {GUESSES} SELECT count(*) AS n, round(avg(CASE WHEN label = new THEN 1.0::DOUBLE ELSE 0.0 END), 9) AS accuracy FROM g WHERE label IS NOT NULL")
def holdout_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """How often a rule agrees with the holdout."""
    return classify.accuracy(_guesses(spark, folder), guess="new").select("n", F.round("accuracy", 9).alias("accuracy"))


@query(f"WITH {GUESSES} SELECT label, count(*) FILTER (new = 'KEEP') AS n_KEEP, count(*) FILTER (new = 'SKIP') AS n_SKIP FROM g WHERE label IS NOT NULL GROUP BY label")
def holdout_confusion(spark: SparkSession, folder: str) -> DataFrame:
    """Which label the rule takes for which."""
    return classify.confusion(_guesses(spark, folder), guess="new")


@query(
    f"""WITH {GUESSES}, d AS (SELECT count(*) FILTER (old <> new AND new = label) AS good, count(*) FILTER (old <> new AND old = label) AS bad, count(*) FILTER (old <> new AND old <> label AND new <> label) AS mixed FROM g WHERE label IS NOT NULL)
    SELECT good, bad, mixed, good - bad AS net FROM d"""
)
def diff_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Where two rules differ, and who is right."""
    return classify.difference(_guesses(spark, folder), "label", "old", "new")


@query(
    """WITH s AS (SELECT label, count(*) AS size, sum(count(*)) OVER () AS total FROM labeled GROUP BY label), q AS (SELECT label, greatest(1, CAST(round_even(100 * size / total, 0) AS BIGINT)) AS quota FROM s),
    r AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(row_id || ':42'), row_id) AS n FROM labeled)
    SELECT r.row_id, r.label, n <= quota AS held FROM r JOIN q ON r.label IS NOT DISTINCT FROM q.label"""
)
def stratified_holdout(spark: SparkSession, folder: str) -> DataFrame:
    """A holdout of about a hundred examples with each label's share: every example, and whether it is held out."""
    return classify.stratified(table(spark, folder, "labeled"), 100).select("row_id", "label", "held")


@query()
def classifier_holdout(spark: SparkSession, folder: str) -> DataFrame:
    """The trained classifier's verdict on every row of holdout."""
    model = classify.train(table(spark, folder, "labeled"))
    return classify.predicted(model, table(spark, folder, "holdout")).select("row_id", "split", "predicted", F.round("p_keep", 4).alias("p_keep"))


# Windows and roll-ups ------------------------------------------------------------------------------


@query(
    "SELECT lower(trim(content_type)) AS content_type, regexp_replace(lower(regexp_extract(source, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www[.]', '') AS host, count(*) AS n FROM docs WHERE source LIKE 'http%' AND content_type IS NOT NULL GROUP BY ROLLUP (1, 2)"
)
def type_source_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by type and host, with subtotals."""
    d = table(spark, folder, "docs").where("source like 'http%' and content_type is not null").select(F.lower(F.trim("content_type")).alias("content_type"), urls.host(F.col("source")).alias("host"))
    return d.rollup("content_type", "host").agg(F.count("*").alias("n"))


@query(
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started_at, count(*) AS n FROM g GROUP BY user_id, run"""
)
def session_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of each user's events."""
    e = table(spark, folder, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return streams.sessions(e, "user_id", "ts").select("user_id", _stamp("started_at"), "n")


@query("SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS started_at, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Events of each type by the hour."""
    e = table(spark, folder, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    return streams.tumbling(e, "ts", "1 hour", "event_type").select("event_type", _stamp("started_at"), "n")


@query("SELECT doc_id, capture_id, round(n, 6) AS score FROM (SELECT doc_id, capture_id, -length(content_markdown)::DOUBLE AS n, row_number() OVER (PARTITION BY doc_id ORDER BY -length(content_markdown) NULLS FIRST, capture_id) AS k FROM (SELECT DISTINCT doc_id, capture_id, content_markdown FROM captured_content)) WHERE k = 1")
def best_section_per_doc(spark: SparkSession, folder: str) -> DataFrame:
    """The best hit of each document, the longer the better, ties by the path."""
    from parchmint.plans.engine import VaultEngine

    c = table(spark, folder, "captured_content").select("doc_id", "capture_id", "content_markdown").distinct()
    hits = c.select("doc_id", "capture_id", F.array(F.lpad(F.col("capture_id").cast("string"), 20, "0")).alias("section_path"), (-F.length("content_markdown")).cast("double").alias("score"))
    return VaultEngine(spark, c).best_sections(hits).select("doc_id", "capture_id", F.round("score", 6).alias("score"))


def queries() -> dict[str, Query]:
    """Every query of the vault's operators by name."""
    from parchmint.plans import upkeep_queries  # noqa: F401  registers its own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """The same in SQL, where SQL can."""
    from parchmint.plans import upkeep_queries  # noqa: F401

    return dict(ORACLE)



