"""One surviving record for each group of records that name the same thing.

Records are ranked by completeness, trust and recency with window ordering, one window for all
choices. Keeping only the first rank lets Spark drop the rest of a group before the shuffle
(a partial group limit), so a group that holds a third of all rows sends one row a map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Query parameters that track a visitor rather than name a page, and default ports.
TRACKING_NAMES = ["fbclid", "gclid", "mc_cid", "mc_eid"]
TRACKING_PREFIX = "utm_"
DEFAULT_PORTS = {"http": "80", "https": "443"}

#: A title is useless for the surviving record if it is blank or one of these, lower-cased.
USELESS_TITLES = ["", "untitled", "none", "null", "home", "index", "no title", "(no subject)"]


def page_key(source: Column) -> Column:
    """What a source names: equal keys name the same page.

    Web addresses lose scheme, letter case of the host, a leading ``www.``, the scheme's default
    port, slashes at the end of the path, fragment, tracking parameters and the order of
    parameters. Anything else, email sources among them, is its own key; null stays null.
    """
    scheme = F.lower(F.regexp_extract(source, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    rest = F.regexp_replace(F.regexp_replace(source, r"^[^:]*://", ""), r"(?s)#.*$", "")
    authority = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    tail = F.regexp_extract(rest, r"(?s)^[^/?]*(.*)$", 1)
    path = F.regexp_replace(F.regexp_extract(tail, r"(?s)^([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(tail, r"(?s)\?(.*)$", 1)
    host = authority
    for name, port in DEFAULT_PORTS.items():
        host = F.when((scheme == name) & authority.endswith(f":{port}"), F.regexp_replace(authority, r":\d+$", "")).otherwise(host)
    host = F.regexp_replace(host, r"^www\.", "")

    def counts(parameter: Column) -> Column:
        name = F.lower(F.substring_index(parameter, "=", 1))
        return (parameter != "") & ~name.isin(TRACKING_NAMES) & ~name.startswith(TRACKING_PREFIX)

    parameters = F.array_join(F.array_sort(F.filter(F.split(query, "&"), counts)), "&")
    return F.when(scheme.isin("http", "https"), F.concat(F.lit("web:"), host, path, F.lit("?"), parameters)).otherwise(F.concat(F.lit("raw:"), source))


def distinct_tags(tags: Column) -> Column:
    """The tags, trimmed and lower-cased, without nulls, blanks and repeats; none for null."""
    trimmed = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(F.regexp_replace(t, r"(?U)^\s+|\s+$", "")))
    return F.array_distinct(F.filter(trimmed, lambda t: t.isNotNull() & (t != "")))


def ranked_pages(docs: DataFrame, clock_error_from: str = "2027-01-01") -> DataFrame:
    """(page, first_id, recent_id, tags_id, title_id) of each page that at least two rows of docs name.

    ``first_id`` is the smallest id. ``recent_id`` is the row updated last, where a time from
    ``clock_error_from`` on is a clock error and ranks below all others, a null time below those,
    and ties go to the larger id. ``tags_id`` is the row with the most distinct tags and
    ``title_id`` the one with a useful title (null if none has), ties in the order of
    ``recent_id``. Rows with a null id or source are in no page; identical rows count once. Other
    columns are ignored, and an empty table gives an empty result.
    """
    title = F.lower(F.trim(F.coalesce(docs["title"], F.lit(""))))
    trust = F.when(docs["updated_at"].isNull(), 0).when(docs["updated_at"] >= F.lit(clock_error_from).cast("timestamp"), 1).otherwise(2)
    slim = docs.where(docs["id"].isNotNull() & docs["source"].isNotNull()).select(
        page_key(docs["source"]).alias("page"),
        docs["id"].alias("id"),
        trust.alias("trust"),
        docs["updated_at"].alias("at"),
        F.size(distinct_tags(docs["tags"])).alias("n_tags"),
        (~title.isin(USELESS_TITLES)).cast("int").alias("titled"),
    )
    # A key of 16 bytes, not the address, is what moves and sorts.
    slim = slim.withColumn("page", F.md5("page"))
    choices = F.explode(F.create_map(F.lit("recent"), F.lit(0), F.lit("tags"), F.col("n_tags"), F.lit("title"), F.col("titled"))).alias("choice", "score")
    scored = slim.select("page", "id", "trust", "at", choices)
    best_first = [F.desc("score"), F.desc("trust"), F.desc_nulls_last("at"), F.desc("id")]
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("page", "choice").orderBy(*best_first))).where("rank = 1")
    picked = ranked.groupBy("page").agg(
        F.max(F.when(F.col("choice") == "recent", F.col("id"))).alias("recent_id"),
        F.max(F.when(F.col("choice") == "tags", F.col("id"))).alias("tags_id"),
        F.max(F.when((F.col("choice") == "title") & (F.col("score") == 1), F.col("id"))).alias("title_id"),
    )
    shared = slim.groupBy("page").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("first_id <> last_id").drop("last_id")
    return picked.join(shared, "page")


def survivors(docs: DataFrame, clock_error_from: str = "2027-01-01") -> DataFrame:
    """One record a page: id and path of its first row, time and type of its most recent trusted row, title of the most
    recent row that has one, and its fullest tags; (id, path, title, source, content_type, updated_at, tags, n_merged).

    A row whose source is null or names a page alone survives as it is, with ``n_merged`` 1; rows with a null id are left
    out, identical rows count once.
    """
    rows = docs.where(docs["id"].isNotNull()).select(*[docs[c].alias(c) for c in ("id", "path", "title", "source", "content_type", "updated_at", "tags")])
    rows = rows.dropDuplicates(["id"])
    pages = ranked_pages(docs, clock_error_from)
    roles = pages.select("page", F.explode(F.create_map(*[x for r in ("first", "recent", "tags", "title") for x in (F.lit(r), F.col(f"{r}_id"))])).alias("role", "id")).where("id is not null")
    chosen = roles.join(rows, "id")

    def of(role: str, column: str) -> Column:
        return F.max_by(F.col(column), F.when(F.col("role") == role, F.lit(1))).alias(column)

    merged = chosen.groupBy("page").agg(of("first", "id"), of("first", "path"), of("title", "title"), of("recent", "source"), of("recent", "content_type"), of("recent", "updated_at"), of("tags", "tags"))
    keyed = rows.select("id", F.md5(page_key(F.col("source"))).alias("page"))
    sizes = keyed.where("page is not null").groupBy("page").agg(F.count("*").alias("n_merged"))
    merged = merged.join(sizes, "page").drop("page")
    several = sizes.where("n_merged > 1").select("page")
    alone = rows.withColumn("page", F.md5(page_key(F.col("source")))).join(several, "page", "left_anti").drop("page").withColumn("n_merged", F.lit(1).cast("bigint"))
    return merged.unionByName(alone)
