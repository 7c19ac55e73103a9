"""Labelled examples, domain lists and feeds as files."""

from __future__ import annotations

import yaml
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.functions import urls
from parchmint.operators.classify import PLATFORMS, PROMOTIONS, domain_lists, tidy_label
from parchmint.schemas import LABELED


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Examples of JSON lines; a missing file is an empty table, blank and broken lines are dropped."""
    try:
        return spark.read.schema(LABELED).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        return spark.createDataFrame([], LABELED)


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """The examples with a label of KEEP or SKIP, in capitals."""
    return read_examples(spark, path).withColumn("label", tidy_label(F.col("label"))).where("label is not null")


def append_feedback(deleted: DataFrame, path: str) -> None:
    """Record deleted mail documents (id, sender, title, source, body) as SKIP examples."""
    mail = deleted.where(F.col("source").startswith("email://"))
    rows = mail.select("id", F.col("sender_email").alias("sender"), F.col("title").alias("subject"), F.substring("body", 1, 4000).alias("body"), F.lit("SKIP").alias("label"), F.lit("user_delete").alias("source"), F.unix_timestamp().alias("ts"))
    rows.write.mode("append").json(path)


def load_domains(spark: SparkSession, own_file: str | None = None) -> DataFrame:
    """(list, domain, origin): the bundled lists with those of a YAML file (newsletter_domains, promo_domains) added."""
    bundled = spark.createDataFrame([("newsletter", d) for d in PLATFORMS] + [("promo", d) for d in PROMOTIONS], "list string, domain string")
    own: list[tuple[str, str]] = []
    if own_file:
        with open(own_file, encoding="utf-8") as f:
            data = yaml.safe_load(f) or {}
        own = [(name, str(d)) for name in ("newsletter", "promo") for d in data.get(f"{name}_domains") or []]
    return domain_lists(bundled, spark.createDataFrame(own, "list string, domain string"))


def feed_entries(xml: DataFrame, text_col: str = "xml", feed_col: str = "feed_url") -> DataFrame:
    """(feed_url, pos, url, title, author, published_at, is_video) of RSS and Atom documents; entries without a link are skipped.

    A feed that is no XML gives no rows.
    """
    item = "STRUCT<title: STRING, link: STRING, author: STRING, creator: STRING, pubDate: STRING>"
    rss = f"STRUCT<channel: STRUCT<title: STRING, item: ARRAY<{item}>>>"
    link = "STRUCT<_href: STRING, _rel: STRING>"
    entry = f"STRUCT<title: STRING, link: ARRAY<{link}>, author: STRUCT<name: STRING>, published: STRING, updated: STRING>"
    atom = f"STRUCT<title: STRING, entry: ARRAY<{entry}>>"
    rows = xml.select(F.col(feed_col).alias("feed_url"), F.from_xml(text_col, rss, {"mode": "PERMISSIVE", "ignoreNamespace": "true"}).alias("r"), F.from_xml(text_col, atom, {"mode": "PERMISSIVE", "ignoreNamespace": "true"}).alias("a"))

    def when(value):
        bare = F.regexp_replace(F.regexp_replace(value, r"^[A-Za-z]{3}, ", ""), r" (GMT|UT|UTC|Z)$", " +0000")
        return F.coalesce(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(value))

    of_rss = rows.select("feed_url", F.posexplode("r.channel.item").alias("pos", "e")).select("feed_url", "pos", F.trim("e.link").alias("url"), F.coalesce("e.title", F.lit("Untitled")).alias("title"), F.coalesce("e.author", "e.creator").alias("author"), when(F.col("e.pubDate")).alias("published_at"))
    href = F.coalesce(F.get(F.filter("e.link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"], F.get("e.link", F.lit(0))["_href"])
    of_atom = rows.select("feed_url", F.posexplode("a.entry").alias("pos", "e")).select("feed_url", "pos", href.alias("url"), F.coalesce("e.title", F.lit("Untitled")).alias("title"), F.col("e.author.name").alias("author"), when(F.coalesce("e.published", "e.updated")).alias("published_at"))
    both = of_rss.unionByName(of_atom).where("url is not null and url <> ''")
    return both.withColumn("is_video", urls.is_video(F.col("url")))


def read_env(path: str) -> dict[str, str]:
    """KEY=VALUE lines of a file; comments and blank lines are skipped, quotes stripped."""
    out = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            key, sign, value = line.strip().partition("=")
            if sign and not key.startswith("#"):
                out[key.removeprefix("export ").strip()] = value.strip().strip("'\"")
    return out
