"""What kind of page an address names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Address patterns.
VIDEO_IDS = [r"(?:youtube\.com/watch\?v=|youtu\.be/)([\w-]{11})", r"youtube\.com/embed/([\w-]{11})", r"youtube\.com/shorts/([\w-]{11})"]
POSTS = [r"://(?:www\.)?linkedin\.com/posts/", r"://(?:www\.)?linkedin\.com/feed/update/urn:li:(ugcPost|activity):\d+", r"://(?:www\.)?linkedin\.com/video/[^/]+", r"://(?:www\.)?linkedin\.com/embed/feed/update/urn:li:(ugcPost|activity):\d+"]
ACCOUNT_IN_URL = r"(?i)(?:twitter\.com|x\.com|fxtwitter\.com|vxtwitter\.com|nitter\.[\w.-]+|twiiit\.com)/([A-Za-z0-9_]+)/status/"
ACCOUNT_IN_TITLE = r"\(@([A-Za-z0-9_]+)\)"


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def video_id(url: Column) -> Column:
    """The id by which a video address is routed; null if it is none."""
    return F.coalesce(*[_first(url, p) for p in VIDEO_IDS])


def is_video(url: Column) -> Column:
    return video_id(url).isNotNull()


def is_post(url: Column) -> Column:
    """Whether an address is a post of the network that needs a login."""
    return F.coalesce(url.rlike("|".join(POSTS)), F.lit(False))


def watched_id(url: Column) -> Column:
    """The video id by the wider grammar of the player: short hosts, the v parameter, shorts, embed and live paths."""
    host = F.lower(F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1))
    short = _first(url, r"^[a-z]+://[^/?#]*/([^/?#]+)")
    return F.when(host.endswith("youtu.be"), short).when(host.contains("youtube.com"), F.coalesce(_first(url, r"[?&]v=([^&#]+)"), _first(url, r"^[a-z]+://[^/?#]*/(?:shorts|embed|live)/([^/?#]+)")))


def account_of_url(url: Column) -> Column:
    return F.lower(_first(url, ACCOUNT_IN_URL))


def account_of_title(title: Column) -> Column:
    return F.lower(_first(title, ACCOUNT_IN_TITLE))


def route(url: Column, has_html: Column) -> Column:
    """Which extractor an address goes to: video, post, html or fetch."""
    return F.when(is_video(url), "video").when(is_post(url), "post").when(has_html, "html").otherwise("fetch")


def host(url: Column) -> Column:
    """Host without case, port and leading www.; null if there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(F.regexp_replace(found, r"^www\.", ""), F.lit(""))
