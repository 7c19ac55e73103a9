"""Titles, metadata, walls and main text of web pages."""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from parchmint.functions import text as T
from parchmint.functions import urls

# Marks of a wall in a page's markup, its title, and the pages of mirrors that lack a post.
WALL_MARKUP = ["challenges.cloudflare.com", "/cdn-cgi/challenge-platform/", "g-recaptcha", "h-captcha", "data-sitekey="]
WALL_TITLES = [
    "just a moment", "attention required", "access denied", "ddos protection", "verify you are", "verifying you are", "checking your browser", "security check", "404 not found", "page not found",
    "this page could not be found", "page can't be found", "page can’t be found", "this page isn't available", "this page isn’t available", "sign up | linkedin", "join linkedin", "javascript is not available",
]
MIRRORS = ["fxtwitter.com", "vxtwitter.com", "nitter.net", "nitter.privacydev.net", "twiiit.com"]
MIRROR_MISSES = ["nothing to see here", "this page doesn't exist", "this page doesn’t exist"]
#: Characters of markup that are searched, and the body below which a page without a title is a wall.
MARKUP_SCANNED, THIN_BODY = 50_000, 400


def _any(text: Column, phrases: list[str]) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | text.contains(p)
    return found


def is_wall(text: Column, title: Column, markup: Column, url: Column) -> Column:
    """Whether a page is a wall instead of an article. Nulls count as empty.

    Mirrors are judged by their own error pages and by an account in the title other than the
    address's; other pages by their markup, their title, or a missing title above a thin body.
    """
    none = lambda c: F.coalesce(c, F.lit(""))
    name, body = F.lower(F.trim(none(title))), F.trim(none(text))
    asked, served = urls.account_of_url(none(url)), urls.account_of_title(none(title))
    missing = _any(name, MIRROR_MISSES) | _any(F.lower(body), MIRROR_MISSES) | F.coalesce(asked != served, F.lit(False))
    thin = name.isin("", "untitled") & (F.length(body) < THIN_BODY)
    other = _any(F.substring(none(markup), 1, MARKUP_SCANNED), WALL_MARKUP) | _any(name, WALL_TITLES) | thin
    return F.when(_any(F.lower(none(url)), MIRRORS), missing).otherwise(other)


def _attribute(markup: Column, name: str) -> Column:
    """The content of a meta element of this property or name, whatever the order of its attributes."""
    key = rf"(?:property|name)\s*=\s*[\"']{re.escape(name)}[\"']"
    forward = [rf"(?is)<meta\b[^>]*?\b{key}[^>]*?\bcontent\s*=\s*{q}(.*?){q}" for q in ('"', "'")]
    backward = [rf"(?is)<meta\b[^>]*?\bcontent\s*=\s*{q}([^{q}]*?){q}[^>]*?\b{key}" for q in ('"', "'")]
    return F.coalesce(*[F.nullif(F.regexp_extract(markup, p, 1), F.lit("")) for p in forward + backward])


@F.pandas_udf(StringType())
def unescaped(values: pd.Series) -> pd.Series:
    """Entities as characters."""
    return values.map(lambda v: html_lib.unescape(v).strip() if isinstance(v, str) else None)


def og_title(markup: Column) -> Column:
    return unescaped(_attribute(markup, "og:title"))


def html_title(markup: Column) -> Column:
    return unescaped(F.nullif(F.regexp_extract(markup, r"(?i)<title[^>]*>([^<]+)</title>", 1), F.lit("")))


def meta_content(markup: Column, name: str) -> Column:
    return unescaped(_attribute(markup, name))


class _Markdown(HTMLParser):
    """Markdown of the page's main text: furniture elements are skipped, block elements separate."""

    SKIP = {"script", "style", "noscript", "head", "nav", "footer", "aside", "form", "button", "svg", "iframe", "template"}
    BLOCK = {"p", "div", "section", "article", "main", "ul", "ol", "table", "tr", "blockquote", "pre", "figure", "header"}
    VOID = {"br", "img", "hr", "meta", "link", "input", "source", "area", "base", "col", "embed", "track", "wbr"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden: list[str] = []
        self.links: list[tuple[str, int]] = []
        self.pre = 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if self.hidden:
            if tag not in self.VOID:
                self.hidden.append(tag)
            return
        style, cls = a.get("style") or "", a.get("class") or ""
        if tag in self.SKIP or re.search(r"display:\s*none|max-height:\s*0|overflow:\s*hidden", style) or re.search(r"preheader|preview-text", cls):
            if tag not in self.VOID:
                self.hidden.append(tag)
            return
        if re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag == "blockquote":
            self.out.append("\n\n> ")
        elif tag in self.BLOCK:
            self.out.append("\n\n")
        elif tag == "a":
            self.links.append((a.get("href") or "", len(self.out)))
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("*")

    def handle_endtag(self, tag):
        if self.hidden:
            if tag in self.hidden:
                while self.hidden.pop() != tag:
                    pass
            return
        if tag == "a" and self.links:
            href, at = self.links.pop()
            label = "".join(self.out[at:]).strip()
            del self.out[at:]
            self.out.append(f"[{label}]({href})" if href and label else label)
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("*")
        elif tag == "pre" and self.pre:
            self.pre -= 1
            self.out.append("\n```\n\n")
        elif tag in self.BLOCK or re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def to_markdown(markup: str) -> str:
    """Markdown of one page or mail body."""
    parser = _Markdown()
    parser.feed(markup)
    parser.close()
    text = re.sub(r"[ \t]+\n", "\n", "".join(parser.out))
    text = re.sub(r"\n[ \t]+(?=\S)", "\n", text) if "```" not in text else text
    return re.sub(r"\n{3,}", "\n\n", text).strip()


@F.pandas_udf(StringType())
def markdown_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Markdown of pages; null for null."""
    for values in batches:
        yield values.map(lambda v: to_markdown(v) if isinstance(v, str) else None)


def article(markup: Column, url: Column, fallback_title: Column) -> Column:
    """A page as a capture: title, markdown, and whether it is a wall or empty, to be refused."""
    body = T.clean_extracted(markdown_of(markup))
    heading = F.nullif(F.trim(F.regexp_extract(body, r"(?m)^#\s+(.+)$", 1)), F.lit(""))
    title = T.best_title(heading, og_title(markup), html_title(markup), body)
    named = F.coalesce(title, fallback_title, F.lit("Untitled"))
    return F.struct(url.alias("url"), named.alias("title"), body.alias("content_markdown"), F.lit("article").alias("content_type"), (is_wall(body, title, markup, url) | (F.trim(body) == "")).alias("refused"))


def video_stub(markup: Column) -> Column:
    """What a video page's own metadata say where there is no transcript: author line and description."""
    author, description = meta_content(markup, "author"), meta_content(markup, "og:description")
    return F.concat_ws("\n\n", F.when(author.isNotNull(), F.concat(F.lit("**Author**: "), author)), F.coalesce(description, F.lit("*No transcript available.*")))
