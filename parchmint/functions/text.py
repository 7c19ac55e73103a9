"""Text functions as Catalyst expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def _folding() -> tuple[str, str]:
    """Characters that lose accents when folded, and what remains: from Unicode's decompositions, by rule."""
    source, target = [], []
    for code in [*range(0xC0, 0x2000), *range(0x3040, 0x3100)]:
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(unicodedata.category(c) == "Mn" for c in parts[1:]):
            source.append(chr(code))
            target.append(parts[0])
    return "".join(source) + "ς", "".join(target) + "σ"


def fold(text: Column) -> Column:
    """Lower case without accents; final sigma is sigma."""
    source, target = _folding()
    lower = F.lower(text)
    return F.when(lower.rlike(r"[^\x00-\x7f]"), F.regexp_replace(F.translate(lower, source, target), r"\p{Mn}+", "")).otherwise(lower)


#: A token of the search index.
TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def tokens(text: Column) -> Column:
    """Folded maximal runs of letters, digits and private-use characters; none for null."""
    return F.coalesce(F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def words(text: Column) -> Column:
    """Lower-case runs of word characters, as a title's words are compared with a body's."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))


def slug(title: Column) -> Column:
    """A file name of at most 80 characters: word characters and hyphens; "untitled" if nothing is left."""
    s = F.regexp_replace(F.trim(F.lower(F.coalesce(title, F.lit("")))), r"(?U)[^\w\s-]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)[\s_]+", "-"), "-+", "-")
    s = F.regexp_replace(s, "^-|-$", "")
    return F.when(s == "", F.lit("untitled")).otherwise(F.substring(s, 1, 80))


def strip_markdown(body: Column) -> Column:
    """Plain text: images dropped, links as their labels, without heading marks and backticks, white space collapsed."""
    s = F.regexp_replace(body, r"!\[.*?\]\([^)]*\)", " ")
    s = F.regexp_replace(s, r"\[([^\]]+)\]\([^)]*\)", "$1")
    s = F.regexp_replace(s, r"(?m)^#+\s*", "")
    s = F.regexp_replace(F.regexp_replace(s, "`+", ""), r"(?U)\s+", " ")
    return F.trim(s)


def clean_extracted(markdown: Column) -> Column:
    """Extractor output without images, blank table rows and leading line breaks."""
    s = F.regexp_replace(markdown, r"!\[[^\]]*\]\([^)]*\)\s*\|?", "")
    s = F.regexp_replace(s, r"(?m)^[ \t]*\|[ \t|]*$\n?", "")
    return F.regexp_replace(s, r"^\n+", "")


# Lines of a newsletter's frame.
PREHEADERS = ["view in browser", "view this email", "forwarded this newsletter", "forwarded this email"]
FOOTERS = ["unsubscribe", "update your preferences", "manage your subscription", "email preferences", "you are receiving this", "this email was sent", "to stop receiving", "if you no longer wish"]
ADDRESS = r"(?i)\d+\s+\w+.*(road|street|st|ave|blvd|suite|ste|po box)"


def _holds_any(text: Column, phrases: list[str]) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | text.contains(phrase)
    return found


def clean_newsletter(markdown: Column) -> Column:
    """A newsletter's markdown without preheader lines, all from the first footer line on, and trailing addresses.

    Blank lines are collapsed to one and zero-width spaces dropped.
    """
    lines = F.filter(F.split(markdown, "\n"), lambda x: ~_holds_any(F.lower(x), PREHEADERS))
    footer = F.array_position(F.transform(lines, lambda x: _holds_any(F.lower(x), FOOTERS)), F.lit(True))
    body = F.array_join(F.when(footer > 0, F.slice(lines, F.lit(1), F.greatest(footer - 1, F.lit(0)).cast("int"))).otherwise(lines), "\n")
    body = F.replace(F.regexp_replace(body, r"\n{3,}", "\n\n"), F.lit("​"), F.lit(""))
    kept = F.split(F.rtrim(body), "\n")
    cruft = F.transform(kept, lambda x: (F.trim(x) == "") | F.trim(x).rlike(ADDRESS) | F.lower(F.trim(x)).startswith("©") | F.lower(F.trim(x)).startswith("copyright"))
    last = F.size(kept) - F.coalesce(F.array_position(F.reverse(cruft), F.lit(False)).cast("int"), F.lit(0)) + 1
    any_left = F.array_contains(cruft, False)
    return F.when(any_left, F.regexp_replace(F.array_join(F.slice(kept, F.lit(1), last), "\n"), r"^\s+|\s+$", "")).when(markdown.isNotNull(), F.lit(""))


def without_repeats(items: Column) -> Column:
    """An array without items equal to the one kept before them."""
    kept = F.aggregate(items, F.array().cast("array<string>"), lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1) == x), acc).otherwise(F.concat(acc, F.array(x))))
    return F.when(F.size(items) > 0, kept).otherwise(items)


def webvtt_text(captions: Column) -> Column:
    """Spoken text of WebVTT captions: no headers, cues, numbers, tags or immediate repetitions, joined by spaces."""
    lines = F.transform(F.split(F.trim(captions), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    said = F.filter(lines, lambda x: (x != "") & ~x.startswith("WEBVTT") & ~x.startswith("NOTE") & ~x.contains("-->") & ~x.rlike(r"^\p{Nd}+$"))
    bare = F.filter(F.transform(said, lambda x: F.trim(F.regexp_replace(x, "<[^>]+>", ""))), lambda x: x != "")
    return F.array_join(without_repeats(bare), " ")


def title_in_body(title: Column, body: Column) -> Column:
    """Whether at least half of the title's words of three letters or more are among those of the body's first 1500 characters."""
    wanted = F.array_distinct(F.filter(words(title), lambda w: F.length(w) > 2))
    held = F.size(F.array_intersect(wanted, words(F.substring(body, 1, 1500))))
    known = title.isNotNull() & body.isNotNull() & (title != "") & (body != "") & (F.size(wanted) > 0)
    return F.when(known, held / F.size(wanted) >= 0.5).otherwise(False)


def best_title(extracted: Column, og: Column, html: Column, body: Column) -> Column:
    """The extractor's title if the body bears it out, else the page's own titles, else the extractor's after all."""
    useful = lambda c: F.when(c != "", c)
    return F.when(title_in_body(extracted, body), extracted).otherwise(F.coalesce(useful(og), useful(html), extracted))


def truncated_for_embedding(text: Column, characters: int = 16_000) -> Column:
    """At most ``characters`` of a text; a space for an empty one."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(" ")).otherwise(F.substring(text, 1, characters))


def section_text(path: Column, title: Column, body: Column) -> Column:
    """What is embedded of a section: its path (or title), a blank line, its body."""
    head = F.coalesce(F.nullif(F.array_join(path, " > "), F.lit("")), title, F.lit(""))
    return F.when(head == "", F.trim(body)).otherwise(F.concat(head, F.lit("\n\n"), F.trim(body)))


def newsletter_features(sender: Column, subject: Column, body: Column) -> Column:
    """The classifier's text: sender and its domain twice, subject, the first 2000 characters of the body."""
    none = lambda c: F.coalesce(c, F.lit(""))
    domain = F.when(none(sender).contains("@"), F.substring_index(none(sender), "@", -1)).otherwise("")
    return F.concat_ws(" ", none(sender), none(sender), domain, domain, none(subject), F.substring(none(body), 1, 2000))


def safe_asset_name(name: Column) -> Column:
    """The base name with anything but letters, digits, dots, hyphens and underscores as hyphens; "asset" if nothing is left."""
    base = F.substring_index(F.replace(name, F.lit("\\"), F.lit("/")), "/", -1)
    s = F.regexp_replace(F.regexp_replace(base, r"[^A-Za-z0-9._-]+", "-"), r"^[-._]+|[-._]+$", "")
    return F.when(s == "", F.lit("asset")).otherwise(s)


def breadcrumb(path: Column) -> Column:
    """A section path without parts that repeat the one before."""
    return F.filter(path, lambda x, i: (i == 0) | (x != F.get(path, F.greatest(i - 1, F.lit(0)))))


def clipped(text: Column, characters: int = 40) -> Column:
    """A text of at most ``characters``, the last an ellipsis if it was longer."""
    return F.when(F.length(text) > characters, F.concat(F.substring(text, 1, characters - 1), F.lit("…"))).otherwise(text)


def human_bytes(n: Column) -> Column:
    """A byte count in B, KB, MB, GB or TB."""
    out = F.format_string("%d B", n.cast("bigint"))
    for power, unit in enumerate(["KB", "MB", "GB", "TB"], 1):
        out = F.when(n >= 1024**power, F.format_string(f"%.1f {unit}", n / 1024**power)).otherwise(out)
    return out


def chunk_of_chat(doc_id: Column, title: Column, body: Column, characters: int = 10_000) -> Column:
    """A document as a chat prompt quotes it."""
    return F.concat(F.lit('<doc id="'), doc_id, F.lit('" title="'), F.coalesce(title, F.lit("")), F.lit('">\n'), F.substring(body, 1, characters), F.lit("\n</doc>"))


def escaped_html(text: Column) -> Column:
    """Text in which nothing is markup."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def safe_snippet(snippet: Column) -> Column:
    """A snippet as HTML: its marks stay marks, everything else is escaped."""
    safe = escaped_html(F.coalesce(snippet, F.lit("")))
    return F.replace(F.replace(safe, F.lit("&lt;mark&gt;"), F.lit("<mark>")), F.lit("&lt;/mark&gt;"), F.lit("</mark>"))


def short_date(at: Column) -> Column:
    """A day as people read it; nothing for null."""
    return F.coalesce(F.date_format(at, "d MMM yyyy"), F.lit(""))


def short_id(doc_id: Column) -> Column:
    """The first ten characters of an id, which tell its time."""
    return F.when(F.length(doc_id) > 10, F.concat(F.substring(doc_id, 1, 10), F.lit("…"))).otherwise(doc_id)
