import datetime as dt

import pytest
from pyspark.sql import functions as F

from parchmint.functions import frontmatter, hashing, mail, pages, text, urls


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "title, slug",
    [("Hello, World!", "hello-world"), ("  a_b  c -- d ", "a-b-c-d"), ("Café déjà", "café-déjà"), ("!!!", "untitled"), (None, "untitled"), ("x" * 100, "x" * 80)],
)
def test_slug(spark, title, slug):
    assert value(spark, text.slug(F.lit(title).cast("string"))) == slug


def test_tokens_fold_case_accents_and_final_sigma(spark):
    assert value(spark, text.tokens(F.lit("CAFÉ Straße, ΛΌΓΟΣ ét 42²"))) == ["cafe", "straße", "λογοσ", "et", "42²"]
    assert value(spark, text.tokens(F.lit(None).cast("string"))) == []


def test_strip_markdown(spark):
    assert value(spark, text.strip_markdown(F.lit("# Head\n![x](y) see [the  page](u) `code`\n\nend"))) == "Head see the page code end"


def test_clean_newsletter(spark):
    body = "View this email in your browser\n# News\n\n\n\nText​ here\n© 2024 Us\n12 Main Street, Town\n\nUnsubscribe here\nlost"
    assert value(spark, text.clean_newsletter(F.lit(body))) == "# News\n\nText here"
    assert value(spark, text.clean_newsletter(F.lit("Unsubscribe"))) == ""
    assert value(spark, text.clean_newsletter(F.lit(None).cast("string"))) is None


def test_webvtt(spark):
    vtt = "WEBVTT\n\n1\n00:01.000 --> 00:02.000\n<v A>Hello</v>\nHello\n\n2\n00:03.000 --> 00:04.000\nthere\nHello"
    assert value(spark, text.webvtt_text(F.lit(vtt))) == "Hello there Hello"
    assert value(spark, text.webvtt_text(F.lit("WEBVTT"))) == ""


def test_breadcrumb_and_repeats(spark):
    path = F.array(*[F.lit(x) for x in "aabba"])
    assert value(spark, text.breadcrumb(path)) == ["a", "b", "a"] == value(spark, text.without_repeats(path))


def test_titles(spark):
    pick = lambda *a: value(spark, text.best_title(*[F.lit(x).cast("string") for x in a]))
    assert pick("Big Turbine", "Other", "Html", "the big turbine runs") == "Big Turbine"
    assert pick("Appendix", "Other", "Html", "the big turbine runs") == "Other"
    assert pick("Appendix", "", "Html", "body") == "Html"
    assert pick("Appendix", None, None, "body") == "Appendix"


def test_hashes(spark):
    assert value(spark, hashing.body_hash(F.lit("a"))) == value(spark, hashing.body_hash(F.lit("a\n")))
    assert value(spark, hashing.section_hash(F.lit(None).cast("string"), F.lit("b"))) == value(spark, hashing.digest(F.lit("\0b")))
    made = value(spark, hashing.ulid(F.lit("2024-01-01").cast("timestamp"), F.lit(1)))
    assert value(spark, hashing.is_ulid(F.lit(made))) and made == value(spark, hashing.ulid(F.lit("2024-01-01").cast("timestamp"), F.lit(1)))
    assert made < value(spark, hashing.ulid(F.lit("2024-01-02").cast("timestamp"), F.lit(0)))


def test_urls(spark):
    assert value(spark, urls.video_id(F.lit("https://youtu.be/abcdefghijk?x=1"))) == "abcdefghijk"
    assert value(spark, urls.video_id(F.lit("https://youtube.com/live/abcdefghijk"))) is None
    assert value(spark, urls.watched_id(F.lit("https://youtube.com/live/abcdefghijk"))) == "abcdefghijk"
    assert value(spark, urls.route(F.lit("https://www.linkedin.com/posts/x-1"), F.lit(True))) == "post"
    assert value(spark, urls.route(F.lit("https://a.example/"), F.lit(False))) == "fetch"
    assert value(spark, urls.host(F.lit("HTTP://www.A.example:80/x"))) == "a.example"


@pytest.mark.parametrize(
    "body, title, markup, url, wall",
    [
        ("x" * 500, "Just a moment...", None, None, True),
        ("x" * 500, "Fine", "<div class='g-recaptcha'>", None, True),
        ("short", "", None, None, True),
        ("short", "Real title", None, None, False),
        ("x" * 500, "Page can’t be found", None, None, True),
        ("a post", "Ann (@ann)", None, "https://fxtwitter.com/ann/status/1", False),
        ("a post", "Bob (@bob)", None, "https://fxtwitter.com/ann/status/1", True),
        ("Looks like this page doesn't exist.", "Nothing", None, "https://nitter.net/ann/status/1", True),
        (None, None, None, None, True),
    ],
)
def test_walls(spark, body, title, markup, url, wall):
    assert value(spark, pages.is_wall(*[F.lit(x).cast("string") for x in (body, title, markup, url)])) is wall


def test_page_titles_and_markdown(spark):
    html = "<html><head><title>A &amp; B</title><meta content='Real &quot;one&quot;' property='og:title'></head><body><nav>menu</nav><h1>Real one</h1><p>Some <b>bold</b> <a href='/x'>link</a></p><ul><li>a</li><li>b</li></ul></body></html>"
    assert value(spark, pages.html_title(F.lit(html))) == "A & B"
    assert value(spark, pages.og_title(F.lit(html))) == 'Real "one"'
    assert value(spark, pages.markdown_of(F.lit(html))) == "# Real one\n\nSome **bold** [link](/x)\n\n- a\n- b"
    got = value(spark, pages.article(F.lit(html), F.lit("https://a.example"), F.lit("f")))
    assert got["title"] == "Real one" and not got["refused"]
    assert value(spark, pages.article(F.lit("<p></p>"), F.lit("u"), F.lit("f")))["refused"]


def test_frontmatter():
    meta, body = frontmatter.split("---\ntitle: A\ntags: [x]\n---\n\nbody\n")
    assert (meta, body) == ({"title": "A", "tags": ["x"]}, "body\n")
    assert frontmatter.split(frontmatter.join({"z": 1, "id": "i", "title": "ü"}, "b"))[0] == {"id": "i", "title": "ü", "z": 1}
    assert frontmatter.join({"z": 1, "id": "i"}, "").startswith("---\nid: i\nz: 1\n")
    assert frontmatter.split("---\ntitle: A\n---") == ({"title": "A"}, "")
    for broken in ("no", "---\ntitle: A\n", "---\n- a\n---\n", "---\n: : :\n---\n"):
        with pytest.raises(frontmatter.FrontmatterError):
            frontmatter.split(broken)
        assert frontmatter.parse_row(broken, True)["error"] and frontmatter.parse_row(broken, False)["body"] == broken
    assert frontmatter.stamp("2024-01-01T02:00:00+02:00") == dt.datetime(2024, 1, 1) and frontmatter.stamp("?") is None


RAW = b"junk line\nFrom: \"Ann Lee\" <ann@a.example>\nSubject: Hi\nMessage-ID: <1@a>\nDate: Mon, 01 Jan 2024 10:00:00 +0100\nList-Id: <l.a.example>\nContent-Type: text/html\n\n<h1>Hi</h1><p>Body text</p><p>Unsubscribe</p>"


def test_mail(spark):
    got = mail.parse_message(RAW)
    assert got["url"] == "email://msg-id/1@a" and got["author"] == "Ann Lee" and got["sender_email"] == "ann@a.example"
    assert got["captured_at"] == dt.datetime(2024, 1, 1, 9) and got["html_markdown"].startswith("Body text") and got["list_id"]
    assert value(spark, mail.author_of(F.lit("Ann <a@b.example>"))) == "Ann" and value(spark, mail.address_of(F.lit("a@b.example"))) == "a@b.example"
    assert value(spark, mail.domain_of(F.lit("a@B.example"))) == "b.example"
