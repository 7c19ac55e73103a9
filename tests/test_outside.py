import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from parchmint.operators import classify
from parchmint.operators.documents import debounced
from parchmint.schemas import CHANGES, LABELED
from parchmint.sources import fetch, mailbox, records, vault
from parchmint.streaming import changes as streams


def test_vault_folder(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.md").write_text("---\nid: A\ntitle: T\nupdated: 2024-01-02T00:00:00Z\ncaptured: 2024-01-01T00:00:00Z\ntags: [x]\nfoo: bar\n---\n\nbody\n")
    (tmp_path / "docs/b.md").write_text("plain")
    (tmp_path / "docs/.tmp-c.md").write_text("no")
    (tmp_path / "docs/d.txt").write_text("no")
    good = vault.read_vault(spark, str(tmp_path)).collect()
    assert [(r["id"], r["body"], r["tags"], r["extra"], r["captured_at"]) for r in good] == [("A", "body\n", ["x"], {"foo": "bar"}, dt.datetime(2024, 1, 1))]
    assert vault.broken_files(spark, str(tmp_path)).count() == 1 and vault.read_vault(spark, str(tmp_path), strict=False).count() == 2
    files = vault.read_files(spark, str(tmp_path)).select("path", "modified_at")
    before = files.where(F.col("path").endswith("a.md")).unionByName(spark.createDataFrame([("gone.md", dt.datetime(2024, 1, 1))], "path string, modified_at timestamp"))
    assert {r["kind"] for r in vault.snapshot_changes(before, files).collect()} == {"created", "deleted"}
    assert vault.pending(files, before).count() == 1


def test_examples_domains_env(spark, tmp_path):
    path = tmp_path / "l.jsonl"
    path.write_text(json.dumps({"row_id": 1, "id": "a", "label": " keep"}) + "\n\nnot json\n" + json.dumps({"row_id": 2, "label": "?"}) + "\n")
    assert records.read_labelled(spark, str(path)).collect()[0]["label"] == "KEEP" and records.read_examples(spark, str(tmp_path / "none")).count() == 0
    own = tmp_path / "d.yaml"
    own.write_text("newsletter_domains: [' Mine.example ', substack.com]\n")
    got = {(r["list"], r["domain"]): r["origin"] for r in records.load_domains(spark, str(own)).collect()}
    assert got["newsletter", "mine.example"] == "user" and got["newsletter", "substack.com"] == "bundled" and got["promo", "shopifyemail.com"] == "bundled"
    env = tmp_path / "e"
    env.write_text("# c\nA='1'\nexport B=2\nbad\n")
    assert records.read_env(str(env)) == {"A": "1", "B": "2"}
    deleted = spark.createDataFrame([("i", "email://x", "s@a", "T", "b" * 5000), ("j", "https://x", "s", "T", "b")], "id string, source string, sender_email string, title string, body string")
    records.append_feedback(deleted, str(tmp_path / "fb"))
    fb = spark.read.json(str(tmp_path / "fb")).collect()
    assert len(fb) == 1 and fb[0]["label"] == "SKIP" and len(fb[0]["body"]) == 4000


RSS = """<rss><channel><title>F</title><item><title>One</title><link>https://a.example/1</link><author>Ann</author><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item><item><title>none</title></item><item><link>https://youtu.be/abcdefghijk</link></item></channel></rss>"""
ATOM = """<feed><title>F</title><entry><title>A</title><link href="https://b.example/1" rel="alternate"/><author><name>Bo</name></author><updated>2024-01-02T03:00:00Z</updated></entry></feed>"""


def test_feed_files(spark):
    xml = spark.createDataFrame([("r", RSS), ("a", ATOM), ("x", "no xml")], "feed_url string, xml string")
    got = {r["url"]: r for r in records.feed_entries(xml).collect()}
    assert got.keys() == {"https://a.example/1", "https://youtu.be/abcdefghijk", "https://b.example/1"}
    assert got["https://a.example/1"]["published_at"] == dt.datetime(2024, 1, 1, 10) and got["https://a.example/1"]["author"] == "Ann"
    assert got["https://youtu.be/abcdefghijk"]["is_video"] and got["https://youtu.be/abcdefghijk"]["title"] == "Untitled"
    assert got["https://b.example/1"]["published_at"] == dt.datetime(2024, 1, 2, 3) and got["https://b.example/1"]["author"] == "Bo"


def test_mail_files(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(b"From: N <n@a.example>\nSubject: S\nContent-Type: text/plain\n\nHello plain\nUnsubscribe\n")
    got = mailbox.captures_of(mailbox.read_messages(spark, str(tmp_path))).first()
    assert got["content_markdown"] == "Hello plain" and got["author"] == "N" and got["captured_at"] is not None and got["url"] == "email://n@a.example/S"
    assert mailbox.search_criterion() == "UNSEEN" and mailbox.search_criterion("2024-02-03") == "UNSEEN SINCE 03-Feb-2024" and mailbox.search_criterion(raw="ALL") == "ALL"


def test_fetching(spark):
    class Fixed:
        def fetch(self, url):
            if "bad" in url:
                raise OSError("refused")
            return "<p>x</p>" * 50

    rows = spark.createDataFrame([("good",), ("bad",)], "url string")
    got = {r["url"]: (r["html"] is None, r["fetch_error"]) for r in fetch.fetched(rows, fetch.Tiers(Fixed())).collect()}
    assert got == {"good": (False, None), "bad": (True, "refused")}
    tries = []
    with pytest.raises(OSError):
        fetch.with_retries(lambda: tries.append(1) or Fixed().fetch("bad"), 3, 0)
    assert len(tries) == 3


def test_rules(spark):
    rows = [("promo@x.shopifyemail.com", None, "l", "w " * 600, None, False), ("No-Reply@a.example", None, "l", "w " * 600, True, False), ("A <a@b.substack.com>", None, None, "", None, True), ("a@b.example", "<x@substack.com>", None, "", None, True),
            ("a@b.example", None, "l", "w " * 600, None, True), ("a@b.example", None, "l", "w", None, False), ("a@b.example", None, "l", "w", True, True), ("a@b.example", None, None, "w " * 600, True, False), (None, None, None, None, None, False)]
    t = spark.createDataFrame(rows, "s string, r string, l string, p string, c boolean, want boolean")
    for r in t.withColumn("got", classify.verdict(*[F.col(c) for c in "srlpc"])).collect():
        assert r["got"] is r["want"], r


def examples(spark, n=60):
    rows = [(k, f"i{k}" if k % 7 else None, "a@b.example", "weekly letter" if k % 2 else "sale now", ("essay about turbines " if k % 2 else "discount offer buy ") * 3 + f"w{k % 5}", "KEEP" if k % 2 else "SKIP", None, None if k % 3 else "user", k) for k in range(n)]
    return spark.createDataFrame(rows, LABELED)


def test_classifier(spark, tmp_path):
    rows = examples(spark)
    done = classify.retrain(rows, rows, str(tmp_path / "m"))
    assert done.promoted and done.accuracy == 1.0
    worse = classify.retrain(rows.withColumn("label", F.when(F.col("label") == "KEEP", "SKIP").otherwise("KEEP")), rows, str(tmp_path / "m"))
    assert not worse.promoted and worse.current_accuracy == 1.0
    held = classify.stratified(rows, 10).groupBy("label").agg(F.count_if("held").alias("n")).collect()
    assert sorted(r["n"] for r in held) == [5, 5]


def test_examples_are_merged(spark):
    base = [(1, "a", None, None, "x", "KEEP", None, None, None), (2, "a", None, None, "x", "SKIP", None, None, None), (3, None, None, None, "x", "KEEP", None, None, None)]
    back = [(4, "a", None, None, "x", "SKIP", None, "u", 5), (5, "a", None, None, "x", "KEEP", None, "u", 4)]
    got = classify.merged_examples(spark.createDataFrame(base, LABELED), spark.createDataFrame(back, LABELED))
    assert sorted((r["row_id"], r["label"]) for r in got.collect()) == [(3, "KEEP"), (4, "SKIP")]


def test_scores_of_guesses(spark):
    t = spark.createDataFrame([("KEEP", "KEEP", "SKIP"), ("KEEP", "SKIP", "KEEP"), ("SKIP", "SKIP", "SKIP")], "label string, old string, new string")
    assert classify.accuracy(t, guess="new").first()["accuracy"] == pytest.approx(2 / 3)
    assert str(classify.accuracy(t.where("false"), guess="new").first()["accuracy"]) == "nan"
    assert classify.difference(t, "label", "old", "new").first().asDict() == {"good": 1, "bad": 1, "mixed": 0, "net": 0}
    assert {r["label"]: (r["n_KEEP"], r["n_SKIP"]) for r in classify.confusion(t, guess="new").collect()} == {"KEEP": (1, 1), "SKIP": (0, 1)}


def change(seq, kind, doc, second):
    return (seq, kind, doc, f"p{doc}", f"h{seq}", dt.datetime(2024, 1, 1, 0, 0, second))


def test_following_changes(spark, tmp_path):
    source, seen, errors = str(tmp_path / "log"), {}, []

    def keep(last, number):
        seen.update({r["id"]: r["content_hash"] for r in last.collect()})

    def broken(last, number):
        raise RuntimeError("index down")

    def run():
        q = streams.follow(streams.change_stream(spark, source), {"bad": broken, "good": keep}, str(tmp_path / "cp"), on_error=lambda name, e: errors.append(name))
        q.awaitTermination(60)

    spark.createDataFrame([change(1, "created", "a", 1), change(2, "updated", "a", 2), change(3, "created", "b", 1)], CHANGES).write.parquet(source)
    run()
    assert seen == {"a": "h2", "b": "h3"} and errors == ["bad"]
    spark.createDataFrame([change(4, "updated", "b", 9)], CHANGES).write.mode("append").parquet(source)
    run()
    assert seen == {"a": "h2", "b": "h4"} and len(errors) == 2


def test_streams_as_batches(spark, tmp_path):
    source = str(tmp_path / "log")
    rows = [change(1, "created", "a", 1), change(2, "updated", "a", 2), change(3, "updated", "a", 8), change(4, "created", "b", 1), change(9, "created", "z", 59)]
    spark.createDataFrame(rows, CHANGES).write.parquet(source)
    later = str(tmp_path / "later")
    spark.createDataFrame([(10, "created", "z", "pz", "h", dt.datetime(2025, 1, 1))], CHANGES).write.parquet(later)
    stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 100).parquet(source)
    out = str(tmp_path / "out")
    q = streams.debounced_stream(stream, "path").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r["path"], r["kind"], r["started_at"]) for r in spark.read.parquet(out).collect()}
    want = {(r["path"], r["kind"], r["started_at"]) for r in debounced(spark.createDataFrame(rows, CHANGES)).collect()}
    assert got <= want and want - got == {w for w in want if w[0] == "pz"}  # what the watermark has not passed stays open


def test_windows(spark):
    rows = spark.createDataFrame([change(1, "a", "x", 1), change(2, "a", "x", 3), change(3, "a", "x", 50)], CHANGES)
    assert sorted(r["n"] for r in streams.sessions(rows, "id", "occurred_at", "10 seconds").collect()) == [1, 2]
    assert sorted(r["n"] for r in streams.tumbling(rows, "occurred_at", "30 seconds").collect()) == [1, 2]
