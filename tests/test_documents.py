import datetime as dt

import pytest
from pyspark.sql import functions as F

from parchmint.operators import documents, feeds, jobs
from parchmint.schemas import BODIES, CHANGES, FEEDS, JOBS, WRITES

@pytest.fixture(autouse=True)
def _times(spark):
    globals()["NOW"], globals()["LATER"] = (F.lit(t).cast("timestamp") for t in ("2024-05-01 10:00:00.5", "2024-06-01"))


def writes(spark, *rows):
    full = [dict.fromkeys(["seq", "body", "title", "source", "content_type", "captured_at", "tags", "extra"]) | {"seq": k} | r for k, r in enumerate(rows)]
    return spark.createDataFrame(full, WRITES)


def empty(spark):
    return spark.createDataFrame([], BODIES)


def test_create_is_idempotent_on_source(spark):
    first = documents.create(empty(spark), writes(spark, {"body": "one", "source": "s1", "title": "T", "captured_at": dt.datetime(2020, 1, 1)}, {"body": "note"}, {"body": "note"}), NOW)
    assert first.docs.count() == 3 and {r["kind"] for r in first.changes.collect()} == {"created"}
    again = documents.create(first.docs, writes(spark, {"body": "one\n", "source": "s1"}), LATER)
    assert again.changes.count() == 0 and again.docs.count() == 3
    changed = documents.create(first.docs, writes(spark, {"body": "two", "source": "s1", "tags": ["x"]}), LATER)
    was, now = [d.where("source = 's1'").first() for d in (first.docs, changed.docs)]
    assert (was["id"], was["path"], was["captured_at"], was["title"]) == (now["id"], now["path"], now["captured_at"], now["title"])
    assert now["body"] == "two\n" and now["tags"] == ["x"] and now["updated_at"] == dt.datetime(2024, 6, 1)
    assert changed.changes.first()["kind"] == "updated"


def test_create_applies_a_batch_in_order(spark):
    got = documents.create(empty(spark), writes(spark, {"body": "a", "source": "s", "title": "A", "extra": {"k": "1", "id": "no"}}, {"body": "b", "source": "s"}), NOW).docs.collect()
    assert len(got) == 1 and got[0]["body"] == "b\n" and got[0]["title"] == "A" and got[0]["extra"] == {"k": "1"}
    assert got[0]["path"].startswith("docs/2024/05/") and got[0]["updated_at"] == dt.datetime(2024, 5, 1, 10)


def test_update_and_delete(spark):
    docs = documents.create(empty(spark), writes(spark, {"body": "a", "source": "s", "title": "A", "extra": {"k": "1"}}), NOW).docs
    d = docs.first()
    ask = lambda i, m: spark.createDataFrame([(i, "new", m)], "id string, body string, if_match string")
    good = documents.update(docs, ask(d["id"], d["content_hash"]), LATER)
    after = good.docs.first()
    assert after["body"] == "new\n" and after["title"] == "A" and after["extra"] == {"k": "1"} and after["content_hash"] != d["content_hash"]
    assert documents.update(docs, ask(d["id"], "other"), LATER).conflicts.first()["reason"] == "conflict"
    assert documents.update(docs, ask("0" * 26, None), LATER).conflicts.first()["reason"] == "not found"
    gone = documents.delete(docs, ask(d["id"], None).drop("body"), LATER)
    change = gone.changes.first()
    assert gone.docs.count() == 0 and change["kind"] == "deleted" and change["path"] is None and change["content_hash"] is None
    assert documents.get(docs, d["id"])["title"] == "A" and documents.find_by_source(docs, "s").count() == 1
    with pytest.raises(documents.NotFound):
        documents.get(docs, "0" * 26)


def listing(spark, n=5):
    rows = [(f"{k:026d}", f"t{k}", dt.datetime(2024, 1, 1 + k // 2), dt.datetime(2024, 2, 10 - k)) for k in range(n)]
    return spark.createDataFrame(rows, "id string, title string, updated_at timestamp, captured_at timestamp")


def test_listing_by_pages(spark):
    docs, seen, cursor = listing(spark), [], None
    while True:
        page = documents.list_docs(docs, cursor=cursor, limit=2)
        seen += [r["title"] for r in page.items]
        cursor = page.cursor
        if cursor is None:
            break
    assert seen == ["t4", "t3", "t2", "t1", "t0"]
    assert [r["title"] for r in documents.list_docs(docs, order="captured_at").items] == ["t0", "t1", "t2", "t3", "t4"]
    assert len(documents.list_docs(docs, since=dt.datetime(2024, 1, 2)).items) == 3
    for bad in ({"cursor": "?"}, {"limit": 0}, {"order": "title"}):
        with pytest.raises(documents.StoreError):
            documents.list_docs(docs, **bad)
    assert documents.by_prefix(docs, "0" * 25).count() == 5 and set(documents.response(docs.withColumn("content_type", F.lit("a"))).columns) >= {"type", "captured", "updated"}


def test_duplicates_stats_integrity_assets_backup(spark, tmp_path):
    docs = documents.create(empty(spark), writes(spark, {"body": "a", "source": "s"}, {"body": "b"}), NOW).docs
    twice = docs.unionByName(docs.where("source = 's'").withColumn("id", F.lit("7" + "Z" * 25)))
    assert documents.duplicate_sources(twice).first()["n"] == 2 and documents.without_duplicates(twice).count() == 2
    assert documents.stats(docs, F.length("body")).first()["n_bytes"] == 4
    pointers = docs.where("source = 's'").select("id", "path")
    tampered = docs.withColumn("body", F.when(F.col("source") == "s", F.lit("x")).otherwise(F.col("body")))
    r = documents.integrity(tampered, pointers).first()
    assert (r["n_docs"], r["bad_id"], r["no_pointer"], r["wrong_pointer"], r["wrong_hash"]) == (2, 0, 1, 0, 1)
    names = spark.createDataFrame([("d", 1, "../a b.png"), ("d", 2, "a-b.png"), ("d", 3, "..")], "doc_id string, seq int, name string")
    assert [x["stored"] for x in documents.asset_names(names).orderBy("seq").collect()] == ["a-b.png", "a-b-1.png", "asset"]
    first = documents.backup(docs, f"{tmp_path}/b1").first()
    assert first == documents.backup(docs.repartition(3), f"{tmp_path}/b2").first() and first["n_docs"] == 2


def test_change_log(spark):
    t = dt.datetime(2024, 1, 1)
    s = dt.timedelta(seconds=1)
    rows = [(1, "created", "a", "p", "h1", t), (3, "updated", "a", "p", "h3", t + 5 * s), (2, "updated", "a", "p", "h2", t + s), (4, "updated", "a", "p", "h3", t + 5 * s), (5, "created", "b", "q", "h", t), (6, "deleted", "b", None, None, t + s)]
    log = spark.createDataFrame(rows, CHANGES)
    last = {r["id"]: (r["kind"], r["seq"]) for r in documents.latest_changes(log).collect()}
    assert last == {"a": ("updated", 4), "b": ("deleted", 6)}
    left = documents.replayed(log).collect()
    assert [(r["id"], r["content_hash"], r["n_changes"]) for r in left] == [("a", "h3", 3)]
    runs = documents.debounced(log).orderBy("path", "started_at").collect()
    assert [(r["path"], r["kind"], r["n"]) for r in runs] == [("p", "updated", 2), ("p", "updated", 2), ("q", "created", 1)]


def test_feeds(spark):
    registry = spark.createDataFrame([("f1", "u1", "N", ["b"], True, dt.datetime(2024, 1, 1), None, None, None)], FEEDS)
    wanted = spark.createDataFrame([("x", "u1", None, ["a", "b"]), ("f2", "u2", "M", None)], "id string, url string, name string, tags array<string>")
    after = {r["url"]: r for r in feeds.register(registry, wanted, NOW).collect()}
    assert (after["u1"]["id"], after["u1"]["name"], after["u1"]["tags"]) == ("f1", "N", ["a", "b"]) and after["u2"]["id"] == "f2" and after["u2"]["enabled"]
    off = feeds.set_enabled(registry, "f1", False)
    assert feeds.due(off).count() == 0 and feeds.due(registry).count() == 1 and feeds.removed(registry, "f1").count() == 0
    entries = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "url string, pos int")
    docs = spark.createDataFrame([("2", "b"), ("1", "b"), ("3", None)], "id string, source string")
    assert {r["url"]: (r["status"], r["doc_id"]) for r in feeds.preview(entries, docs, 2).collect()} == {"a": ("new", None), "b": ("skip", "1")}
    assert {r["url"] for r in feeds.new_entries(entries, docs).collect()} == {"a", "c"} and feeds.seen_entries(entries, docs).count() == 1
    outcomes = spark.createDataFrame([("f1", "captured"), ("f1", "failed"), ("f2", "failed")], "feed_id string, outcome string")
    report = {r["feed_id"]: r["status"] for r in feeds.sync_report(outcomes).collect()}
    assert report == {"f1": "ok", "f2": "failed"}
    done = feeds.synced(registry, spark.createDataFrame([("f1", "failed", "why")], "feed_id string, status string, error string"), NOW).first()
    assert (done["last_status"], done["last_error"]) == ("failed", "why") and done["last_sync_at"] is not None


def test_jobs(spark):
    row = lambda k: (f"j{k}", "u", True, None, "<p>", None, "queued", dt.datetime(2024, 1, 1, 0, 0, k // 2), None, None, None, None, None, None, 0)
    q = spark.createDataFrame([row(k) for k in (3, 2, 1, 0)], JOBS)
    assert [r["id"] for r in jobs.claimable(q, 3).collect()] == ["j0", "j1", "j2"] and jobs.depth(q).first()["queue_depth"] == 4
    q = jobs.claim(q, 2, NOW)
    assert {r["id"] for r in q.where("status = 'running' and attempts = 1").collect()} == {"j0", "j1"}
    results = spark.createDataFrame([("j0", "d", "p", "h", None), ("j1", None, None, None, "e" * 3000), ("j3", "d", "p", "h", None)], "id string, doc_id string, doc_path string, body_hash string, error string")
    done = {r["id"]: r for r in jobs.finish(q, results, LATER).collect()}
    assert done["j0"]["status"] == "done" and done["j0"]["doc_id"] == "d" and done["j1"]["status"] == "failed" and len(done["j1"]["error"]) == 2000 and done["j3"]["status"] == "queued"
    assert jobs.recovered(q).where("status = 'queued'").count() == 4
    assert "html" not in jobs.listed(q).columns and jobs.listed(q, "running", 1).count() == 1
    with pytest.raises(ValueError):
        jobs.listed(q, limit=0)
