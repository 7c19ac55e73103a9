import datetime as dt
import os
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from parchmint import staging
from parchmint.functions import text
from parchmint.operators import backend, classify, documents, feeds, jobs, vectors
from parchmint.operators.search import MOST_SEGMENTS, SearchIndex
from parchmint.plans.engine import VaultEngine
from parchmint.schemas import BODIES, FEEDS, JOBS, LABELED
from parchmint.sources import mail_server, media, vault

# Workers do not have this module: its classes travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def now():
    return F.lit("2026-01-01").cast("timestamp")


ULID = "01HZZZZZZZZZZZZZZZZZZZZZZ{}"


def writes(spark, rows):
    return spark.createDataFrame(rows, "seq bigint, body string, title string, source string, content_type string, captured_at timestamp, tags array<string>, extra map<string,string>")


def test_writes_of_one_source_apply_in_order(spark):
    rows = [(3, "c", None, "s", None, None, ["x"], None), (1, "a", "A", "s", "article", dt.datetime(2020, 1, 1), None, {"k": "1"}), (2, "b", None, "s", None, dt.datetime(2021, 1, 1), None, None)]
    made = documents.create(documents.empty(spark), writes(spark, rows), now()).docs.collect()
    assert [(r["title"], r["body"], r["tags"], r["captured_at"], r["extra"]) for r in made] == [("A", "c\n", ["x"], dt.datetime(2020, 1, 1), {"k": "1"})]


def test_upsert(spark):
    start = documents.upsert(documents.empty(spark), spark.createDataFrame([(ULID.format("0"), "one", None, "T")], "id string, body string, if_match string, title string"), now())
    held = start.docs.collect()[0]
    assert held["title"] == "T" and held["body"] == "one\n" and start.changes.first()["kind"] == "created"
    asked = [(ULID.format("0"), "two", held["content_hash"]), (ULID.format("1"), "new", None), (ULID.format("2"), "x", "some"), ("short", "x", None), (None, "x", None)]
    done = documents.upsert(start.docs, spark.createDataFrame(asked, "id string, body string, if_match string"), now())
    assert sorted((r["id"], r["kind"]) for r in done.changes.collect()) == [(ULID.format("0"), "updated"), (ULID.format("1"), "created")]
    assert sorted((str(r["id"]), r["reason"]) for r in done.conflicts.collect()) == [(ULID.format("2"), "conflict"), ("None", "bad id"), ("short", "bad id")]
    stale = documents.upsert(done.docs, spark.createDataFrame([(ULID.format("0"), "three", held["content_hash"])], "id string, body string, if_match string"), now())
    assert [tuple(r) for r in stale.conflicts.collect()] == [(ULID.format("0"), "conflict")]


def test_assets(spark):
    docs = spark.createDataFrame([("d",)], "id string")
    none = spark.createDataFrame([], "doc_id string, name string, content binary, n_bytes int")
    wanted = spark.createDataFrame([("d", 1, "../a.png", bytearray(b"1")), ("d", 2, "a.png", bytearray(b"2")), ("d", 3, "big.bin", bytearray(b"x" * 9)), ("e", 4, "a.png", bytearray(b"1"))], "doc_id string, seq bigint, name string, content binary")
    held, refused = documents.add_assets(docs, none, wanted, limit=5)
    names = {bytes(r["content"]): r["name"] for r in held.collect()}
    assert len(set(names.values())) == 2 and not any("/" in n for n in names.values())
    assert sorted((r["seq"], r["reason"]) for r in refused.collect()) == [(3, "too large"), (4, "not found")]
    again, _ = documents.add_assets(docs, held, wanted.where("seq = 2"), limit=5)
    assert again.count() == 3 == again.select("name").distinct().count()


def test_digest_counts_equal_rows(spark, tmp_path):
    one = spark.createDataFrame([("a", "h", "b")], "id string, content_hash string, body_hash string")
    digests = [documents.backup(one.unionByName(one) if k else one.limit(0), str(tmp_path / str(k))).first() for k in (0, 1)]
    assert digests[0]["digest"] != digests[1]["digest"] and digests[1]["n_docs"] == 2


def test_sample_and_totals(spark):
    rows = spark.range(100).select(F.col("id").cast("string").alias("id"), (F.col("id") % 7).cast("string").alias("source"))
    a, b, c = ([r["id"] for r in documents.sample(rows, 10, seed).collect()] for seed in (1, 1, 2))
    assert a == b != c and len(set(a)) == 10
    assert tuple(documents.duplicate_totals(rows).first()) == (100, 7, 7, 93) and tuple(documents.duplicate_totals(rows.limit(0)).first()) == (0, 0, 0, 0)


# Staging


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getConf(self):  # noqa: N802
            return type("Conf", (), {"get": lambda self, k, d: d})()

    with pytest.raises(RuntimeError):
        staging.shared_dir(type("Session", (), {"sparkContext": Context()})())


def test_scratch_leaves_nothing(spark):
    kept = staging.staged(spark.range(3), "kept")
    with staging.scratch(spark):
        assert staging.staged(spark.range(5), "gone").count() == 5
        gone = staging._made[spark.sparkContext.applicationId][-1]
    assert kept.count() == 3 and not os.path.exists(gone.removeprefix("file://"))
    assert not staging.is_small(spark.range(10), 5) and not staging.is_small(spark.range(3).select(F.repeat(F.lit("x"), 1000)), 5, 500)


# The classifier


def examples(spark, n=60):
    r = random.Random(1)
    words = {"KEEP": "essay letter harbour story reading".split(), "SKIP": "discount sale order coupon shipping".split()}
    rows = [(k, f"i{k}", "a@b.example", " ".join(r.choices(words[label], k=3)), " ".join(r.choices(words[label], k=12)), label, None, None, k) for k in range(n) for label in [("KEEP", "SKIP")[k % 2]]]
    return spark.createDataFrame(rows, LABELED)


def test_retrain_keeps_the_previous_model_and_reads_no_broken_one(spark, tmp_path):
    path = str(tmp_path / "model")
    first = classify.retrain(examples(spark), examples(spark, 20), path)
    assert first.promoted and first.accuracy == 1.0 and first.current_accuracy != first.current_accuracy
    second = classify.retrain(examples(spark), examples(spark, 20), path)
    assert second.promoted and second.current_accuracy == 1.0 and os.path.exists(f"{path}.bak/metadata")
    flipped = examples(spark).withColumn("label", F.when(F.col("label") == "KEEP", "SKIP").otherwise("KEEP"))
    assert not classify.retrain(flipped, examples(spark, 20), path).promoted and classify.retrain(flipped, examples(spark, 20), path, force=True).promoted
    assert classify.resolved_model(spark, None, str(tmp_path / "none"), path) is not None and classify.resolved_model(spark, str(tmp_path / "none")) is None
    for name in os.listdir(f"{path}/metadata"):
        os.remove(f"{path}/metadata/{name}")
    with pytest.raises(Exception):  # noqa: B017  whatever reading it says
        classify.retrain(examples(spark), examples(spark, 20), path)


def test_split_report_and_frozen_holdout(spark, tmp_path):
    quality, confusion, model = classify.split_report(examples(spark))
    assert {r["label"]: (r["n"], r["f1"]) for r in quality.collect()} == {"KEEP": (6, 1.0), "SKIP": (6, 1.0)} and confusion.count() == 2 and model is not None
    classify.freeze_holdout(examples(spark), str(tmp_path / "f"), 10)
    assert spark.read.json(str(tmp_path / "f/holdout")).count() == 10 and spark.read.json(str(tmp_path / "f/train")).count() == 50
    with pytest.raises(Exception):  # noqa: B017  the holdout is frozen
        classify.freeze_holdout(examples(spark), str(tmp_path / "f"), 10)


class Labeller:
    def label(self, sender, subject, body):
        if body == "fail":
            raise OSError("no answer")
        return " keep " if "essay" in body else "perhaps"


def test_labeller(spark):
    mail = spark.createDataFrame([(1, "s", "t", "essay"), (2, None, None, None), (3, "s", "t", "fail")], "row_id bigint, sender string, subject string, body string")
    got = {r["row_id"]: (r["label"], r["raw"], r["label_error"]) for r in classify.labelled(mail, Labeller()).collect()}
    assert got == {1: ("KEEP", " keep ", None), 2: (None, "perhaps", None), 3: (None, None, "no answer")}


# Search and vectors


def sections(spark, rows):
    return spark.createDataFrame([(d, 0, "", [], b) for d, b in rows], "doc_id string, ord int, title string, path array<string>, body string")


def test_segments_and_their_merge(spark):
    held = {f"d{k}": f"museum number {k}" for k in range(12)}
    index = SearchIndex.build(sections(spark, held.items()))
    for k in range(MOST_SEGMENTS + 2):
        held[f"d{k}"] = "museum " * (k + 2)
        index = index.replaced(spark.createDataFrame([(f"d{k}",)], "doc_id string"), sections(spark, [(f"d{k}", held[f"d{k}"])]))
        assert len(index.segments) <= MOST_SEGMENTS
    index = index.replaced(spark.createDataFrame([("d11",)], "doc_id string"), sections(spark, []))
    del held["d11"]
    whole = SearchIndex.build(sections(spark, held.items()))
    for q in ("museum", "number museum", "number"):
        got, want = ([(r["doc_id"], round(r["score"], 9)) for r in x.search(q).collect()] for x in (index, whole))
        assert got == want and got
    assert {r["doc_id"] for r in index.doc_ids().collect()} == set(held)


def test_search_leaves_no_files(spark):
    index = SearchIndex.build(sections(spark, [("a", "one two three"), ("b", "two three four")]))
    before = len(staging._made[spark.sparkContext.applicationId])
    assert [r["doc_id"] for r in index.search('"one two"', mode="fts").collect()] == ["a"]
    assert len(staging._made[spark.sparkContext.applicationId]) == before


def test_many_queries_are_one_plan(spark):
    v = spark.range(5000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.sin(F.col("id") * 7 + k).cast("float")).alias("embedding"))
    got = vectors.knn_join(v, v, 1, chunk=700)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("\n") < 60
    assert got.count() == 5000


def test_vectors_of_the_own_group_are_left_out(spark):
    v = spark.createDataFrame([(k, [float(k), 0.0], k % 2) for k in range(20)], "vec_id bigint, embedding array<float>, label int")
    got = {(r["query_id"], r["id"]) for r in vectors.knn_join(v, v.where("vec_id = 10"), 2, apart="label").collect()}
    assert got == {(10, 9), (10, 11)}


class Flaky:
    def __init__(self, dimensions=4):
        self.dimensions, self.failed = dimensions, False

    def embed(self, texts):
        if not self.failed:
            self.failed = True
            raise OSError("busy")
        return [[float(len(t))] * self.dimensions for t in texts]


def test_embedding_is_tried_again_and_checked(spark, monkeypatch):
    rows = spark.createDataFrame([("a",)], "doc_id string")
    assert vectors.embedded(rows, F.lit("abc"), Flaky(), dimensions=4).first()["embedding"] == [3.0] * 4
    with pytest.raises(Exception, match="shape"):
        vectors.embedded(rows, F.lit("abc"), Flaky(), dimensions=5).collect()


class Counting(vectors.HashingEmbedder):
    pass


def test_unchanged_sections_keep_their_vectors(spark):
    docs = spark.createDataFrame([(ULID.format(k), "p", "T", f"s{k}", "article", None, None, [], {}, "h", "b", f"# One\n\ntext {k}\n") for k in range(3)], BODIES)
    engine = VaultEngine(spark, docs, embedder=Counting(8)).rebuilt()
    marked = engine.vectors.withColumn("embedding", F.array(*[F.lit(9.0).cast("float")] * 8))
    changed = docs.withColumn("body", F.when(F.col("id") == ULID.format(1), "# One\n\nother\n").otherwise(F.col("body")))
    after = VaultEngine(spark, changed, engine.index, marked, engine.embedder).apply_changes(spark.createDataFrame([(ULID.format(0),), (ULID.format(1),)], "id string"))
    fresh = {r["doc_id"] for r in after.vectors.where("embedding[0] <> 9.0").collect()}
    assert fresh == {ULID.format(1)} and after.vectors.count() == engine.vectors.count()
    assert after.reindexed() is after and after.reindexed(force=True) is not after


# Feeds, jobs, mail, media, vault folders


def test_feed_sync(spark):
    registry = spark.createDataFrame([("f1", "u1", "Feed", ["a"], True, dt.datetime(2020, 1, 1), None, None, None), ("f2", "u2", None, [], True, dt.datetime(2020, 1, 2), None, None, None), ("f3", "u3", None, [], False, dt.datetime(2020, 1, 3), None, "old", None)], FEEDS)
    entries = spark.createDataFrame([("f1", 0, "x", "X", None, None, False), ("f1", 1, "y", "Y", "Ann", dt.datetime(2024, 1, 1), False), ("f2", 0, "z", "Z", None, None, False), ("f3", 0, "w", "W", None, None, False)], "feed_id string, pos int, url string, title string, author string, published_at timestamp, is_video boolean")
    docs = spark.createDataFrame([("d", "x")], "id string, source string")
    written = []
    pages = spark.createDataFrame([("y", "", "Body", "article", None, False), ("z", "Z", "wall", "article", None, True)], "url string, title string, content_markdown string, content_type string, author string, refused boolean")
    after, report = feeds.sync(registry, entries, docs, lambda fresh: pages.join(fresh.select("url"), "url", "left_semi"), lambda w: written.extend(w.collect()), now())
    assert {r["feed_id"]: (r["captured"], r["skipped"], r["failed"], r["status"]) for r in report.collect()} == {"f1": (1, 1, 0, "ok"), "f2": (0, 0, 1, "failed")}
    assert [(w["title"], w["source"], w["tags"], w["captured_at"], w["extra"]) for w in written] == [("Y", "y", ["a"], dt.datetime(2024, 1, 1), {"feed_id": "f1", "author": "Ann"})]
    assert {r["id"]: r["last_status"] for r in after.collect()} == {"f1": "ok", "f2": "failed", "f3": "old"}


def test_queue_settings_and_timeouts(spark):
    assert [jobs.clamped(x, jobs.WORKERS) for x in (None, 0, 5, 99)] == [1, 1, 5, 8] and jobs.clamped(5, jobs.TIMEOUT) == 10
    empty = spark.createDataFrame([], JOBS)
    q = jobs.enqueue(empty, spark.createDataFrame([("a", "u"), ("a", "u"), ("b", "v")], "id string, url string"), now())
    assert sorted((r["id"], r["status"], r["attempts"]) for r in q.collect()) == [("a", "queued", 0), ("b", "queued", 0)]
    running = jobs.claim(q, 1, F.lit("2025-12-31").cast("timestamp"))
    assert [r["error"] for r in jobs.expired(running, now()).where("status = 'failed'").collect()] == ["timed out after 90 s"]


class Box:
    def __init__(self, mails, broken=()):
        self.mails, self.broken, self.seen = mails, broken, []

    def search(self, criterion):
        return [u for u in self.mails if u not in self.seen]

    def fetch(self, uid):
        if uid in self.broken:
            raise ValueError("gone")
        return self.mails[uid]

    def mark_seen(self, uid):
        self.seen.append(uid)


def test_mail_is_acknowledged_once_stored(spark, monkeypatch):
    monkeypatch.setattr("parchmint.sources.fetch.time.sleep", lambda s: None)
    mails = {k: f"From: A <a@b.example>\r\nSubject: S{k}\r\nMessage-ID: <{k}@b.example>\r\n\r\nHello there {k}\r\n".encode() for k in (1, 2, 3)}
    box, stored = Box(mails, broken=(3,)), []

    def fail(rows):
        raise OSError("full")

    with pytest.raises(OSError):
        mail_server.ingest(spark, box, fail)
    assert box.seen == []
    rounds = list(mail_server.watch(spark, box, lambda rows: stored.extend(r["title"] for r in rows.collect()), keep=lambda c: c.where("title <> 'S2'"), rounds=2, sleep=lambda s: None))
    assert rounds == [(2, 1), (0, 0)] and stored == ["S1"] and sorted(box.seen) == [1, 2]


class Clips:
    def metadata(self, url):
        if url == "dead":
            raise OSError("404")
        return {"title": "T", "author": "A", "seconds": 4000 if url == "long" else 60}

    def captions(self, url):
        return {"cap": {"fr": "bonjour", "en": "hello"}}.get(url, {})


class Ears:
    def size(self, url):
        return 10

    def transcribe(self, url):
        return "" if url == "quiet" else "spoken"


def test_transcripts(spark):
    v = spark.createDataFrame([(u,) for u in ("cap", "talk", "long", "quiet", "dead")], "url string")
    got = {r["url"]: tuple(r)[1:] for r in media.transcribed(v, Clips(), Ears()).collect()}
    assert got["cap"] == ("hello", "captions", "T", "A", None) and got["talk"][:2] == ("spoken", "speech") and got["long"] == (None, None, "T", "A", "too long") and got["quiet"][4] == "no speech" and got["dead"][4].startswith("metadata")
    assert media.preferred({"it": "ciao", "xx": " "}) == "ciao" and media.may_transcribe(None, 26 * 2**20) == "too large"
    stub = spark.range(1).select(media.meta_stub(F.lit("Ann"), F.lit(None)).alias("s")).first()["s"]
    assert stub == f"**Ann**\n\n{media.NO_TEXT}"


def test_backends(spark, tmp_path):
    table = backend.backend_of(spark, {"VAULT_PATH": str(tmp_path / "v")})
    rows = [(1, "a", "A", "s", "article", None, None, None)]
    assert [r["kind"] for r in table.write(writes(spark, rows)).collect()] == ["created"] and table.write(writes(spark, rows)).count() == 0
    assert [r["kind"] for r in table.write(writes(spark, [(1, "b", None, "s", None, None, None, None)])).collect()] == ["updated"] and table.docs().count() == 1 and table.changes().count() == 2

    with pytest.raises(documents.StoreError):
        backend.backend_of(spark, {"BACKEND": "other"})
    got = backend.backend_of(spark, {"BACKEND": "service"}, Service()).write(writes(spark, rows + [(2, None, None, None, None, None, None, None)])).collect()
    assert sorted(r["kind"] for r in got) == ["created", "failed"]


class Service:
    def put(self, document):
        if document["body"] is None:
            raise ValueError("no body")
        return "created", "id", "p"


def test_import_goes_on_where_it_stopped(spark, tmp_path):
    folder, ledger, written = tmp_path / "in", str(tmp_path / "ledger"), []
    folder.mkdir()
    docs = spark.createDataFrame([("a/x.md", "---\nid: X\ntitle: T\n---\n\nBody\n"), ("y.md", "no metadata"), ("../z.md", "t")], "path string, text string")
    assert sorted((r["path"], r["error"]) for r in vault.write_files(docs, str(folder)).collect()) == [("../z.md", "outside the folder"), ("a/x.md", None), ("y.md", None)]
    keep = lambda d: written.extend((r["id"], r["body_hash"][:7]) for r in d.collect())
    assert tuple(vault.migrate(spark, str(folder), ledger, keep).first())[:4] == (2, 1, 1, 0)
    assert tuple(vault.migrate(spark, str(folder), ledger, keep).first())[:4] == (0, 0, 0, 2) and written == [("X", "sha256:")]
    moved = vault.snapshot_changes(spark.createDataFrame([("a", 1)], "path string, modified_at int"), spark.createDataFrame([("b", 1)], "path string, modified_at int"))
    assert sorted(tuple(r) for r in moved.collect()) == [("created", "b"), ("deleted", "a")]


def test_capture_override_and_raw_document(spark):
    engine = VaultEngine(spark, documents.empty(spark))
    html = "<html><head><title>T</title></head><body><article><p>" + "Words of a page that is long enough. " * 20 + "</p></article></body></html>"
    rows = spark.createDataFrame([("https://a.example/1", html, "F", True, {"title": " Own ", "tags": "x, y", "type": "", "key": "v"}), ("https://a.example/2", html, "F", False, None)], "url string, html string, fallback_title string, persist boolean, frontmatter map<string,string>")
    done = engine.captured(rows, now())
    made = done.docs.collect()
    assert [(r["title"], r["tags"], r["content_type"], r["extra"], r["source"]) for r in made] == [("Own", ["x", "y"], "article", {"key": "v"}, "https://a.example/1")]
    raw = VaultEngine(spark, done.docs).raw_document(made[0]["id"])
    assert raw.startswith("---\nid: ") and "key: v" in raw and "Words of a page" in raw
    assert engine.stats().first()["n_bytes"] == 0 and VaultEngine(spark, spark.createDataFrame([("é",)], "body string").withColumns({"captured_at": now(), "updated_at": now()})).stats().first()["n_bytes"] == 2


def test_safe_html(spark):
    row = spark.range(1).select(text.safe_snippet(F.lit("<b>a</b> <mark>x & y</mark> \"'")).alias("s"), text.short_id(F.lit("01HZZZZZZZZZZ")).alias("i"), text.short_date(F.lit("2024-03-05").cast("date")).alias("d")).first()
    assert tuple(row) == ("&lt;b&gt;a&lt;/b&gt; <mark>x &amp; y</mark> &quot;&#39;", "01HZZZZZZZ…", "5 Mar 2024")
