import random
import re
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchmint.operators import vectors
from parchmint.operators.search import SearchError, SearchIndex, bm25_scan, compile_query
from parchmint.operators.sections import parse_sections, sections_of
from parchmint.plans.engine import VaultEngine, reranked, unchanged_sections
from parchmint.schemas import BODIES

VOCABULARY = "alpha beta gamma delta epsilon zeta eta theta café go-to x1".split()


def split(t):
    return re.findall(r"[^\W_]+", t.lower().replace("é", "e"))


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(4)
    return [(f"d{k // 2:03d}", k % 2, " ".join(r.choices(VOCABULARY, k=r.randint(0, 3))), " ".join(r.choices(VOCABULARY, k=r.randint(0, 25)))) for k in range(240)]


@pytest.fixture(scope="module")
def index(spark, corpus):
    rows = spark.createDataFrame(corpus, "doc_id string, ord int, title string, body string").withColumn("path", F.array("title"))
    return SearchIndex.build(rows)


@pytest.fixture(scope="module")
def fts(corpus):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(doc_id unindexed, ord unindexed, title, body, tokenize=\"unicode61 remove_diacritics 2\")")
    con.executemany("insert into t values (?, ?, ?, ?)", corpus)
    return con


def same(index, fts, tree, match):
    got = {(r["doc_id"], r["ord"]): r["score"] for r in index.matches(tree).collect()}
    want = {(d, int(o)): s for d, o, s in fts.execute("select doc_id, ord, bm25(t, 0, 0, 5.0, 1.0) from t where t match ?", (match,))}
    assert got.keys() == want.keys(), match
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9), (match, k)


@pytest.mark.parametrize(
    "match",
    [
        "alpha", "alpha beta", "alpha OR beta", "alpha NOT beta", "(alpha beta) OR gamma", "alpha AND (beta OR gamma) NOT delta", '"alpha beta"', "alp*", '"beta ga"*', "title:alpha", "{title}: alpha OR body: beta", "-title: gamma",
        "^alpha", "alpha + beta", "NEAR(alpha beta, 2)", "NEAR(alpha beta gamma, 5)", "cafe", "CAFÉ", "title : (alpha OR beta)", "alpha NOT (beta OR gamma)", "zeta eta theta",
    ],
)
def test_syntax_as_fts5(index, fts, match):
    same(index, fts, compile_query(match, "fts", split), match)


def test_random_trees_as_fts5(index, fts):
    r = random.Random(9)

    def tree(depth, terms):
        if depth == 0 or r.random() < 0.2:
            return terms.pop()
        return f"({tree(depth - 1, terms)} {r.choice(['AND', 'OR', 'NOT'])} {tree(depth - 1, terms)})"

    for _ in range(10):  # a term at most once: repeated, the other engine counts some of its places once
        match = tree(3, r.sample(["alpha", "beta", "gamma", "delta", "zeta", '"eta theta"', "ep*", "x1"], 8))
        same(index, fts, compile_query(match, "fts", split), match)


@pytest.mark.parametrize("text, match", [("the alpha, beta", "alpha OR beta"), ("alpha,beta gamma", "(alpha AND beta) OR gamma"), ("go-to {x1}!", "go OR x1"), ("the of", "the OR of"), ("a.b alpha", '"a.b" OR alpha')])
def test_any_mode(index, fts, text, match):
    same(index, fts, compile_query(text, "any", split), match)


@pytest.mark.parametrize("text, match", [("alpha beta", '"alpha" "beta"'), ("alpha,beta gamma", '"alpha beta" "gamma"'), ("alpha OR beta", '"alpha" "OR" "beta"')])
def test_substring_mode(index, fts, text, match):
    same(index, fts, compile_query(text, "substring", split), match)


@pytest.mark.parametrize("text, mode", [("", "any"), ("  ", "fts"), ("a", "nope"), ("?!", "any"), ("alpha AND", "fts"), ("(alpha", "fts"), ("nope: alpha", "fts"), ("alpha ; beta", "fts")])
def test_refused(text, mode):
    with pytest.raises(SearchError):
        compile_query(text, mode, split)


def test_search_rows_and_limits(index):
    rows = index.search("alpha", 5).collect()
    assert len(rows) == 5 and rows == sorted(rows, key=lambda r: (r["score"], r["doc_id"]))
    assert any("<mark>alpha</mark>" in r["snippet"] for r in rows)
    with pytest.raises(SearchError):
        index.search("alpha", 0)


def test_replacing_documents(spark, index, corpus):
    new = spark.createDataFrame([("d000", 0, "", ["x"], "unheardof word")], "doc_id string, ord int, title string, path array<string>, body string")
    after = index.replaced(spark.createDataFrame([("d000",), ("d001",)], "doc_id string"), new)
    assert after.doc_ids().count() == 119 and after.search("unheardof").count() == 1


def test_scan_equals_index(spark, index, corpus):
    rows = spark.createDataFrame([(f"{d}/{o}", f"{b}") for d, o, t, b in corpus], "id string, text string")
    alone = SearchIndex.build(rows.select(F.col("id").alias("doc_id"), F.lit(0).alias("ord"), F.lit("").alias("title"), F.array().cast("array<string>").alias("path"), F.col("text").alias("body")))
    a = {r["id"]: round(r["score"], 9) for r in bm25_scan(rows, "id", "text", ["alpha", "zeta"]).collect()}
    b = {r["doc_id"]: round(r["score"], 9) for r in alone.matches(compile_query("alpha zeta", "any", split)).collect()}
    assert a == b


# Sections


def test_sections():
    s = parse_sections("intro\n\n# One\na\n## Two\nb\n### Three\n# Four\n", "Doc")
    assert [(x["level"], x["title"], x["path"]) for x in s] == [(0, None, ["Doc"]), (1, "One", ["Doc", "One"]), (2, "Two", ["Doc", "One", "Two"]), (3, "Three", ["Doc", "One", "Two", "Three"]), (1, "Four", ["Doc", "Four"])]
    assert s[0]["body"] == "intro\n\n" and s[1]["body"] == "a\n"
    assert parse_sections("") == [{"level": 0, "title": None, "path": [], "body": ""}]
    fenced = parse_sections("```\n# no\n~~~\n```\n# yes\n~~~\n# no\n")
    assert [x["title"] for x in fenced] == [None, "yes"]
    under = parse_sections("Title\n=====\ntext\nSub\n-\nmore\n---\n")
    assert [(x["level"], x["title"]) for x in under] == [(0, None), (1, "Title"), (2, "Sub"), (2, "more")]
    odd = parse_sections("#x\n####### y\n # z\n# C#\n## tail ##\n#  \n")
    assert [x["title"] for x in odd] == [None, "C#", "tail", ""]
    assert parse_sections("### deep\n# top\n## sub")[3]["path"] == ["top", "sub"]


def test_sections_of_table(spark):
    rows = spark.createDataFrame([("a", "T", "x\n# H\ny"), ("b", None, None), ("c", "", "")], "id string, title string, body string")
    got = sections_of(rows).orderBy("doc_id", "ord").collect()
    assert [(r["doc_id"], r["ord"], r["title"], r["path"]) for r in got] == [("a", 0, None, ["T"]), ("a", 1, "H", ["T", "H"]), ("c", 0, None, [])]


# Vectors


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_knn_join(spark, metric):
    r = np.random.default_rng(1)
    v = r.normal(size=(200, 8)).astype(np.float32)
    v[7] = v[3]
    table = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id bigint, embedding array<float>").repartition(3)
    d = np.sqrt(((v[:, None].astype(float) - v[None]) ** 2).sum(2)) if metric == "l2" else 1 - (v.astype(float) @ v.T) / np.outer(np.linalg.norm(v, axis=1), np.linalg.norm(v, axis=1))
    got = {(x["query_id"], x["rank"]): x["id"] for x in vectors.knn_join(table, table.where("vec_id % 50 = 3"), 5, metric).collect()}
    for q in (3, 53, 103, 153):
        order = sorted((round(d[q, j], 9), j) for j in range(200) if j != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [j for _, j in order]
    one = vectors.knn(table, [float(x) for x in v[3]], 4, metric, "vec_id").collect()
    assert {x["vec_id"] for x in one[:2]} == {3, 7}
    assert vectors.knn_join(table, table.where("false"), 5).count() == 0


def test_knn_refuses_other_dimensions(spark):
    t = spark.createDataFrame([(1, [1.0, 2.0])], "doc_id int, embedding array<float>")
    with pytest.raises(Exception, match="dimensions"):
        vectors.knn(t, [1.0], 1).collect()
    with pytest.raises(ValueError):
        vectors.knn(t, [1.0, 1.0], 0)


def test_centroids(spark):
    t = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("z", [0.0, 0.0]), ("n", None)], "doc_id string, embedding array<float>")
    got = {r["doc_id"]: r["centroid"] for r in vectors.centroids(t).collect()}
    assert got["a"] == pytest.approx([2**-0.5] * 2) and got["z"] == [0, 0] and "n" not in got
    with pytest.raises(LookupError):
        vectors.related(t, "nobody")


def test_fusion(spark):
    a = spark.createDataFrame([("x", 0), ("y", 1), ("x", 2)], "key string, pos int")
    b = spark.createDataFrame([("z", 0), ("y", 1)], "key string, pos int")
    got = [(r["key"], round(-r["score"], 9)) for r in vectors.fused(a, b).collect()]
    assert got == [("x", round(1 / 61 + 1 / 63, 9)), ("y", round(2 / 62, 9)), ("z", round(1 / 61, 9))]


def test_rerank(spark):
    c = spark.createDataFrame([(k, f"d{k}", -1.0) for k in range(4)], "pos int, doc_id string, score double")
    assert [r["doc_id"] for r in reranked(c, {2: 9.0, 1: 9.0}, 3).collect()] == ["d1", "d2", "d0"]
    assert [r["doc_id"] for r in reranked(c, None, 2).collect()] == ["d0", "d1"]


def test_engine(spark):
    rows = [(f"{k:026d}", f"Title {k}", f"intro {w}\n# Part\nabout {w} and {w}\n") for k, w in enumerate(["turbines", "gardens", "ferries", "turbines today"])]
    docs = spark.createDataFrame(rows, "id string, title string, body string")
    docs = docs.select("id", F.lit(None).cast("string").alias("path"), "title", *[F.lit(None).cast(t).alias(c) for c, t in (("source", "string"), ("content_type", "string"))], F.lit("2024-01-01").cast("timestamp").alias("captured_at"), F.lit("2024-01-01").cast("timestamp").alias("updated_at"), F.array().cast("array<string>").alias("tags"), F.create_map().cast("map<string,string>").alias("extra"), F.lit("c").alias("content_hash"), F.lit("b").alias("body_hash"), "body")
    calls = []

    def judge(query, items):
        calls.append(len(items))
        return {items[-1][0]: 10.0}

    e = VaultEngine(spark, docs, embedder=vectors.HashingEmbedder(32), rerank=judge).rebuilt()
    assert {r["doc_id"] for r in e.search("turbines").collect()} == {rows[0][0], rows[3][0]}
    for mode in ("semantic", "hybrid"):
        assert e.search("turbines", 3, mode).count() == 3
    assert e.hybrid("turbines", 2).count() == 2 and calls
    assert e.best_sections(e.search("turbines")).count() == 2
    assert all(r["doc_id"] != rows[0][0] for r in e.related(rows[0][0], 3).collect())
    context = e.chat_context([rows[1][0], "unknown", rows[1][0]], 10).first()["context"]
    assert context.count("<doc id") == 2 and "intro gard" in context
    later = VaultEngine(spark, docs.where(F.col("id") != rows[0][0]), e.index, e.vectors, e.embedder).apply_changes(spark.createDataFrame([(rows[0][0],)], "id string"))
    assert {r["doc_id"] for r in later.search("turbines").collect()} == {rows[3][0]} and later.vectors.count() == 6
    assert VaultEngine(spark, docs, e.index).search("turbines", 5, "hybrid").count() > 0
    with pytest.raises(SearchError):
        VaultEngine(spark, docs, e.index).hybrid("turbines")
    hashes = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1")], "doc_id string, content_hash string")
    assert [r["doc_id"] for r in unchanged_sections(hashes, hashes.where("content_hash = '1' or doc_id = 'a'").where("doc_id = 'a'")).collect()] == ["a"]
    assert spark.createDataFrame([], BODIES).count() == 0
