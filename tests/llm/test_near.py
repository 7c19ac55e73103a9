import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchmint.llm import near_dup, shingles, split_overlap


def text_of(r, n):
    return " ".join(r.choice("abcdefghijklmnopqrstuvwxyz") + str(r.randint(0, 400)) for _ in range(n))


def edited(r, text, share):
    words = text.split()
    for k in range(len(words)):
        if r.random() < share:
            words[k] = "new" + str(r.randint(0, 9999))
    return " ".join(words)


def likeness(a, b, size):
    runs = [set(zip(*[w[k:] for k in range(size)])) for w in (shingles.words(a), shingles.words(b))]
    return len(runs[0] & runs[1]) / len(runs[0] | runs[1]) if all(runs) else 0


def brute(rows, size, least, min_words):
    rows = sorted({(i, t) for i, t in rows if i is not None and t and len(shingles.words(t)) >= max(size, min_words)})
    return {(a, b) for a, x in rows for b, y in rows if a < b and likeness(x, y, size) >= least}


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    out = [(k, text_of(r, r.randint(60, 150))) for k in range(60)]
    for k in range(40):
        out.append((100 + k, edited(r, out[r.randrange(len(out))][1], r.choice([0, 0.01, 0.03, 0.06]))))
    return out + [(500, None), (501, ""), (502, "too short"), (None, out[0][1]), out[0], out[1], (503, out[0][1].upper() + " ..."), (504, text_of(r, 30_000))]


@pytest.mark.parametrize("size, least, crowd", [(3, 0.6, 2048), (3, 0.6, 2), (5, 0.8, 2048), (5, 0.8, 1)])
def test_pairs_as_brute_force(spark, rows, size, least, crowd):
    table = spark.createDataFrame([(t, i, 1, "x") for i, t in rows], "text string, key bigint, a int, cls string").repartition(3)
    found = near_dup.near_duplicates(table, "key", "text", least, size, 20, recall=0.9999, crowd=crowd, slack=None if crowd == 1 else near_dup.SLACK)
    got = [tuple(r) for r in found.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, size, least, 20)


def test_groups_are_connected_components(spark, rows):
    table = spark.createDataFrame(rows, "key bigint, text string")
    found = near_dup.near_duplicates(table, "key", "text", 0.6, 3, 20, recall=0.9999)
    got = {r["id"]: r["group_id"] for r in near_dup.groups(found).collect()}
    parent = {i: i for i in got}

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for a, b in brute(rows, 3, 0.6, 20):
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {i: root(i) for i in got} and 502 not in got


def test_long_chain_of_groups(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a bigint, b bigint")
    got = {r["cls"]: r["root"] for r in near_dup.components(links).collect()}
    assert set(got.values()) == {0, 100} and len(got) == 63


def test_empty_and_string_ids(spark):
    none = spark.createDataFrame([], "key string, text string")
    found = near_dup.near_duplicates(none, "key", "text")
    assert found.pairs().count() == 0 and near_dup.groups(found).count() == 0
    r = random.Random(1)
    t = text_of(r, 80)
    some = spark.createDataFrame([("b", t), ("a", t), ("c", text_of(r, 80))], "key string, text string")
    assert [tuple(x) for x in near_dup.near_duplicates(some, "key", "text").pairs().collect()] == [("a", "b")]


def test_bands_reach_their_recall():
    for threshold in (0.6, 0.8):
        b = near_dup.Bands.for_threshold(threshold)
        assert 1 - (1 - threshold**b.rows) ** b.count >= 0.99


def test_signatures_estimate_likeness():
    r = random.Random(5)
    signer, hashes = near_dup.Signer(near_dup.Bands.for_threshold(0.6)), shingles.WordHashes()
    for share in (0.0, 0.02, 0.1):
        a = text_of(r, 200)
        b = edited(r, a, share)
        va, vb = signer.values([shingles.shingle_set(shingles.words(t), hashes) for t in (a, b)])
        assert abs((va == vb).mean() - likeness(a, b, 3)) < 0.12


@pytest.mark.parametrize("most", [split_overlap.SMALL_INDEX, 0])
def test_split_overlap_as_brute_force(spark, rows, most, monkeypatch):
    monkeypatch.setattr(split_overlap, "SMALL_INDEX", most)  # 0: the index is shuffled
    r = random.Random(8)
    held = [(1000 + k, edited(r, rows[k % 60][1], r.choice([0, 0.02, 0.05, 0.3])), r.choice(["x", "y", None])) for k in range(50)] + [(2000, None, "x"), (2001, "", "x"), (2002, rows[0][1], "x"), (2002, rows[0][1], "x")]
    train = spark.createDataFrame([(i, t, "extra") for i, t in rows], "row_id bigint, body string, side string")
    evaluation = spark.createDataFrame([(i, t, s, "src") for i, t, s in held], "row_id bigint, body string, split string, source string")
    for size, least in ((3, 0.6), (5, 0.8)):
        got = [tuple(x)[:2] for x in split_overlap.split_overlap(train, evaluation, "row_id", "body", least, size, 20).pairs().collect()]
        want = {(a, b) for a, x in rows for b, y, _ in held if a is not None and x and y and min(len(shingles.words(x)), len(shingles.words(y))) >= 20 and likeness(x, y, size) >= least}
        assert len(got) == len(set(got)) and set(got) == want
    overlap = split_overlap.split_overlap(train, evaluation, "row_id", "body", 0.6, 3, 20)
    report = split_overlap.report(overlap, evaluation, "row_id", "split", "source").collect()
    assert sum(x["n_rows"] for x in report) == 53 and sum(x["n_overlapping"] for x in report) == len({b for _, b in {tuple(p)[:2] for p in overlap.pairs().collect()}})
    nothing = spark.createDataFrame([], "row_id bigint, body string")
    assert split_overlap.split_overlap(nothing, nothing, "row_id", "body").pairs().count() == 0


def test_hot_text_is_banded_once_a_task(spark):
    r = random.Random(2)
    t = text_of(r, 80)
    table = spark.createDataFrame([(k, t) for k in range(300)], "key bigint, text string").coalesce(2)
    signed = near_dup.signatures(table.select(F.col("key").alias("id"), "text"), near_dup.Bands.for_threshold(0.8), 5, 0)
    assert signed.count() == 300 and signed.where("keys is not null").count() <= 2


def test_an_id_with_two_texts_keeps_its_links(spark):
    r = random.Random(4)
    a, b = text_of(r, 90), text_of(r, 90)
    rows = [(1, a), (1, b), (2, edited(r, a, 0.02)), (3, edited(r, b, 0.02))]
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "key bigint, text string"), "key", "text", 0.6, 3, recall=0.9999)
    assert sorted(tuple(x) for x in found.pairs().collect()) == [(1, 2), (1, 3)]


def test_one_band_key_of_many_classes(spark):
    n = 50_000
    signed = spark.range(n).select(F.array(F.lit(5), F.col("id") + 10).alias("keys"), F.col("id").alias("cls"))
    met, crowded = near_dup.meetings(signed.unionByName(spark.createDataFrame([([8, 9], n), ([9], n + 1)], "keys array<bigint>, cls bigint")))
    assert [tuple(x) for x in met.collect()] == [(n, n + 1)]
    assert crowded.count() == crowded.distinct().count() == n


def test_crowd_is_joined_exactly(spark):
    r = random.Random(9)
    head = text_of(r, 60)  # all share it, so that they meet, but few are alike
    rows = [(k, head + " " + text_of(r, 60)) for k in range(150)]
    rows += [(1000 + k, edited(r, rows[k][1], 0.02)) for k in range(20)]
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "key bigint, text string"), "key", "text", 0.6, 3, recall=0.9999, crowd=20)
    assert {tuple(x) for x in found.pairs().collect()} == brute(rows, 3, 0.6, 0)


def test_groups_of_a_hot_class(spark):
    r = random.Random(6)
    t, other = text_of(r, 80), text_of(r, 80)
    rows = [(k, t) for k in range(3000)] + [(5000, t + " more"), (5001, other)]
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "key bigint, text string"), "key", "text", 0.6, 3)
    got = {x["id"]: (x["group_id"], x["n_links"]) for x in near_dup.groups(found).collect()}
    assert len(got) == 3002 and got[2999] == got[5000] == (0, 1) and got[5001] == (5001, 0)


def test_split_overlap_sends_a_class_of_many_tasks_once(spark, rows, monkeypatch):
    """A text that several tasks meet is shuffled by one of them, its members packed, and every pair of its copies is found."""
    sent = []
    monkeypatch.setattr(split_overlap, "SMALL_INDEX", 0)
    staged = split_overlap.staged
    monkeypatch.setattr(split_overlap, "staged", lambda df, name: sent.append((name, staged(df, name))) or sent[-1][1])
    r = random.Random(4)
    texts = [t for _, t in rows if t and len(shingles.words(t)) >= 20][:6]
    train = spark.createDataFrame([(k * 10 + j, t) for j in range(8) for k, t in enumerate(texts)], "row_id bigint, body string").repartition(8, "row_id")
    held = [(1000 + k * 10 + j, edited(r, t, 0.02) if j == 3 else t) for j in range(4) for k, t in enumerate(texts)]
    got = [tuple(x)[:2] for x in split_overlap.split_overlap(train, spark.createDataFrame(held, "row_id bigint, body string").repartition(4, "row_id"), "row_id", "body", 0.6, 3, 20).pairs().collect()]
    want = {(k * 10 + j, b) for j in range(8) for k, t in enumerate(texts) for b, y in held if likeness(t, y, 3) >= 0.6}
    assert len(got) == len(set(got)) and set(got) == want
    met = dict(sent)["met_keys"]
    assert met.count() == met.distinct().count() <= len(texts) ** 2 * 2


def test_packed_members_are_the_same_again():
    columns = [np.array([0, 2**64 - 1, 7], np.uint64), np.array([3, 0, 300]), np.array([0, 0, 0])]
    assert all((a == b).all() for a, b in zip(columns, split_overlap._unpacked(split_overlap._packed(columns), 3, 3)))
