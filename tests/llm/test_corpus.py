import random
import unicodedata
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parchmint.llm import lexicon, lookalikes, packing, tokens

TEXTS = ["", " ", "  \n\n ", "Hello world", "it's we'll", "日本語 テキスト", "naïve café — “quote”", "a b c", "tab\tx  y   ", "<|endoftext|>", "👩‍💻 emoji", "x" * 5000, "1234 ²³ Ⅷ", "͸ unassigned", "é" * 20]


@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k", "word_bpe_49k", "piece_bpe_32k"])
def test_ids_are_the_tokenizers(spark, name):
    rows = [(k, t, "x") for k, t in enumerate(TEXTS * 3)] + [(99, None, "x"), (99, None, "x"), (None, "Hello", "x")]
    got = tokens.encode(spark.createDataFrame(rows, "doc_id bigint, text string, ids string"), "doc_id", "text", name).collect()
    assert len(got) == len(rows)
    whole = tokens.text_encoder(tokens.TOKENIZERS, name)
    for r in got:
        if r["id"] == 99:
            assert r["ids"] is None
        elif r["id"] is not None:
            text = TEXTS[r["id"] % len(TEXTS)]
            assert r["ids"] == (list(whole([text])[0]) if text else []), text


def test_round_trip_and_empty_table(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    encoded = tokens.encode(rows, "doc_id", "text", lexicon_words=5)
    assert {r["id"]: r["text"] for r in tokens.decode(encoded).collect()} == dict(enumerate(TEXTS))
    assert tokens.encode(rows.where("false"), "doc_id", "text").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=6), max_size=60), st.lists(st.binary(max_size=7), max_size=30))
def test_lexicon(tmp_path_factory, words, others):
    words = sorted(words)
    path = str(tmp_path_factory.mktemp("lexicon") / "l.bin")
    with open(path, "wb") as f:
        f.write(lexicon.packed(lexicon.compile_words(words, [[k, len(w)] for k, w in enumerate(words)])))
    own = lexicon.Lexicon(path)
    asked = words + others
    for w, rank in zip(asked, own.ranks(asked).tolist()):
        assert rank == (words.index(w) if w in words else -1)
    for k in range(len(words)):
        assert own.ids[own.offset[k] : own.offset[k + 1]].tolist() == [k, len(words[k])]


def test_lexicon_shares_suffixes(tmp_path):
    words = sorted(f"{p}{s}ing".encode() for p in "abcdefgh" for s in ("ab", "cd"))
    assert len(lexicon.compile_words(words, [[0]] * len(words))["final"]) == 8


# Packing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plan_places_everything(histogram):
    placed, bins = Counter(), 0
    made = packing.plan(histogram, 64, rounds=8)
    for content, times in made.patterns:
        assert times > 0 and sum(n * k for n, k in content.items()) <= 64
        bins += times
        for n, k in content.items():
            placed[n] += k * times
    assert placed == Counter(histogram)
    total = sum(n * c for n, c in histogram.items())
    assert -(-total // 64) <= made.bound <= bins == made.containers <= 1 + 2 * -(-total // 64)


def test_bound_is_no_more_than_the_best_packing():
    # Three items of 34 never share a container of 100 with each other: two each, so the sum of lengths is too low a bound.
    made = packing.plan({34: 90}, 100)
    assert made.containers == 45 and 31 <= made.bound <= 45
    assert packing.plan({60: 10, 40: 10}, 100).containers == 10 == packing.plan({60: 10, 40: 10}, 100).bound


def test_price_is_the_best_container():
    r = np.random.default_rng(3)
    for _ in range(20):
        sizes, values, most = r.integers(1, 12, 5), r.random(5), r.integers(1, 4, 5)
        held = packing.price(values, sizes, most, 20)
        assert (held * sizes).sum() <= 20 and (held <= most).all()
        best = max(float((np.array(c) * values).sum()) for c in np.ndindex(*(most + 1)) if (np.array(c) * sizes).sum() <= 20)
        assert (held * values).sum() >= best - 1e-9


def test_pack(spark):
    r = random.Random(6)
    rows = [(k, r.choice([1, 5, 50, 120, 300, 999])) for k in range(500)] + [(900, 0), (901, None), (902, 100), (903, 100), (903, 100), (None, 7)]
    sizes = spark.createDataFrame(rows, "id bigint, n int").repartition(5)
    targets = {1: 100, 2: 256}
    got = packing.pack(sizes, targets).collect()
    for t, capacity in targets.items():
        own = [x for x in got if x["target_id"] == t]
        assert sum(x["n_tokens"] for x in own) == sum(n or 0 for _, n in rows)
        held = Counter()
        for x in own:
            held[x["container_id"]] += x["n_tokens"]
        assert held.pop(None) == 0 and max(held.values()) <= capacity and sorted(held) == list(range(len(held)))
        assert len(held) <= 1.05 * sum(held.values()) / capacity + 2
        for k, n in rows[:500]:
            pieces = sorted((x["piece_no"], x["start"], x["n_tokens"]) for x in own if x["id"] == k)
            assert len(pieces) == -(-n // capacity) and sum(p[2] for p in pieces) == n and all(p[1] == p[0] * capacity for p in pieces)
    s = {x["target_id"]: x for x in packing.summary(packing.pack(sizes, targets), targets).collect()}
    assert s[1]["containers"] >= s[1]["least_containers"] and 0 <= s[1]["unused"] < 0.1
    assert packing.pack(sizes.where("false"), targets).count() == 0


# Look-alikes

def form(text):
    """A text with all the repairs it wishes, as where each result is a token of the corpus."""
    text = lookalikes.clean(text)
    wishes = lookalikes.Repairs().wished(text)
    return unicodedata.normalize("NFC", lookalikes.TOKEN.sub(lambda m: wishes.get(m.group(), m.group()), text))


CLEAN = "The open school of Kanto reached 12 kelvin - fine, naïve ÅK"


@pytest.mark.parametrize(
    "other, same",
    [
        (CLEAN.replace("o", "о"), True), (CLEAN.replace("K", "K"), True), (CLEAN.replace("Å", "Å"), True), (CLEAN.replace("ï", "ï"), True), (CLEAN.replace(" ", " "), True), (CLEAN.replace("fine", "ﬁne"), True), (CLEAN.replace("-", "‑"), True),
        (CLEAN.replace("h", "h​"), True), (CLEAN.replace("open", "ｏｐｅｎ"), True), (CLEAN.replace("T", "Т").replace("e", "е"), True), (CLEAN.replace("c", "c­"), True),
        (CLEAN.replace("ï", "i"), False), (CLEAN.upper(), False), (CLEAN.replace("12", "1²"), False), (CLEAN.replace("1", "①"), False), (CLEAN.replace("-", "–"), False), (CLEAN.replace(" ", "  "), False), (CLEAN.replace("a", "ȧ"), False),
    ],
)
def test_looks(other, same):
    assert other != CLEAN and (form(other) == form(CLEAN)) is same


def test_joined_emoji_differs_from_its_parts():
    assert lookalikes.clean("👩‍💻") != lookalikes.clean("👩💻") and lookalikes.clean("a‍b") == "ab"
    assert lookalikes.clean("ﾀﾞ") == "ダ" and lookalikes.clean("プ") == "プ"


def test_repair_follows_the_dominant_script():
    assert lookalikes.repair("schооl") == "school" and lookalikes.repair("шкoла") == "школа" and lookalikes.repair("school") is None
    assert lookalikes.repair("λoγoς") == "λογος" and lookalikes.repair("жаbc") == "жabc" and lookalikes.repair("жabc") is None
    assert lookalikes.repair("ΓДΠ") == "ГДП" and lookalikes.repair("сор") == "cop" and lookalikes.repair("cop", "C") == "сор" and lookalikes.repair("сор", "C") is None
    assert lookalikes.repair("шva", "C") == "шvа" and lookalikes.repair("шνа", "C") == "шvа"


def test_look_alikes_alone_take_the_script_of_their_text(spark):
    rows = [(1, "Der alte HET steht"), (2, "Der alte НЕТ steht"), (3, "Он сказал НЕТ школе"), (4, "Он сказал HET школе"), (5, "ма́ма"), (6, "мáма"), (7, "Он сказал ВОР школе")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(tuple(x) for x in lookalikes.look_alikes(table, "doc_id", "text").collect()) == [(1, 2), (3, 4), (5, 6)]
    texts = {r["id"]: r["text"] for r in lookalikes.normalised(table, "doc_id", "text").collect()}
    assert texts[2] == rows[0][1] and texts[4] == rows[2][1] and texts[5] == texts[6] and texts[7] == rows[6][1]


def test_two_spellings_of_no_word_have_one_form(spark):
    table = spark.createDataFrame([(1, "xylofрhone"), (2, "xylоfphone")], "doc_id bigint, text string")
    assert {r["text"] for r in lookalikes.normalised(table, "doc_id", "text").collect()} == {"xylofphone"}


def test_words_with_combining_accents_are_vocabulary(spark):
    table = spark.createDataFrame([(1, "cafe\u0301"), (2, "саfé")], "doc_id bigint, text string")
    assert [tuple(x) for x in lookalikes.look_alikes(table, "doc_id", "text").collect()] == [(1, 2)]


def test_hot_text_with_one_variant(spark):
    table = spark.range(4000).select("id", F.when(F.col("id") == 7, "the schооl").otherwise("the school").alias("text"))
    got = lookalikes.look_alikes(table, "id", "text").collect()
    assert len(got) == 3999 and all(7 in tuple(x) for x in got)


def test_tables_of_look_alikes(spark):
    mixed = CLEAN.replace("school", "schооl").replace("Kanto", "Kаnto")
    rows = [(1, CLEAN, 0), (2, mixed, 0), (2, mixed, 0), (3, CLEAN, 0), (4, CLEAN.upper(), 0), (5, None, 0), (6, "", 0), (7, "​", 0), (None, CLEAN + "​", 0), (8, "сор only", 0), (9, "long " * 40_000, 0)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, raw int").repartition(3)
    pairs = sorted(tuple(r) for r in lookalikes.look_alikes(table, "doc_id", "text").collect())
    assert pairs == [(1, 2), (2, 3), (6, 7)]
    texts = {r["id"]: r["text"] for r in lookalikes.normalised(table, "doc_id", "text").collect()}
    assert texts[2] == CLEAN and texts[5] is None and texts[7] == "" and texts[8] == "сор only"
    alone = spark.createDataFrame([(1, "xylofрhone")], "doc_id bigint, text string")
    assert lookalikes.normalised(alone, "doc_id", "text").first()["text"] == "xylofрhone"  # the result is no word of the corpus
    assert lookalikes.look_alikes(table.where("false"), "doc_id", "text").count() == 0


def test_brute_force_on_pairs(spark):
    r = random.Random(2)
    rows = []
    for k in range(120):
        t = r.choice([CLEAN, "Another text of the vault", "Школа у реки"])
        for c, d in r.sample([("o", "о"), (" ", " "), ("e", "е"), ("x", "X"), ("h", "h⁠")], 2):
            t = t.replace(c, d)
        rows.append((k, t))
    keys = {k: form(t) for k, t in rows}
    want = {(a, b) for a, x in rows for b, y in rows if a < b and x != y and keys[a] == keys[b]}
    got = [tuple(x) for x in lookalikes.look_alikes(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text").collect()]
    assert len(got) == len(set(got)) and set(got) == want and F is not None
