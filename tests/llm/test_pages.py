import datetime as dt
import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parchmint.llm import labelled_blocks, main_content, repeated_lines, residue, survivors


@pytest.fixture(scope="module")
def model():
    return main_content.LineClassifier.train()


# Pages and survivors


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("http://www.A.example:80/x/", "https://a.example/x", True), ("https://a.example/x#f", "https://a.example/x", True), ("https://a.example/?b=1&a=2&utm_x=3", "http://a.example?a=2&b=1", True), ("https://a.example:443/x?fbclid=1", "https://a.example/x", True),
        ("https://a.example/X", "https://a.example/x", False), ("https://a.example:8080/x", "https://a.example/x", False), ("https://a.example/x?a=1", "https://a.example/x?a=2", False), ("http://a.example:443/", "https://a.example/", False),
        ("email://msg-id/1", "email://msg-id/1", True), ("email://msg-id/1/", "email://msg-id/1", False),
    ],
)
def test_page_keys(spark, a, b, same):
    row = spark.range(1).select(survivors.page_key(F.lit(a)).alias("a"), survivors.page_key(F.lit(b)).alias("b")).first()
    assert (row["a"] == row["b"]) is same
    assert spark.range(1).select(survivors.page_key(F.lit(None).cast("string")).alias("k")).first()["k"] is None


DOCS = "id string, path string, title string, source string, content_type string, updated_at timestamp, tags array<string>, page string, rank int"


def doc(i, source, day, tags, title="T"):
    return (i, f"p{i}", title, source, "article", None if day is None else dt.datetime.fromisoformat(day), tags, "clash", 1)


def test_survivors(spark):
    rows = [doc("1", "http://a.example/x", "2024-01-01", ["a", " A ", "b"], "Untitled"), doc("2", "https://a.example/x/", "2024-02-01", None), doc("3", "https://www.a.example/x", "2030-01-01", ["a", "", None], "Late"), doc("4", "https://a.example/x", "2024-02-01", ["c", "d"], ""),
            doc("5", None, "2024-01-01", None), doc("6", "https://b.example", None, []), doc(None, "https://a.example/x", "2024-01-01", None)]
    docs = spark.createDataFrame(rows + rows[:1], DOCS)
    got = survivors.ranked_pages(docs).collect()
    assert [(r["first_id"], r["recent_id"], r["tags_id"], r["title_id"]) for r in got] == [("1", "4", "4", "2")]
    merged = {r["id"]: r for r in survivors.survivors(docs).collect()}
    assert merged.keys() == {"1", "5", "6"} and merged["1"]["tags"] == ["c", "d"] and merged["1"]["title"] == "T" and merged["1"]["n_merged"] == 4 and merged["1"]["updated_at"] == dt.datetime(2024, 2, 1)
    assert survivors.ranked_pages(docs.where("false")).count() == 0 == survivors.survivors(docs.where("false")).count()


def test_hot_page(spark):
    docs = spark.range(3000).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("id"), F.lit("p").alias("path"), F.lit("t").alias("title"), F.lit("https://a.example/").alias("source"), F.lit("article").alias("content_type"), F.timestamp_seconds(F.col("id") % 7).alias("updated_at"), F.array(F.lit("x")).alias("tags"))
    assert [tuple(r[c] for c in ("first_id", "recent_id", "tags_id")) for r in survivors.ranked_pages(docs).collect()] == [("000000", "002995", "002995")]


# Repeated lines


def lines_table(spark, rows):
    return spark.createDataFrame(rows, "capture_id bigint, doc_id string, content_markdown string, site string, line string")


def test_repeated_lines(spark):
    docs = spark.createDataFrame([("a", "https://www.S.example:80/1"), ("b", "email://x@s.example"), ("c", "https://t.example"), ("n", None), ("e", "email://no-host")], "id string, source string")
    rows = []
    for k in range(12):
        rows.append((k, "a", f"# Heading that repeats always\nAll rights reserved {k}!\nshort\nunique line number {chr(97 + k) * 3}\nall RIGHTS reserved", "x", "y"))
    rows += [(20, "b", "All rights reserved", "x", "y"), (21, "c", "All rights reserved", "x", "y"), (22, "n", "All rights reserved", "x", "y"), (23, "a", None, "x", "y"), (24, "a", "", "x", "y"), (25, "e", "All rights reserved", "x", "y"), rows[0]]
    captures = lines_table(spark, rows)
    lines = repeated_lines.site_lines(captures, docs)
    found = sorted((r["id"], r["line_no"]) for r in repeated_lines.frequent_occurrences(lines).collect())
    assert found == sorted([(k, n) for k in range(12) for n in (2, 5)] + [(20, 1)])
    cleaned = {r["capture_id"]: r for r in repeated_lines.without_lines(captures, repeated_lines.frequent_occurrences(lines).withColumnRenamed("id", "capture_id")).collect()}
    assert cleaned[0]["content_markdown"] == "# Heading that repeats always\nshort\nunique line number aaa" and cleaned[0]["n_removed"] == 2
    assert cleaned[21]["content_markdown"] == "All rights reserved" and cleaned[23]["content_markdown"] is None and cleaned[20]["content_markdown"] == ""
    assert repeated_lines.frequent_occurrences(repeated_lines.site_lines(captures.where("false"), docs)).count() == 0


def test_frequent_sequences(spark):
    docs = spark.createDataFrame([("a", "https://s.example")], "id string, source string")
    x, y, z = "line of the first kind", "line of the second kind", "line of the third kind"
    rows = [(k, "a", "\n".join([x, f"own line of {chr(97 + k) * 4}", y] + ([z] if k < 11 else [])), "", "") for k in range(14)] + [(50, "a", f"{y}\n{x}", "", "")]
    got = {(len(r["pattern"]), r["n_docs"]) for r in repeated_lines.frequent_sequences(repeated_lines.site_lines(lines_table(spark, rows), docs)).collect()}
    assert got == {(1, 15), (1, 11), (2, 14), (2, 11), (3, 11)}
    sparse = repeated_lines.frequent_sequences(repeated_lines.site_lines(lines_table(spark, rows), docs), max_gap=2, max_length=2)
    assert sorted((len(r["pattern"]), r["n_docs"]) for r in sparse.collect()) == [(1, 11), (1, 15), (1, 15), (2, 11), (2, 11), (2, 14)]


def test_frequent_sequences_are_whole(spark):
    docs = spark.createDataFrame([("a", "https://s.example"), ("b", "https://t.example")], "id string, source string")
    r = random.Random(5)
    kinds = [f"line of the kind {x * 4}" for x in "abcdefg"]
    texts = [r.choices(kinds, k=r.randint(0, 5)) for _ in range(60)] + [kinds] * 3
    rows = [(k, "ab"[k % 3 == 0], "\n".join(t), "", "") for k, t in enumerate(texts)]
    want = Counter()
    for k, t in enumerate(texts):
        want.update({("ab"[k % 3 == 0], s) for n in range(1, len(t) + 1) for s in itertools.combinations(t, n)})
    lines = repeated_lines.site_lines(lines_table(spark, rows), docs)
    got = Counter((len(x["pattern"]), x["n_docs"]) for x in repeated_lines.frequent_sequences(lines, min_docs=3).collect())
    assert got == Counter((len(s), n) for (_, s), n in want.items() if n >= 3)
    got = Counter((len(x["pattern"]), x["n_docs"]) for x in repeated_lines.frequent_sequences(lines_of_one_block(spark, docs)).collect())
    assert got == Counter({(n, 12): math.comb(6, n) for n in range(1, 7)})


@pytest.mark.parametrize("max_gap", [None, 1, 2])
def test_large_projections_take_distributed_steps(spark, max_gap):
    docs = spark.createDataFrame([("a", "https://s.example")], "id string, source string")
    r = random.Random(8)
    kinds = [f"line of the kind {x * 4}" for x in "abcde"]
    lines = repeated_lines.site_lines(lines_table(spark, [(k, "a", "\n".join(r.choices(kinds, k=r.randint(0, 6))), "", "") for k in range(50)]), docs)
    got = [sorted((tuple(x["pattern"]), x["n_docs"]) for x in repeated_lines.frequent_sequences(lines, 4, None, max_gap, n).collect()) for n in (3, 60, 10**6)]
    assert got[0] == got[1] == got[2] and len(got[0]) == len(set(got[0])) > 10
    texts = {x["id"]: [y["line"] for y in x["lines"]] for x in lines.collect()}

    def holds(text, pattern, at=-1):
        if not pattern:
            return True
        last = len(text) if max_gap is None or at < 0 else min(len(text), at + 1 + max_gap)
        return any(text[i] == pattern[0] and holds(text, pattern[1:], i) for i in range(at + 1, last))

    for pattern, n in random.Random(1).sample(got[0], 10):
        assert n == sum(holds(t, pattern) for t in texts.values())


def test_removed_lines_are_those_of_the_blocks(spark):
    docs = spark.createDataFrame([("a", "https://s.example")], "id string, source string")
    lines = lines_of_one_block(spark, docs)
    whole = {(x["id"], x["line_no"]) for x in repeated_lines.frequent_occurrences(lines).collect()}
    assert {tuple(x) for x in repeated_lines.repeated_occurrences(lines).collect()} == whole and len(whole) == 72


def lines_of_one_block(spark, docs):
    block = "\n".join(f"line of the kind {x * 4}" for x in "abcdef")
    return repeated_lines.site_lines(lines_table(spark, [(k, "a", block, "", "") for k in range(12)]), docs)


# Main content


WORDING = ("furniture_words", "furniture_share", "furniture_before", "furniture_after", "block_furniture")


def accuracy(model, of):
    right = total = 0
    for language, style, page in labelled_blocks.table():
        if of(language, style):
            gone = set(model.furniture("\n".join(x for x, _ in page)))
            marked = [(k, f) for k, (_, f) in enumerate(page, 1) if f is not None]
            right, total = right + sum((k in gone) == f for k, f in marked), total + len(marked)
    return right / total


@pytest.mark.parametrize("without", [(), WORDING])
def test_languages_held_out(without):
    found = [accuracy(main_content.LineClassifier.train(keep=lambda own, _, x=x: own != x, without=without), lambda own, _, x=x: own == x) for x in ("de", "fr", "es")]
    assert min(found) > 0.8 and sum(found) / len(found) > 0.9


@pytest.mark.parametrize("without", [(), WORDING])
def test_styles_held_out(without):
    styles = ["news", "blog", "magazine", "interview"]
    found = [accuracy(main_content.LineClassifier.train(keep=lambda _, own, s=s: own != s, without=without), lambda _, own, s=s: own == s) for s in styles]
    assert sum(found) / len(found) > 0.85


PAGE = """Home
News
Culture

# A field trip to Norvale

By Ann Lee | Norvale Post

The old mill of Norvale opened in front of a full hall. According to Ann Lee, the council sold 12 lamps after two failed attempts.

```
cookies = load("share")
```

- [Norvale library](https://lib.example/a) – The library repaired 30 old maps without asking the board.

Enjoyed this? Share Norvale Post with a friend
Most read
1. How Bo Dru rebuilt Sumi – Karta
2. Inside the Sumi archive – Lemna

© 2024 Norvale Post. All rights reserved.
Accept all"""


def test_a_page(model):
    lines = PAGE.split("\n")
    gone = set(model.furniture(PAGE))
    kept = [x for k, x in enumerate(lines, 1) if x.strip() and k not in gone]
    assert kept == ["# A field trip to Norvale", lines[8], "```", 'cookies = load("share")', "```", lines[14]]


def test_furniture_of_a_table(spark, model):
    rows = [(1, PAGE, "x"), (1, PAGE, "x"), (2, None, "x"), (3, "", "x"), (4, "Home\nNews", "x"), (None, PAGE, "x"), (5, "word " * 50_000, "x"), (6, PAGE, "y")]
    table = spark.createDataFrame(rows, "capture_id bigint, content_markdown string, line_no string")
    got = main_content.furniture_lines(table, "capture_id", "content_markdown", model=model).collect()
    assert {r["id"] for r in got} == {1, 6} and len(got) == 2 * len(model.furniture(PAGE))
    whole = {r["id"]: r for r in main_content.main_content(table, "capture_id", "content_markdown", model=model).collect()}
    assert whole[4]["text"] == "Home\nNews" and whole[2]["text"] is None and "Accept all" not in whole[1]["text"] and "old mill" in whole[1]["text"]
    assert main_content.furniture_lines(table.where("false"), "capture_id", "content_markdown", model=model).count() == 0


# Residue

BODY = "The old mill of {} opened in front of a full hall. According to Ann Lee, the council sold 12 lamps.\n\nA second paragraph about {} and its lamps, which the council bought in spring, follows here without any haste at all."


@pytest.mark.parametrize(
    "title, text, case",
    [
        ("T", "Dear {{first_name}}, welcome to the letter.", True), ("{{title}} – Norvale", BODY, True), ("T", BODY + "\n\nPublished {DATE} in {CITY}.", True), ("T", "Dear undefined, " + BODY, True), ("T", BODY + " NaN readers agree.", True), ("T", "Hello *|FNAME|*, hi.", True),
        ("T", BODY + "\n\nTemplates look like `Dear {{ first_name }}` here.", False), ("T", BODY + "\n\n```\n<p>{{ user }}</p>\n```\n", False), ("T", BODY + "\n\nThe form asked for [First Name] in red, a field that Bo left empty.", False), ("A guide to {{ }} and other braces", BODY, False),
        ("T", "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod.", True), ("T", BODY.replace("lamps.", "lamps; printers used lorem ipsum once."), False),
        ("Insert headline here", BODY, True), ("Lorem ipsum dolor", BODY, True), ("T", BODY + "\n\nCall us at [phone number] for details.", True), ("T", "Dear {0}, " + BODY, True), ("T", "Hey {$customer_name}, " + BODY, True), ("T", BODY + "\n\n[Music]", False), ("T", BODY + "\n\nSee [the letters](https://a.example).", False),
        ("Oops", "Page not found", True), ("T", "Please enable JavaScript to view Norvale content.", True), ("T", "Bitte aktivieren Sie JavaScript, um Norvale anzuzeigen.", True), ("T", "# Norvale\n\n502 Bad Gateway", True), ("T", "Verify you are human by completing the action below.", True),
        ("T", "Questa pagina non esiste.", False), ("T", BODY + "\n\nComments on Norvale need JavaScript to be switched on.", False), ("T", "The page said “please enable JavaScript” and nothing else; the story of Norvale begins there.", False), ("T", "The council sold 12 lamps.", False), ("T", "", False), (None, None, False),
    ],
)
def test_residue(spark, model, title, text, case):
    rows = spark.createDataFrame([(1, title, text, "x")], "capture_id bigint, title string, content_markdown string, why string")
    got = residue.residue(rows, "capture_id", "title", "content_markdown", model=model).collect()
    assert bool(got) is case, got


def test_residue_from_alignment_alone(spark, model):
    r = random.Random(1)
    name = lambda: "".join(r.choice("bdklmn") + r.choice("aeiou") for _ in range(3)).title()
    broken = [(k, "T", f"Our kettle of {name()} boiled over, come again when it is dry.", "x") for k in range(12)]
    notes = [(100 + k, "T", f"The council of {name()} sold the lamps.", "x") for k in range(12)]
    articles = [(200 + k, "T", " ".join(f"The council of {name()} sold the lamps." for _ in range(12)) + " " + "More words follow here. " * 60, "x") for k in range(12)]
    about = [(300 + k, "T", " ".join(f"Words {w} {v} of a long article follow here." for w in ("here", "there", "then") for v in ("and", "or", "but", str(k))) + f"\n\nIn {name()} the sheet said [Your Name] in red where {name()} had to sign.", "x") for k in range(12)]
    table = spark.createDataFrame(broken + notes + articles + about + broken[:1], "capture_id bigint, title string, content_markdown string, h string")
    got = {row["id"] for row in residue.residue(table, "capture_id", "title", "content_markdown", model=model).collect()}
    assert got == {b[0] for b in broken}
    assert residue.residue(table.where("false"), "capture_id", "title", "content_markdown", model=model).count() == 0


LONG = PAGE[: PAGE.index("# A field")] + "{}" + PAGE[PAGE.index("\nEnjoyed this?") :].replace("Most read", "\n".join(["Most read"] + [f"{k}. How Bo Dru rebuilt Sumi and the archive of Lemna – Karta" for k in range(1, 21)]))


@pytest.mark.parametrize("text, case", [(LONG.format("Page not found\n"), True), (LONG.format("Please enable JavaScript to view Norvale content.\n"), True), ("\n\n".join(["Sample text. Replace this paragraph."] * 40), True), (LONG.format("\n\n".join([BODY] * 4) + "\n\nPage not found\n"), False)])
def test_residue_of_long_pages(spark, model, text, case):
    assert len(text.split()) >= 160
    rows = spark.createDataFrame([(1, "T", text)], "capture_id bigint, title string, content_markdown string")
    assert bool(residue.residue(rows, "capture_id", "title", "content_markdown", model=model).collect()) is case


def test_fields_however_many_fillings(spark, model):
    rows = [(k, "T", BODY + f"\n\nHello {{{{first_name}}}}, here is issue {k + 41} of the Harbour letter.") for k in range(8)]
    rows += [(100 + k, "T", BODY + f"\n\nHere is what the {x} of {{{{town}}}} have sold in spring.") for k, x in enumerate(("Mills", "Boats", "Lamps", "Kings", "Bells", "Halls"))]
    table = spark.createDataFrame(rows, "capture_id bigint, title string, content_markdown string")
    assert {r["id"] for r in residue.residue(table, "capture_id", "title", "content_markdown", model=model).collect()} == {r[0] for r in rows}


@pytest.mark.parametrize("field", ["[insert e-mail address]", "[Add photo/caption here]", "[your name, title]", "[your-name]"])
def test_fields_with_signs(field):
    assert residue.fields_of(f"Write to {field} for details.")


def test_greeting_within_a_line():
    assert residue.fields_of("Good news. Dear , welcome to the letter.")


def test_residue_in_one_long_line(spark, model):
    rows = spark.createDataFrame([(1, "T", "Sample text. Replace this paragraph. " * 15), (2, "T", " ".join(["The council sold 12 lamps."] * 15) + " Page not found.")], "capture_id bigint, title string, content_markdown string")
    assert [r["id"] for r in residue.residue(rows, "capture_id", "title", "content_markdown", model=model).collect()] == [1]


WORDS = "mill lamps council river stone winter garden quiet paper copper window signal harbour basket copper ladder meadow orchard kettle".split()


def random_name(r):
    return "".join(r.choice("bdklmn") + r.choice("aeiou") for _ in range(3)).title()


def found_in(spark, model, rows):
    table = spark.createDataFrame(rows, "capture_id bigint, title string, content_markdown string")
    return {r["id"] for r in residue.residue(table, "capture_id", "title", "content_markdown", model=model).collect()}


def test_long_error_pages_of_a_language_no_list_has(spark, model):
    r = random.Random(3)
    errors = [f"La pagina {random_name(r)} non si trova più su questo sito.", "Forse l'indirizzo è stato scritto male.", "Torni indietro e provi ancora una volta."]
    rows = [(k, "Errore", "\n\n".join([errors[0].replace(errors[0].split()[2], random_name(r)), *errors[1:]] * (1 if k < 6 else 14))) for k in range(8)]
    articles = [(100 + k, "Una storia", " ".join(f"Il consiglio di {random_name(r)} ha venduto le lampade {w} {v}." for w in ("vecchie", "nuove", "rotte") for v in ("ieri", "oggi", "domani", "sempre"))) for k in range(12)]
    assert len(rows[7][2].split()) > 300
    assert found_in(spark, model, rows + articles) == {k for k, _, _ in rows}


def test_a_default_that_no_list_has(spark, model):
    r = random.Random(4)
    body = lambda: "\n\n".join(" ".join(r.choice(WORDS) for _ in range(9)).capitalize() + "." for _ in range(6))
    rows = [(k, "T", body() + f"\n\nWith this letter for {random_name(r) if k > 4 else 'recipient'} we begin the year.") for k in range(60)]
    assert found_in(spark, model, rows) == set(range(5))
    several = [(k, t, x.replace("recipient", ("friends", "readers", "members", "nobody", "everyone")[k % 5])) for k, t, x in rows]
    assert found_in(spark, model, several) == set()
