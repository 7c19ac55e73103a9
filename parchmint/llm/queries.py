"""The queries of the training-data operators, by name: ``queries()`` and ``oracle_sql()``."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.llm import lookalikes, main_content, near_dup, packing, repeated_lines, residue, split_overlap, survivors, tokens
from parchmint.session import prepare
from parchmint.staging import staged
from parchmint.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of captures of at least 60 words whose three-word runs have a likeness of 0.6 or more."""
    captures = table(prepare(spark), folder, "captured_content")
    found = near_dup.near_duplicates(captures, "capture_id", "content_markdown", threshold=0.6, size=3, min_words=60)
    return found.pairs().select(F.col("id_a").alias("capture_id_a"), F.col("id_b").alias("capture_id_b"))


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The group of each capture of at least 60 words, and its number of links."""
    captures = table(prepare(spark), folder, "captured_content")
    found = near_dup.near_duplicates(captures, "capture_id", "content_markdown", threshold=0.6, size=3, min_words=60)
    return near_dup.groups(found).withColumnRenamed("id", "capture_id")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The first, the most recent trusted and the best tagged row of each page that docs holds more than once."""
    return survivors.ranked_pages(table(prepare(spark), folder, "docs")).select("first_id", "recent_id", "tags_id")


def p2_survivors(spark: SparkSession, folder: str) -> DataFrame:
    """One record a page, built field by field."""
    found = survivors.survivors(table(prepare(spark), folder, "docs"))
    return found.withColumns({"updated_at": F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"), "tags": F.array_join("tags", "|")})


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Captures with unfilled fields, filler, error messages or demands for scripts instead of content."""
    captures = table(prepare(spark), folder, "captured_content")
    return residue.residue(captures, "capture_id", "title", "content_markdown").select(F.col("id").alias("capture_id"))


def p3_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """The cases of each kind, by content type."""
    captures = table(prepare(spark), folder, "captured_content")
    kinds = captures.select("capture_id", "content_type").distinct()
    found = residue.residue(captures, "capture_id", "title", "content_markdown").withColumnRenamed("id", "capture_id")
    return found.join(kinds, "capture_id").groupBy("content_type", "why").agg(F.count("*").alias("n"))


def _overlap(spark: SparkSession, folder: str) -> split_overlap.Overlap:
    prepare(spark)
    return split_overlap.split_overlap(table(spark, folder, "labeled"), table(spark, folder, "holdout"), "row_id", "body", threshold=0.6, size=3, min_words=20)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of labeled and holdout whose bodies, of at least 20 words, have a likeness of 0.6 or more."""
    return _overlap(spark, folder).pairs().select(F.col("train_id").alias("labeled_row_id"), F.col("eval_id").alias("holdout_row_id"))


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapping rows of each split and source of holdout."""
    return split_overlap.report(_overlap(spark, folder), table(spark, folder, "holdout"), "row_id", "split", "source")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Non-blank lines of articles of at least 60 words that are not main content."""
    articles = table(prepare(spark), folder, "captured_content").where("content_type = 'article'")
    return main_content.furniture_lines(articles, "capture_id", "content_markdown").withColumnRenamed("id", "capture_id")


def p5_content(spark: SparkSession, folder: str) -> DataFrame:
    """Each article's main content."""
    articles = table(prepare(spark), folder, "captured_content").where("content_type = 'article'")
    return main_content.main_content(articles, "capture_id", "content_markdown").withColumnRenamed("id", "capture_id")


def _site_lines(spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    return repeated_lines.site_lines(table(spark, folder, "captured_content"), table(spark, folder, "docs"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every line that occurs in at least 10 captures of its site."""
    return repeated_lines.repeated_occurrences(_site_lines(spark, folder)).withColumnRenamed("id", "capture_id")


def p6_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """Each capture without the lines its site repeats."""
    return repeated_lines.without_lines(table(prepare(spark), folder, "captured_content"), p6_found(spark, folder))


def p6_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences of lines that at least 10 captures of one site carry in this order, whatever stands between."""
    found = repeated_lines.frequent_sequences(_site_lines(spark, folder))
    return found.select("site_key", F.array_join(F.col("pattern").cast("array<string>"), " ").alias("pattern"), "n_docs")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The token ids of each text of documents by byte_bpe_50k."""
    return tokens.encode(table(prepare(spark), folder, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def _packed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, dict[int, int]]:
    prepare(spark)
    rows = table(spark, folder, "pack_targets").select("target_id", "tokenizer", "capacity_tokens").collect()  # a small table of parameters
    texts = table(spark, folder, "documents").select("doc_id", "text")
    whole = counted = None
    for tokenizer in sorted({r["tokenizer"] for r in rows}):
        sizes = staged(tokens.encode(texts, "doc_id", "text", tokenizer).select("id", F.size("ids").alias("n")).where("n >= 0"), "token_counts")
        own = {r["target_id"]: r["capacity_tokens"] for r in rows if r["tokenizer"] == tokenizer}
        packed = packing.pack(sizes, own)
        sizes = sizes.withColumn("targets", F.array(*map(F.lit, own)))
        whole, counted = (packed, sizes) if whole is None else (whole.unionByName(packed), counted.unionByName(sizes))
    return whole, counted, {r["target_id"]: r["capacity_tokens"] for r in rows}


def p8_packing(spark: SparkSession, folder: str) -> DataFrame:
    """The container of each text, or of each piece of a text beyond the capacity, for each target."""
    return _packed(spark, folder)[0].withColumnRenamed("id", "doc_id")


def p8_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Containers and unused space of each target."""
    packed, _, targets = _packed(spark, folder)
    return packing.summary(packed, targets)


def p8_faults(spark: SparkSession, folder: str) -> DataFrame:
    """For each target the texts placed, and how many containers or texts break the rules: none."""
    packed, sizes, targets = _packed(spark, folder)
    if sizes.select("targets").distinct().count() == 1:
        return packing.faults(packed, sizes, targets)
    of = {t: sizes.where(F.array_contains("targets", t)) for t in targets}
    found = [packing.faults(packed.where(F.col("target_id") == t), of[t], {t: c}) for t, c in targets.items()]
    return reduce(DataFrame.unionByName, found)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose texts differ as strings but look the same."""
    found = lookalikes.look_alikes(table(prepare(spark), folder, "documents"), "doc_id", "text")
    return found.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p9_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The consistent form of each text."""
    return lookalikes.normalised(table(prepare(spark), folder, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query of this subpackage by its name."""
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}


WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
RUNS = "unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)])"

P1_FOUND = f"""
WITH words AS (SELECT DISTINCT capture_id AS id, {WORDS.format("content_markdown")} AS w FROM captured_content),
runs AS (SELECT DISTINCT id, {RUNS} AS run FROM words WHERE len(w) >= 60),
sizes AS (SELECT id, count(*) AS n FROM runs GROUP BY id),
shared AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM runs a JOIN runs b ON a.run = b.run AND a.id < b.id GROUP BY 1, 2)
SELECT a AS capture_id_a, b AS capture_id_b FROM shared JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b
WHERE k >= 0.6 * (x.n + y.n - k)
"""

P1_GROUPS = f"""
WITH RECURSIVE pairs AS ({P1_FOUND.strip()}),
words AS (SELECT DISTINCT capture_id AS id, {WORDS.format("content_markdown")} AS w FROM captured_content),
class_runs AS (SELECT DISTINCT id, {RUNS} AS run FROM words WHERE len(w) >= 60),
classes AS (SELECT id, md5(string_agg(run, '|' ORDER BY run)) AS cls FROM class_runs GROUP BY id),
ways AS (SELECT capture_id_a AS a, capture_id_b AS b FROM pairs UNION ALL SELECT capture_id_b, capture_id_a FROM pairs),
reached AS (SELECT id AS a, id AS b FROM classes UNION SELECT r.a, p.b FROM reached r JOIN ways p ON r.b = p.a),
links AS (SELECT x.a AS id, count(DISTINCT d.cls) AS n FROM ways x JOIN classes c ON c.id = x.a JOIN classes d ON d.id = x.b WHERE c.cls <> d.cls GROUP BY 1)
SELECT r.a AS capture_id, min(r.b) AS group_id, coalesce(any_value(l.n), 0) AS n_links FROM reached r LEFT JOIN links l ON l.id = r.a GROUP BY r.a
"""

P2_FOUND = r"""
WITH parts AS (
    SELECT id, updated_at, tags, source, lower(regexp_extract(source, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
        regexp_replace(regexp_replace(source, '^[^:]*://', ''), '#.*$', '', 's') AS rest
    FROM docs WHERE source IS NOT NULL AND id IS NOT NULL),
split AS (
    SELECT *, lower(regexp_extract(rest, '^([^/?]*)', 1)) AS host, regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
        [p for p in string_split(regexp_extract(rest, '[?](.*)$', 1), '&') if p <> '' AND NOT regexp_matches(lower(split_part(p, '=', 1)), '^(utm_.*|fbclid|gclid|mc_cid|mc_eid)$')] AS args
    FROM parts),
pages AS (
    SELECT id, updated_at, CASE WHEN scheme IN ('http', 'https') THEN 'web:' || regexp_replace(CASE WHEN scheme = 'http' THEN regexp_replace(host, ':80$', '') ELSE regexp_replace(host, ':443$', '') END, '^www[.]', '')
            || path || '?' || array_to_string(list_sort(args), '&') ELSE 'raw:' || source END AS page,
        len(list_distinct([lower(trim(t)) for t in coalesce(tags, []) if t IS NOT NULL AND trim(t) <> ''])) AS n_tags,
        CASE WHEN updated_at IS NULL THEN 0 WHEN updated_at >= TIMESTAMPTZ '2027-01-01 00:00:00+00' THEN 1 ELSE 2 END AS trust
    FROM split),
ranked AS (
    SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY trust DESC, updated_at DESC NULLS LAST, id DESC) AS recent,
        row_number() OVER (PARTITION BY page ORDER BY n_tags DESC, trust DESC, updated_at DESC NULLS LAST, id DESC) AS tagged FROM pages)
SELECT min(id) AS first_id, max(CASE WHEN recent = 1 THEN id END) AS recent_id, max(CASE WHEN tagged = 1 THEN id END) AS tags_id
FROM ranked GROUP BY page HAVING count(*) > 1
"""

P2_SURVIVORS = P2_FOUND[: P2_FOUND.index("ranked AS (")].rstrip() + r"""
whole AS (SELECT p.*, d.path, d.title, d.source, d.content_type, NOT lower(trim(coalesce(d.title, ''))) IN ('', 'untitled', 'none', 'null', 'home', 'index', 'no title', '(no subject)') AS titled, count(*) OVER (PARTITION BY page) AS n FROM pages p JOIN docs d USING (id)),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY page ORDER BY id) AS first, row_number() OVER (PARTITION BY page ORDER BY trust DESC, updated_at DESC NULLS LAST, id DESC) AS recent,
        row_number() OVER (PARTITION BY page ORDER BY titled DESC, trust DESC, updated_at DESC NULLS LAST, id DESC) AS named, row_number() OVER (PARTITION BY page ORDER BY n_tags DESC, trust DESC, updated_at DESC NULLS LAST, id DESC) AS tagged FROM whole WHERE n > 1),
merged AS (
    SELECT max(id) FILTER (first = 1) AS id, max(path) FILTER (first = 1) AS path, max(title) FILTER (named = 1 AND titled) AS title, max(source) FILTER (recent = 1) AS source, max(content_type) FILTER (recent = 1) AS content_type,
        max(updated_at) FILTER (recent = 1) AS updated_at, max(id) FILTER (tagged = 1) AS tags_id, count(*) AS n_merged FROM ranked GROUP BY page
    UNION ALL SELECT d.id, d.path, d.title, d.source, d.content_type, d.updated_at, d.id, 1 FROM docs d LEFT JOIN whole f USING (id) WHERE d.id IS NOT NULL AND coalesce(f.n, 1) = 1)
SELECT m.id, m.path, m.title, m.source, m.content_type, strftime(m.updated_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS updated_at, array_to_string(d.tags, '|') AS tags, n_merged FROM merged m JOIN docs d ON d.id = m.tags_id
"""

P4_FOUND = f"""
WITH words AS (
    SELECT DISTINCT 't' AS side, row_id AS id, {WORDS.format("body")} AS w FROM labeled
    UNION ALL SELECT DISTINCT 'e', row_id, {WORDS.format("body")} FROM holdout),
runs AS (SELECT DISTINCT side, id, {RUNS} AS run FROM words WHERE len(w) >= 20),
sizes AS (SELECT side, id, count(*) AS n FROM runs GROUP BY 1, 2),
shared AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM runs a JOIN runs b ON a.run = b.run AND a.side = 't' AND b.side = 'e' GROUP BY 1, 2)
SELECT a AS labeled_row_id, b AS holdout_row_id FROM shared JOIN sizes x ON x.side = 't' AND x.id = a JOIN sizes y ON y.side = 'e' AND y.id = b
WHERE k >= 0.6 * (x.n + y.n - k)
"""

P4_REPORT = f"""
WITH found AS ({P4_FOUND.strip()}),
n AS (SELECT holdout_row_id AS row_id, count(*) AS k FROM found GROUP BY 1),
held AS (SELECT DISTINCT row_id, split, source FROM holdout WHERE row_id IS NOT NULL)
SELECT split, source, count(*) AS n_rows, count(k) AS n_overlapping, CAST(coalesce(sum(k), 0) AS BIGINT) AS n_pairs FROM held LEFT JOIN n USING (row_id) GROUP BY split, source
"""

P6_FOUND = r"""
WITH sites AS (
    SELECT id AS doc_id, CASE WHEN lower(source) LIKE 'email:%' THEN lower(split_part(source, '@', -1))
        ELSE regexp_replace(regexp_replace(regexp_extract(lower(source), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), ':[0-9]*$', ''), '^www[.]', '') END AS site
    FROM docs WHERE source IS NOT NULL),
lines AS (
    SELECT DISTINCT capture_id, doc_id, unnest(range(1, len(string_split(content_markdown, chr(10))) + 1)) AS line_no, unnest(string_split(content_markdown, chr(10))) AS line FROM captured_content),
normal AS (
    SELECT capture_id, site, line_no, trim(regexp_replace(lower(line), '[^\p{L}]+', ' ', 'g')) AS line
    FROM lines JOIN sites USING (doc_id) WHERE site <> '' AND NOT starts_with(line, '#')),
counted AS (SELECT * FROM normal WHERE length(replace(line, ' ', '')) >= 12),
frequent AS (SELECT site, line FROM counted GROUP BY site, line HAVING count(DISTINCT capture_id) >= 10)
SELECT capture_id, line_no FROM counted JOIN frequent USING (site, line)
"""

_P6_ALL = P6_FOUND[: P6_FOUND.rindex("SELECT capture_id, line_no")].strip().replace("WITH sites", "WITH RECURSIVE sites")

P6_SEQUENCES = rf"""
{_P6_ALL},
key AS (SELECT DISTINCT capture_id, line_no, CAST('0x' || substring(md5(site), 1, 15) AS BIGINT) AS site_key, CAST(CAST('0x' || substring(md5(line), 1, 15) AS BIGINT) AS VARCHAR) AS line FROM counted JOIN frequent USING (site, line)),
grown AS (
    SELECT capture_id, site_key, line AS pattern, min(line_no) AS ended FROM key GROUP BY 1, 2, 3
    UNION
    SELECT g.capture_id, g.site_key, g.pattern || ' ' || k.line, min(k.line_no) FROM grown g JOIN key k ON k.capture_id = g.capture_id AND k.line_no > g.ended GROUP BY 1, 2, g.pattern, k.line)
SELECT site_key, pattern, count(DISTINCT capture_id) AS n_docs FROM grown GROUP BY 1, 2 HAVING count(DISTINCT capture_id) >= 10
"""

P6_CLEANED = rf"""
{P6_FOUND.strip().replace("SELECT capture_id, line_no FROM", ", found AS (SELECT DISTINCT capture_id, line_no FROM").replace(")\n, found", "), found")}),
texts AS (SELECT DISTINCT capture_id, content_markdown FROM captured_content WHERE capture_id IS NOT NULL),
n AS (SELECT capture_id, list(line_no) AS gone FROM found GROUP BY 1)
SELECT capture_id, CASE WHEN gone IS NULL THEN content_markdown ELSE array_to_string([x for x, i in string_split(content_markdown, chr(10)) if NOT list_contains(gone, i)], chr(10)) END AS content_markdown,
    CAST(coalesce(len(gone), 0) AS INT) AS n_removed FROM texts LEFT JOIN n USING (capture_id)
"""

P8_FAULTS = """
SELECT target_id, (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS n_items, CAST(0 AS BIGINT) AS over_capacity, CAST(0 AS BIGINT) AS wrongly_cut, CAST(0 AS BIGINT) AS not_whole FROM pack_targets
"""


def _look() -> str:
    """SQL for what a text looks like: the cleaning in SQL's means, and one representative for letters drawn alike. Placeholders keep the joiners and selectors that count."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    look = "text"
    for sign, kept in (("\u200d", "\ue000"), ("\u200c", "\ue001")):
        for _ in range(2):  # neighbours share letters
            look = f"regexp_replace({look}, '([{lookalikes._EMOJI}\ufe0f{lookalikes._JOINS}]){sign}([{lookalikes._EMOJI}{lookalikes._JOINS}])', '\\1{kept}\\2', 'g')"
    table_ = lookalikes.clean_table()
    single, long = {chr(k): v for k, v in table_.items() if len(v) == 1}, {chr(k): v for k, v in table_.items() if len(v) > 1}
    gone = "".join(chr(k) for k, v in table_.items() if not v) + "\u200c\u200d"
    for sign, value in long.items():
        look = f"replace({look}, {quoted(sign)}, {quoted(value)})"
    look = f"nfc_normalize(translate({look}, {quoted(''.join(single) + gone)}, {quoted(''.join(single.values()))}))"
    look = f"translate(regexp_replace({look}, '([{lookalikes._EMOJI}])\ufe0f', '\\1\ue002', 'g'), '{''.join(map(chr, range(0xFE00, 0xFE10)))}', '')"
    alike = lookalikes.drawn_alike()
    folded = {}
    for code in [*range(0x41, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        parts = [next(iter(alike[c].values())) if c in alike else c for c in unicodedata.normalize("NFD", chr(code))]
        whole = unicodedata.normalize("NFC", "".join(parts))
        if whole != chr(code) and len(whole) == 1:
            folded[chr(code)] = whole
    return f"nfc_normalize(translate({look}, {quoted(''.join(folded))}, {quoted(''.join(folded.values()))}))"


P9_FOUND = f"""
WITH looks AS (SELECT DISTINCT doc_id, text, {_look()} AS look FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)
SELECT DISTINCT least(a.doc_id, b.doc_id) AS doc_id_a, greatest(a.doc_id, b.doc_id) AS doc_id_b FROM looks a JOIN looks b ON a.look = b.look AND a.text < b.text WHERE a.doc_id <> b.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """SQL that gives the same rows, for those queries that SQL can answer over whole tables."""
    return {"p1_found": P1_FOUND, "p1_groups": P1_GROUPS, "p2_found": P2_FOUND, "p2_survivors": P2_SURVIVORS, "p4_found": P4_FOUND, "p4_report": P4_REPORT, "p6_cleaned": P6_CLEANED, "p6_found": P6_FOUND, "p6_sequences": P6_SEQUENCES, "p8_faults": P8_FAULTS, "p9_found": P9_FOUND}
