"""Lines that documents of one site repeat, found by PrefixSpan over line identifiers and removed.

Each document is a sequence of line identifiers (hashes of the lines' normal forms), of which only
lines that are frequent in the site can take part. Patterns grow from the left as in PrefixSpan: a
pattern's projection is what follows its end in each document, and every line frequent there
extends it. Support counts distinct documents of the site. Documents with the same projection are
one row with their number.

:func:`frequent_sequences` mines without limit of length, and with any gaps or with lines at most
``max_gap`` apart. What is removed are the occurrences of the lines of all patterns mined at
``max_gap`` 1, blocks of adjacent frequent lines, single lines among them; their number is bounded by
the text, where that of patterns with any gaps is not.

At scale: the first growth is a distributed step, which cuts the work by site and first line. A pattern
whose projection is small is mined to its end by one task; a large one, on a hot site, takes
further distributed steps until its parts are small. The frequent lines are sent to all tasks only if they
are few, else joined with skew splitting by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmint.staging import is_small, spread, staged

#: A projection of at most so many lines is one task's work.
LOCAL_LINES = 50_000
#: Up to so many frequent (site, line) keys are sent to all executors: 16 bytes each and their overhead.
SMALL_KEYS = 500_000


def normal_line(line: Column) -> Column:
    """The letters of a line, lower-cased; each stretch of other characters is one space, dropped at the ends."""
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}]+", " "))


def key_of(name: Column) -> Column:
    """A number for a string: the first 60 bits of its MD5, so that other engines can tell the same."""
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("bigint")


def site_of(source: Column) -> Column:
    """Host of a web source without case, port and leading ``www.``; for email sources what follows the last ``@``.

    Null for null and for sources that name no host.
    """
    rest = F.regexp_extract(F.lower(source), r"^[a-z][a-z0-9+.\-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, r"^.*@", ""), r":\d*$", ""), r"^www\.", "")
    mail = F.lower(F.substring_index(source, "@", -1))
    site = F.when(F.lower(source).startswith("email:"), F.when(source.contains("@"), mail)).otherwise(host)
    return F.when(site != "", site)


def countable_lines(text: Column, min_letters: int = 12) -> Column:
    """(line_no, line) of the lines that count: not headings, and with at least ``min_letters`` letters.

    ``line`` is the normal form's :func:`key_of`.
    """
    numbered = F.transform(F.split(text, "\n"), lambda x, i: F.struct((i + 1).alias("line_no"), F.when(~x.startswith("#"), normal_line(x)).alias("normal")))
    kept = F.filter(numbered, lambda s: F.length(F.replace(s["normal"], F.lit(" "), F.lit(""))) >= min_letters)
    return F.transform(kept, lambda s: F.struct(s["line_no"].alias("line_no"), key_of(s["normal"]).alias("line")))


def site_lines(captures: DataFrame, docs: DataFrame, id_col: str = "capture_id", text_col: str = "content_markdown") -> DataFrame:
    """(id, site, lines): the countable lines of each capture whose document has a site, one row an id.

    Redelivered rows of an id count once; if their texts differ, the one with the smallest hash counts.
    """
    sites = docs.where(docs["id"].isNotNull()).select(docs["id"].alias("doc_id"), site_of(docs["source"]).alias("site")).where("site is not null").distinct()
    texts = captures.select(captures[id_col].alias("id"), captures["doc_id"].alias("doc_id"), captures[text_col].alias("text")).where("id is not null and text is not null")
    lines = spread(texts).select("id", "doc_id", F.xxhash64("text").alias("version"), countable_lines(F.col("text")).alias("lines"))
    once = lines.groupBy("id", "doc_id").agg(F.min_by("lines", "version").alias("lines"))
    return once.join(sites, "doc_id").select("id", key_of(F.col("site")).alias("site_key"), "site", "lines")


def _frequent(lines: DataFrame, min_docs: int) -> DataFrame:
    """(site_key, line, n_docs) of the lines in at least ``min_docs`` documents of their site."""
    single = lines.select("site_key", F.explode(F.array_distinct(F.col("lines.line"))).alias("line"))
    return single.groupBy("site_key", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs)


def frequent_occurrences(lines: DataFrame, min_docs: int = 10) -> DataFrame:
    """(id, site_key, line_no, line, n_docs): every occurrence of a line with enough support in its site."""
    lines = staged(lines.select("id", "site_key", "lines"), "lines")
    frequent = staged(_frequent(lines, min_docs), "frequent_lines")
    occurrences = lines.select("id", "site_key", F.inline("lines"))
    side = F.broadcast(frequent) if is_small(frequent, SMALL_KEYS) else frequent
    return occurrences.join(side, ["site_key", "line"]).select("id", "site_key", "line_no", "line", "n_docs")


def _sequences(occurrences: DataFrame) -> DataFrame:
    """(site_key, rest, n): the distinct sequences of frequent lines of a site's documents, and how many have each."""
    order = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    ranked = occurrences.groupBy("site_key", "id").agg(F.transform(order, lambda s: s["line"]).alias("rest"))
    return ranked.groupBy("site_key", "rest").agg(F.count("*").alias("n"))


def _grown(rows: DataFrame, max_gap: int | None) -> DataFrame:
    """Projections (site_key, pattern, rest, ends, n) to those of the patterns one line longer.

    ``ends`` are the places in ``rest`` behind which the pattern has ended, from 0. Without a limit of
    gaps the first end is enough: every line that follows a later one follows it.
    """
    if max_gap is None:
        longer = rows.select("site_key", "pattern", "rest", "n", F.explode(F.array_distinct("rest")).alias("line"))
        longer = longer.withColumn("ends", F.array(F.array_position("rest", F.col("line")).cast("int")))
    else:
        places = F.filter(F.sequence(F.lit(1), F.size("rest")), lambda i: F.exists("ends", lambda e: (i > e) & (i <= e + max_gap)))
        longer = rows.where(F.size("rest") > 0).withColumn("places", places)
        longer = longer.select("site_key", "pattern", "rest", "n", "places", F.explode(F.array_distinct(F.transform("places", lambda i: F.element_at("rest", i)))).alias("line"))
        longer = longer.withColumn("ends", F.filter("places", lambda i: F.element_at("rest", i) == F.col("line")))
    first = F.col("ends")[0]
    longer = longer.select("site_key", F.concat("pattern", F.array("line")).alias("pattern"), F.expr("slice(rest, ends[0] + 1, size(rest))").alias("rest"), F.transform("ends", lambda e: e - first).alias("ends"), "n")
    return longer.groupBy("site_key", "pattern", "rest", "ends").agg(F.sum("n").alias("n"))


def _mine(min_docs: int, max_length: int | None, max_gap: int | None):
    """Projections in order of (site_key, pattern) to the frequent patterns (site_key, pattern, n_docs) that begin with each, itself left out."""

    def longer(state: list[tuple[int, list[int]]], rests: list[list[int]]) -> dict[int, list[tuple[int, list[int]]]]:
        found: dict[int, list] = {}
        for k, ends in state:
            rest = rests[k]
            own: dict[int, list[int]] = {}
            if max_gap is None:
                for i in range(ends[0], len(rest)):
                    own.setdefault(rest[i], [i + 1])
            else:
                for i in sorted({i for e in ends for i in range(e, min(e + max_gap, len(rest)))}):
                    own.setdefault(rest[i], []).append(i + 1)
            for line, places in own.items():
                found.setdefault(line, []).append((k, places))
        return found

    def patterns(prefix: list[int], rests: list[list[int]], ends: list[list[int]], ns: list[int]) -> Iterator[tuple[list[int], int]]:
        waiting = [(prefix, list(enumerate(ends)))]
        while waiting:
            pattern, state = waiting.pop()
            if max_length is not None and len(pattern) >= max_length:
                continue
            for line, places in longer(state, rests).items():
                if (support := sum(ns[k] for k, _ in places)) >= min_docs:
                    grown = [*pattern, line]
                    yield grown, support
                    waiting.append((grown, places))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list] = ([], [], [])

        def flushed() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int64())), pa.array(out[2], pa.int64())], ["site_key", "pattern", "n_docs"])
            for x in out:
                x.clear()
            return made

        def mined(group: tuple[int, list[int]], rests: list, ends: list, ns: list) -> Iterator[pa.RecordBatch]:
            for pattern, support in patterns(group[1], rests, ends, ns):
                out[0].append(group[0]), out[1].append(pattern), out[2].append(support)
                if len(out[0]) >= 20_000:
                    yield flushed()

        group, held = None, ([], [], [])
        for batch in batches:
            for site, pattern, rest, ends, n in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if (site, pattern) != group:
                    if group is not None:
                        yield from mined(group, *held)
                    group, held = (site, pattern), ([], [], [])
                held[0].append(rest), held[1].append(ends), held[2].append(n)
        if group is not None:
            yield from mined(group, *held)
        yield flushed()

    return run


def frequent_sequences(lines: DataFrame, min_docs: int = 10, max_length: int | None = None, max_gap: int | None = None, local_lines: int = LOCAL_LINES) -> DataFrame:
    """(site_key, pattern, n_docs): PrefixSpan's frequent sequences of lines a site, of any length and with any gaps.

    ``max_length`` ends the growth early; with ``max_gap`` a line extends a pattern only if it comes at
    most so many frequent lines after the pattern's end (1: the next one). An empty table gives an empty result.
    """
    return _mined(staged(frequent_occurrences(lines, min_docs), "occurrences"), min_docs, max_length, max_gap, local_lines)


def _mined(occurrences: DataFrame, min_docs: int, max_length: int | None, max_gap: int | None, local_lines: int) -> DataFrame:
    anywhere = F.array(F.lit(0)) if max_gap is None else F.sequence(F.lit(0), F.size("rest") - 1)
    rows = _sequences(occurrences).select("site_key", F.array().cast("array<bigint>").alias("pattern"), "rest", anywhere.alias("ends"), "n")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key, found, length = ["site_key", "pattern"], [], 0
    while True:
        rows, length = staged(_grown(rows, max_gap), "projections"), length + 1
        support = rows.groupBy(*key).agg(F.sum("n").alias("n_docs"), F.sum(F.size("rest")).alias("lines")).where(F.col("n_docs") >= min_docs)
        support = staged(support, "patterns")
        found.append(support.select(*key, "n_docs"))
        if max_length is not None and length >= max_length:
            break
        ongoing = rows.where(F.size("rest") > 0)
        small = ongoing.join(support.where(F.col("lines") <= local_lines).select(*key), key, "left_semi")
        small = small.repartition(4 * n, *key).sortWithinPartitions(*key)
        found.append(small.mapInArrow(_mine(min_docs, max_length, max_gap), "site_key bigint, pattern array<bigint>, n_docs bigint"))
        large = support.where(F.col("lines") > local_lines).select(*key)
        if large.isEmpty():
            break
        rows = ongoing.join(large, key, "left_semi")
    return reduce(DataFrame.unionByName, found)


def repeated_occurrences(lines: DataFrame, min_docs: int = 10) -> DataFrame:
    """(id, line_no): every occurrence of a line of a mined block of adjacent lines, single lines among them."""
    occurrences = staged(frequent_occurrences(lines, min_docs), "occurrences")
    patterns = _mined(occurrences, min_docs, None, 1, LOCAL_LINES)
    mined = staged(patterns.select("site_key", F.explode("pattern").alias("line")).distinct(), "mined_lines")
    side = F.broadcast(mined) if is_small(mined, SMALL_KEYS) else mined
    return occurrences.join(side, ["site_key", "line"], "left_semi").select("id", "line_no")


def without_lines(captures: DataFrame, found: DataFrame, id_col: str = "capture_id", text_col: str = "content_markdown") -> DataFrame:
    """(id_col, text_col, n_removed): each capture without its lines in ``found`` (id_col, line_no); one row an id and text.

    A text of which no line is found stays as it is; null stays null, and rows with a null id are left
    out. The texts are shuffled once, by id.
    """
    texts = captures.where(captures[id_col].isNotNull()).select(captures[id_col].alias(id_col), captures[text_col].alias(text_col))
    texts = texts.repartition(id_col).dropDuplicates()
    gone = found.groupBy(id_col).agg(F.collect_set("line_no").alias("gone"))
    split = F.split(text_col, "\n")
    kept = F.filter(split, lambda x, i: ~F.array_contains("gone", (i + 1)))
    return texts.join(gone, id_col, "left").select(
        id_col, F.when(F.col("gone").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")).alias(text_col), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed")
    )
