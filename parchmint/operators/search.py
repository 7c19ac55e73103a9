"""Full-text search over sections: an inverted index as a table, three query modes, BM25.

The index is ordinary data in segments: ``postings`` (term, doc_id, ord, positions by column) and the
sections. A search reads the postings of its terms only, which is a pushed-down filter on files
written in term order, aggregates them by section, evaluates the query's boolean tree as one
expression and keeps the best k with ``TakeOrderedAndProject``. The query is parsed on the driver.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from parchmint.functions.text import TOKEN, fold, tokens
from parchmint.staging import is_small, new_path, scratch, shared_dir, spread, staged

# Words a query of mode "any" does without, and BM25's constants.
STOPWORDS = ["a", "an", "and", "or", "the", "of", "in", "on", "at", "to", "for", "is", "are", "be", "with", "as", "by", "from", "this", "that", "it", "i", "you"]
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
TITLE_WEIGHT, BODY_WEIGHT = 5.0, 1.0
#: Characters with a meaning in the query syntax; plain modes take them as spaces.
OPERATORS = "\"'()*+:^,{}?!~<>=&|\\"
COLUMNS = ("title", "body")


class SearchError(ValueError):
    """A query that cannot be answered."""


# Query trees ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Phrase:
    """Adjacent tokens in one of ``columns``; the last may be a prefix, the first may have to begin the column."""

    tokens: tuple[str, ...]
    columns: tuple[str, ...] = COLUMNS
    prefix: bool = False
    first: bool = False


@dataclass(frozen=True)
class Near:
    """Phrases of one column with at most ``distance`` tokens between the first's end and the last's start."""

    phrases: tuple[Phrase, ...]
    distance: int = 10


@dataclass(frozen=True)
class Node:
    """``and``, ``or`` or ``not`` (left without right) over trees."""

    kind: str
    parts: tuple


def words_of(spark: SparkSession, text: str) -> list[str]:
    """A query's tokens, by the index's own tokenizer, so that both fold alike; a local relation, for which no job is started."""
    if text.isascii():
        return re.findall(r"[a-z0-9]+", text.lower())
    return list(spark.createDataFrame([(text,)], "t string").select(tokens(F.col("t")).alias("t")).collect()[0]["t"])


class Parser:
    """The power user's syntax: AND, OR, NOT, implicit AND, parentheses, "phrases", prefix*, ^first, a + b, NEAR(...), column filters."""

    LEX = re.compile(r'\s+|"((?:[^"]|"")*)"|([(){}:*^+,\-])|([\w\u0080-\U0010ffff]+)')

    def __init__(self, text: str, tokenize):
        self.tokenize, self.lexemes, at = tokenize, [], 0
        while at < len(text):
            m = self.LEX.match(text, at)
            if not m:
                raise SearchError(f"syntax error near {text[at]!r}")
            if m.group(1) is not None:
                self.lexemes.append(("string", m.group(1).replace('""', '"')))
            elif m.group(2):
                self.lexemes.append((m.group(2), m.group(2)))
            elif m.group(3):
                word = m.group(3)
                self.lexemes.append((word if word in ("AND", "OR", "NOT") else "word", word))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> str:
        return self.lexemes[self.at + ahead][0] if self.at + ahead < len(self.lexemes) else ""

    def take(self, kind: str) -> str:
        if self.peek() != kind:
            raise SearchError(f"syntax error: {kind} expected")
        self.at += 1
        return self.lexemes[self.at - 1][1]

    def parse(self):
        tree = self.disjunction()
        if self.at < len(self.lexemes):
            raise SearchError(f"syntax error near {self.lexemes[self.at][1]!r}")
        return tree

    def disjunction(self):
        parts = [self.conjunction()]
        while self.peek() == "OR":
            self.at += 1
            parts.append(self.conjunction())
        return parts[0] if len(parts) == 1 else Node("or", tuple(parts))

    def conjunction(self):
        parts = [self.negation()]
        while self.peek() == "AND":
            self.at += 1
            parts.append(self.negation())
        return parts[0] if len(parts) == 1 else Node("and", tuple(parts))

    def negation(self):
        left = self.implicit()
        while self.peek() == "NOT":
            self.at += 1
            left = Node("not", (left, self.implicit()))
        return left

    def implicit(self):
        parts = [self.primary()]
        while self.peek() in ("word", "string", "(", "^", "{", "-"):
            parts.append(self.primary())
        return parts[0] if len(parts) == 1 else Node("and", tuple(parts))

    def primary(self, columns: tuple[str, ...] = COLUMNS):
        if self.peek() == "(":
            self.at += 1
            tree = self.disjunction()
            self.take(")")
            return tree if columns == COLUMNS else within(tree, columns)
        chosen = self.column_filter()
        if chosen is not None:
            return self.primary(tuple(c for c in chosen if c in columns))
        if self.peek() == "word" and self.lexemes[self.at][1] == "NEAR" and self.peek(1) == "(":
            self.at += 2
            phrases = [self.phrase(columns)]
            while self.peek() in ("word", "string", "^"):
                phrases.append(self.phrase(columns))
            distance = 10
            if self.peek() == ",":
                self.at += 1
                number = self.take("word")
                if not number.isdigit():
                    raise SearchError("NEAR needs a number")
                distance = int(number)
            self.take(")")
            return Near(tuple(phrases), distance)
        return self.phrase(columns)

    def column_filter(self) -> tuple[str, ...] | None:
        start, without = self.at, False
        if self.peek() == "-":
            without, self.at = True, self.at + 1
        if self.peek() == "{":
            self.at += 1
            names = []
            while self.peek() == "word":
                names.append(self.take("word"))
            self.take("}")
        elif self.peek() in ("word", "string") and self.peek(1) == ":":
            names = [self.take(self.peek())]
        else:
            if without:
                raise SearchError("syntax error near '-'")
            self.at = start
            return None
        self.take(":")
        for name in names:
            if name.lower() not in COLUMNS:
                raise SearchError(f"no such column: {name}")
        chosen = {n.lower() for n in names}
        return tuple(c for c in COLUMNS if (c in chosen) != without)

    def phrase(self, columns: tuple[str, ...]) -> Phrase:
        first = self.peek() == "^"
        self.at += first
        found: list[str] = []
        while True:
            if self.peek() not in ("word", "string"):
                raise SearchError("syntax error: a term expected")
            found += self.tokenize(self.take(self.peek()))
            if self.peek() != "+":
                break
            self.at += 1
        prefix = self.peek() == "*"
        self.at += prefix
        return Phrase(tuple(found), columns, prefix, first)


def within(tree, columns: tuple[str, ...]):
    """The tree with its phrases restricted to ``columns``."""
    if isinstance(tree, Phrase):
        return Phrase(tree.tokens, tuple(c for c in tree.columns if c in columns), tree.prefix, tree.first)
    if isinstance(tree, Near):
        return Near(tuple(within(p, columns) for p in tree.phrases), tree.distance)
    return Node(tree.kind, tuple(within(p, columns) for p in tree.parts))


def compile_query(text: str, mode: str, tokenize):
    """The tree of a query in mode ``any`` (any word but stopwords), ``substring`` (all words, as phrases) or ``fts`` (syntax).

    A plain word that the syntax would refuse is quoted instead.
    """
    if mode not in ("any", "substring", "fts"):
        raise SearchError(f"unknown mode {mode!r}")
    if not text or not text.strip():
        raise SearchError("empty query")
    if mode == "fts":
        return Parser(text.strip(), tokenize).parse()
    blank = str.maketrans(dict.fromkeys(OPERATORS, " "))
    raw = [w.translate(blank).strip() for w in re.split(r"[\s\-‐-―]+", text)]
    raw = [w for w in raw if w]
    if mode == "any":
        raw = [w for w in raw if w.lower() not in STOPWORDS] or raw
    trees = []
    for w in raw:
        found = tuple(tokenize(w))
        if not found:
            continue
        # A word with inner spaces is an implicit AND of its pieces, and binds tighter than OR.
        whole = Phrase(found) if mode == "substring" or " " not in w else Node("and", tuple(Phrase(tuple(tokenize(x))) for x in w.split() if tokenize(x)))
        trees.append(whole)
    if not trees:
        raise SearchError("query has no usable tokens")
    return trees[0] if len(trees) == 1 else Node("or" if mode == "any" else "and", tuple(trees))


def phrases_of(tree) -> list[Phrase]:
    if isinstance(tree, Phrase):
        return [tree]
    return [p for part in (tree.phrases if isinstance(tree, Near) else tree.parts) for p in phrases_of(part)]


# The index -----------------------------------------------------------------------------------------


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, ord, tokens of the title, tokens of the body) to one row for each term of a section, with its places; a section's terms stand in its row, so nothing is shuffled."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            lists = [pa.concat_arrays([part.column(k)]) for k in (2, 3)]
            counts = [np.diff(x.offsets.to_numpy()) for x in lists]
            coded = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
            codes, terms = coded.indices.to_numpy(), coded.dictionary
            n_terms, split = max(len(terms), 1), int(counts[0].sum())
            keys, places = [], []
            for own, count in ((codes[:split], counts[0]), (codes[split:], counts[1])):
                section = np.repeat(np.arange(part.num_rows), count)
                starts = np.repeat(np.cumsum(count) - count, count)
                key = section * n_terms + own
                order = np.argsort(key, kind="stable")
                keys.append(key[order])
                places.append((np.arange(len(key)) - starts)[order])
            every = np.union1d(*keys)
            if not len(every):
                continue
            found = []
            for key, place in zip(keys, places):
                offsets = np.r_[np.searchsorted(key, every), len(key)].astype(np.int32)
                found.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(place.astype(np.int32))))
            row = pa.array(every // n_terms)
            n_tokens = pa.array((counts[0] + counts[1]).astype(np.int32)).take(row)
            yield pa.RecordBatch.from_arrays([terms.take(pa.array(every % n_terms)), part.column(0).take(row), part.column(1).take(row), n_tokens, *found], ["term", "doc_id", "ord", "n_tokens", "pos_title", "pos_body"])


#: So many segments an index has before they are merged into one.
MOST_SEGMENTS = 8
#: Up to so many hits are constants of the plan that fetches them.
FEW_HITS = 50
#: Row groups of sections are small, so that the few that hold a result are read.
SECTION_GROUP = 4 * 2**20


@dataclass
class SearchIndex:
    """``postings`` (term, doc_id, ord, n_tokens, pos_title, pos_body) and ``sections`` (doc_id, ord, title, path, body, n_tokens).

    An index is a list of segments, each written once. A change adds a segment, and the ids it concerns count as
    gone in the older ones; when the segments are many they are merged.
    """

    segments: list[tuple[DataFrame, DataFrame]]
    #: (doc_id, before): documents that are gone from the segments before a number.
    gone: DataFrame | None = None
    _totals: tuple[int, float] | None = field(default=None, repr=False)

    @classmethod
    def build(cls, sections: DataFrame, path: str | None = None) -> SearchIndex:
        """Index sections (doc_id, ord, title, path, body), at ``path`` or in the shared folder.

        Postings are written in term order, so that a search skips the files without its terms; sections in order of
        document within each file, in small row groups.
        """
        spark = sections.sparkSession
        rows = spread(sections).select("doc_id", "ord", F.coalesce("title", F.lit("")).alias("title"), "path", F.coalesce("body", F.lit("")).alias("body"))
        counted = rows.withColumns({"t_title": tokens(F.col("title")), "t_body": tokens(F.col("body"))})
        id_type = rows.schema["doc_id"].dataType.simpleString()
        posting = counted.select("doc_id", F.col("ord").cast("int").alias("ord"), "t_title", "t_body").mapInArrow(_postings, f"term string, doc_id {id_type}, ord int, n_tokens int, pos_title array<int>, pos_body array<int>")
        count = lambda c: F.regexp_count(fold(F.col(c)), F.lit(TOKEN))  # noqa: E731  cheaper than the tokens
        kept = rows.select("doc_id", "ord", "title", "path", "body", (count("title") + count("body")).alias("n_tokens"))
        # Staged before it is ordered, as range partitioning samples its input.
        return cls._written(spark, staged(posting, "unordered"), kept, path)

    @classmethod
    def _written(cls, spark: SparkSession, posting: DataFrame, kept: DataFrame, path: str | None) -> SearchIndex:
        path = path or new_path(spark, "index")
        posting.repartitionByRange("term", "doc_id").sortWithinPartitions("term").write.option("compression", "zstd").mode("overwrite").parquet(f"{path}/postings")
        kept.sortWithinPartitions("doc_id", "ord").write.option("compression", "zstd").option("parquet.block.size", SECTION_GROUP).mode("overwrite").parquet(f"{path}/sections")
        return cls([(spark.read.schema(posting.schema).parquet(f"{path}/postings"), spark.read.schema(kept.schema).parquet(f"{path}/sections"))])

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SearchIndex:
        return cls([(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/sections"))])

    def _living(self, side: int) -> DataFrame:
        parts = []
        for number, segment in enumerate(self.segments):
            rows = segment[side]
            if self.gone is not None and number < len(self.segments) - 1:
                rows = rows.join(F.broadcast(self.gone.where(F.col("before") > number).select("doc_id").distinct()) if self._few_gone else self.gone.where(F.col("before") > number).select("doc_id").distinct(), "doc_id", "left_anti")
            parts.append(rows.select(*self.segments[0][side].columns))
        return reduce(DataFrame.unionByName, parts)

    @cached_property
    def _few_gone(self) -> bool:
        return is_small(self.gone, 500_000)

    @property
    def postings(self) -> DataFrame:
        return self._living(0)

    @property
    def sections(self) -> DataFrame:
        return self._living(1)

    def totals(self) -> tuple[int, float]:
        """Number of sections and their average length."""
        if self._totals is None:
            row = self.sections.agg(F.count("*").alias("n"), F.avg("n_tokens").alias("avg")).first()
            self._totals = (row["n"], row["avg"] or 0.0)
        return self._totals

    def replaced(self, changed: DataFrame, new_sections: DataFrame) -> SearchIndex:
        """The index after the documents of ``changed`` (doc_id) got ``new_sections`` (none: they are gone)."""
        fresh = SearchIndex.build(new_sections).segments[0]
        gone = changed.select("doc_id").distinct().withColumn("before", F.lit(len(self.segments)))
        gone = staged(gone if self.gone is None else self.gone.unionByName(gone).groupBy("doc_id").agg(F.max("before").alias("before")), "gone")
        after = SearchIndex([*self.segments, fresh], gone)
        return after.merged() if len(after.segments) > MOST_SEGMENTS else after

    def merged(self) -> SearchIndex:
        """The same index as one segment, without what is gone."""
        return SearchIndex._written(self.segments[0][0].sparkSession, self.postings, self.sections, None)

    def doc_ids(self) -> DataFrame:
        return self.sections.select("doc_id").distinct()

    # Search ----------------------------------------------------------------------------------------

    def _places(self, term: Column, name: str) -> Column:
        """Positions of a term in a column, of the rows of one section."""
        return F.array_sort(F.flatten(F.collect_list(F.when(term, F.col(f"pos_{name}")))))

    def matches(self, tree, title_weight: float = TITLE_WEIGHT, body_weight: float = BODY_WEIGHT) -> DataFrame:
        """(doc_id, ord, score): the sections that match a tree; smaller scores are better."""
        phrases = phrases_of(tree)
        asked = [(t, p.prefix and k == len(p.tokens) - 1) for p in phrases for k, t in enumerate(p.tokens)]
        if not asked:
            raise SearchError("query has no usable tokens")
        exact = sorted({t for t, prefix in asked if not prefix})
        wanted = F.col("term").isin(exact) if exact else F.lit(False)
        for t in sorted({t for t, prefix in asked if prefix}):
            wanted = wanted | F.col("term").startswith(t)
        n_rows, average = self.totals()

        columns = {}
        for i, p in enumerate(phrases):
            for name in p.columns:
                for k, t in enumerate(p.tokens):
                    is_it = F.col("term").startswith(t) if p.prefix and k == len(p.tokens) - 1 else F.col("term") == t
                    columns[f"p{i}_{name}_{k}"] = self._places(is_it, name)
        rows = self.postings.where(wanted).groupBy("doc_id", "ord", "n_tokens").agg(*[c.alias(n) for n, c in columns.items()])

        starts = {}
        for i, p in enumerate(phrases):
            for name in p.columns:
                parts = [F.transform(F.col(f"p{i}_{name}_{k}"), _less(k)) for k in range(len(p.tokens))]
                at = reduce(F.array_intersect, parts) if len(parts) > 1 else parts[0]
                starts[f"s{i}_{name}"] = F.filter(at, lambda x: x == 0) if p.first else at
        rows = rows.select("doc_id", "ord", "n_tokens", *[c.alias(n) for n, c in starts.items()])

        # NEAR keeps only the places that take part in a neighbourhood.
        number = iter(range(len(phrases)))
        near: list[tuple[Near, list[int]]] = []

        def walk(node) -> None:
            if isinstance(node, Phrase):
                next(number)
            elif isinstance(node, Near):
                near.append((node, [next(number) for _ in node.phrases]))
            else:
                for part in node.parts:
                    walk(part)

        walk(tree)
        # How rare a phrase is does not depend on its neighbours.
        rows = rows.withColumns({f"any{i}": reduce(lambda a, b: a | b, [F.size(f"s{i}_{name}") > 0 for name in p.columns], F.lit(False)) for i, p in enumerate(phrases)})
        for node, own in near:
            for name in COLUMNS:
                if all(f"s{i}_{name}" in starts for i in own):
                    kept = _near(node, own, phrases, name)
                    rows = rows.withColumns({f"s{i}_{name}": kept[i] for i in own})
                else:
                    rows = rows.withColumns({f"s{i}_{name}": F.array().cast("array<int>") for i in own if f"s{i}_{name}" in starts})

        counts = [sum((F.size(f"s{i}_{name}") * (title_weight if name == "title" else body_weight) for name in p.columns), F.lit(0.0)) for i, p in enumerate(phrases)]
        rows = rows.select("doc_id", "ord", "n_tokens", *[c.alias(f"f{i}") for i, c in enumerate(counts)], *[f"any{i}" for i in range(len(phrases))])
        if all(len(p.tokens) == 1 and not p.prefix and not p.first and p.columns == COLUMNS for p in phrases):
            # A term's postings are its sections.
            held = {r["term"]: r["n"] for r in self.postings.where(wanted).groupBy("term").agg(F.count("*").alias("n")).collect()}  # one row a term of the query
            frequency = {f"n{i}": held.get(p.tokens[0], 0) for i, p in enumerate(phrases)}
        else:
            rows = staged(rows, "hits")
            frequency = rows.agg(*[F.count_if(f"any{i}").alias(f"n{i}") for i in range(len(phrases))]).first()

        idf = [max(math.log((n_rows - frequency[f"n{i}"] + 0.5) / (frequency[f"n{i}"] + 0.5)), LEAST_IDF) if n_rows else 0.0 for i in range(len(phrases))]
        norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("n_tokens") / F.lit(average or 1.0))
        gain = [F.lit(idf[i] * (K1 + 1)) * F.col(f"f{i}") / (F.col(f"f{i}") + norm) for i in range(len(phrases))]
        number = iter(range(len(phrases)))

        def evaluate(node) -> tuple[Column, Column]:
            """Whether a node matches, and its score where it does; a phrase counts only if all nodes around it match."""
            if isinstance(node, Phrase):
                i = next(number)
                return F.col(f"f{i}") > 0, F.when(F.col(f"f{i}") > 0, gain[i]).otherwise(0.0)
            if isinstance(node, Near):
                own = [next(number) for _ in node.phrases]
                hit = reduce(lambda a, b: a & b, [F.col(f"f{i}") > 0 for i in own])
                return hit, F.when(hit, sum((gain[i] for i in own), F.lit(0.0))).otherwise(0.0)
            parts = [evaluate(p) for p in node.parts]
            if node.kind == "not":
                hit = parts[0][0] & ~parts[1][0]
                return hit, F.when(hit, parts[0][1]).otherwise(0.0)
            hit = reduce((lambda a, b: a | b) if node.kind == "or" else (lambda a, b: a & b), [h for h, _ in parts])
            return hit, F.when(hit, sum((s for _, s in parts), F.lit(0.0))).otherwise(0.0)

        hit, score = evaluate(tree)
        return rows.where(hit).select("doc_id", "ord", (-score).alias("score"))

    def search(self, query: str, limit: int = 20, mode: str = "any") -> DataFrame:
        """(doc_id, section_title, section_path, snippet, score): the best sections, ties by doc_id and order."""
        if not 1 <= limit <= 1000:
            raise SearchError("limit must be from 1 to 1000")
        spark = self.segments[0][0].sparkSession
        tree = compile_query(query, mode, lambda t: words_of(spark, t))
        with scratch(spark):
            best = self.matches(tree).orderBy("score", "doc_id", "ord").limit(limit)
            schema, best = best.schema, best.collect()  # at most ``limit`` rows
        # The ids reach the scan, which reads the row groups that may have them.
        few = self.sections.where(F.col("doc_id").isin([r["doc_id"] for r in best]))
        kind = few.schema
        if len(best) <= FEW_HITS:
            scores = F.create_map(*[x for r in best for x in (F.struct(F.lit(r["doc_id"]).cast(kind["doc_id"].dataType).alias("d"), F.lit(r["ord"]).cast(kind["ord"].dataType).alias("o")), F.lit(r["score"]))]) if best else F.lit(None).cast("map<int,double>")
            at = F.struct(F.col("doc_id").alias("d"), F.col("ord").alias("o"))
            rows = few.withColumn("score", scores[at]).where("score is not null") if best else few.withColumn("score", F.lit(None).cast("double"))
        else:
            rows = few.join(F.broadcast(spark.createDataFrame(best, schema)), ["doc_id", "ord"])
        asked = F.array(*[F.lit(t) for t in sorted({t for p in phrases_of(tree) for t in p.tokens})])
        return rows.orderBy("score", "doc_id", "ord").select("doc_id", F.nullif("title", F.lit("")).alias("section_title"), F.col("path").alias("section_path"), snippet(F.col("body"), asked).alias("snippet"), "score")


# Higher-order functions count a lambda's parameters, so constants come by closure.


def _equal_to(value: str):
    return lambda x: x == value


def _less(k: int):
    return lambda x: x - k


def _near(node: Near, own: list[int], phrases: list[Phrase], name: str) -> dict[int, Column]:
    """For each phrase of a NEAR its places in some neighbourhood: all phrases, none too far before the last one's place."""
    places = F.flatten(F.array(*[F.col(f"s{i}_{name}") for i in own]))

    def reaches(i: int, place: Column, last: Column) -> Column:
        return (place <= last) & (last - place <= node.distance + len(phrases[i].tokens))

    def reached_from(j: int, last: Column) -> Column:
        return F.exists(f"s{j}_{name}", lambda y: reaches(j, y, last))

    def together(i: int):
        def test(x: Column) -> Column:
            return F.exists(places, lambda last: reduce(lambda a, b: a & b, [reached_from(j, last) for j in own if j != i], reaches(i, x, last)))

        return test

    return {i: F.filter(f"s{i}_{name}", together(i)) for i in own}


@F.pandas_udf(StringType())
def snippet(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The 32 words of a body with the most different query terms, marked; of survivors only."""
    import unicodedata

    def fold(w: str) -> str:
        return "".join(c for c in unicodedata.normalize("NFD", w.lower()) if unicodedata.category(c) != "Mn")

    def one(body: str, asked: list[str], width: int = 32) -> str:
        spans = [(m.start(), m.end(), fold(m.group())) for m in re.finditer(r"[^\W_]+", body)]
        hits = [k for k, s in enumerate(spans) if any(s[2] == a for a in asked)]
        best = max(hits, key=lambda k: (len({spans[j][2] for j in hits if k <= j < k + width}), -k), default=0)
        start = 0 if best < width else best
        chosen = spans[start : start + width]
        if not chosen:
            return body[:200]
        out, at = ["…" if start else ""], chosen[0][0] if start else 0
        for s, e, w in chosen:
            out.append(body[at:s] + (f"<mark>{body[s:e]}</mark>" if w in asked else body[s:e]))
            at = e
        last = start + width >= len(spans)
        return "".join(out) + (body[at:] if last else "…")

    for bodies, terms in batches:
        yield pd.Series([one(b or "", list(t)) for b, t in zip(bodies, terms)], dtype="object")


def index_of(spark: SparkSession, name: str = "index") -> str:
    """A place in the shared folder for an index of this session."""
    return f"{shared_dir(spark)}/{name}"


def bm25_scan(rows: DataFrame, id_col: str, text_col: str, terms: list[str]) -> DataFrame:
    """(id, score) of the rows that hold any of ``terms`` (folded), by BM25 over the whole texts, without an index.

    One pass computes lengths and counts, which are staged; the statistics of the corpus are one small
    aggregate over them. Null texts are no rows of the corpus.
    """
    held = spread(rows.where(F.col(text_col).isNotNull()).select(id_col, text_col)).select(F.col(id_col).alias("id"), fold(F.col(text_col)).alias("t"))
    # Counts by patterns stay in generated code, where the folded text is computed once for all of them.
    token = r"\p{L}\p{N}\p{Co}"
    count = lambda pattern: F.regexp_count("t", F.lit(pattern))
    counted = staged(held.select("id", count(f"[{token}]+").alias("n"), *[count(f"(?<![{token}]){re.escape(t)}(?![{token}])").alias(f"f{i}") for i, t in enumerate(terms)]), "counts")
    totals = counted.agg(F.count("*").alias("rows"), F.avg("n").alias("average"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(terms))]).first()
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("n") / F.lit(totals["average"] or 1.0))
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = max(math.log((totals["rows"] - totals[f"d{i}"] + 0.5) / (totals[f"d{i}"] + 0.5)), LEAST_IDF)
        score = score + F.lit(idf * (K1 + 1)) * F.col(f"f{i}") / (F.col(f"f{i}") + norm)
    any_hit = reduce(lambda a, b: a | b, [F.col(f"f{i}") > 0 for i in range(len(terms))])
    return counted.where(any_hit).select("id", (-score).alias("score"))
