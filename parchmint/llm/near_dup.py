"""Near-duplicate texts by min-max hashing.

Every distinct set of word runs (a *class*; texts with equal sets, exact copies among them, share
one) gets a signature that keeps both the minimum and the maximum under each of ``k`` hash
functions, so ``2k`` values cost ``k`` evaluations. Bands of the signature are the keys under
which classes meet; a bit sketch of the same signature drops most chance meetings before the
likeness is computed exactly.

At scale: classes, not texts, are banded, and a class is banded once per task however many copies
it has. A key's classes are streamed in key order. Classes that meet more than ``crowd`` others under
one key are not paired there: they go, whole, to an exact prefix-filter join among themselves
(:mod:`parchmint.llm.prefixes`), which finds every pair without pairing all. Keys so crowded that
a sample of classes shows it are taken out before the shuffle, so no task gets a large group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmint.llm import prefixes
from parchmint.llm import shingles as S
from parchmint.staging import is_small, spread, staged

#: Below this estimate a meeting is dropped unverified, in standard deviations under the threshold.
SLACK = 4.5
#: Up to so many rows of ids are sent to all executors, if they are no longer than 64 MB together.
SMALL_IDS = 1_000_000
#: Crowded keys are looked for among one class of so many.
SAMPLE = 64
#: Band keys of one task of the shuffle.
KEYS_A_TASK = 4_000_000


@dataclass(frozen=True)
class Bands:
    """How a signature is cut: ``count`` bands of ``rows`` values from ``functions`` hash functions."""

    rows: int
    count: int

    @property
    def functions(self) -> int:
        return math.ceil(self.rows * self.count / 2)

    @property
    def longs(self) -> int:
        return 2 * self.functions // 64

    @classmethod
    def for_threshold(cls, threshold: float, recall: float = 0.99, values: int = 600) -> Bands:
        """The longest bands that find a pair at ``threshold`` with probability ``recall`` within ``values`` values."""
        best = cls(1, 1)
        for rows in range(1, 65):
            hit = threshold**rows
            count = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit))
            if rows * count > values:
                break
            best = cls(rows, count)
        return best


class Signer:
    """Min-max signatures, their band keys and their bit sketches."""

    def __init__(self, bands: Bands, seed: int = 7):
        rng = np.random.default_rng(seed)
        k = bands.functions
        self.bands = bands
        self.mul = (rng.integers(0, 2**32, k, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
        self.add = rng.integers(0, 2**32, k, dtype=np.uint64).astype(np.uint32)
        self.fold = rng.integers(0, 2**63, (bands.count, bands.rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.band_no = np.arange(bands.count, dtype=np.uint64) << np.uint64(44)

    def values(self, sets: list[np.ndarray]) -> np.ndarray:
        """For each set (none empty), minimum and maximum under each function, side by side: 2k numbers of 32 bits."""
        x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *map(len, sets[:-1])])
        out = np.empty((2 * len(self.mul), len(sets)), np.uint32)
        for k in range(len(self.mul)):
            v = x * self.mul[k]
            v += self.add[k]
            np.minimum.reduceat(v, starts, out=out[2 * k])
            np.maximum.reduceat(v, starts, out=out[2 * k + 1])
        return out.T.copy()

    def keys(self, values: np.ndarray) -> np.ndarray:
        """One key a band: its number above 44 bits of a hash of its values."""
        b = self.bands
        parts = values[: b.rows * b.count].reshape(b.count, b.rows).astype(np.uint64)
        h = S.mixed((S.mixed(parts * self.fold)).sum(1, dtype=np.uint64))
        return ((h >> np.uint64(20)) | self.band_no).view(np.int64)

    def sketch(self, values: np.ndarray) -> np.ndarray:
        """One bit of each value, in 64-bit numbers."""
        bits = (values * np.uint32(0x9E3779B1)) >> np.uint32(31)
        return np.packbits(bits[: self.bands.longs * 64].astype(np.uint8)).view(np.int64)


def _sign(bands: Bands, size: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, hashes, done = Signer(bands), S.WordHashes(), set()
        names = ["id", "cls", "keys", *(f"s{k}" for k in range(bands.longs))]
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                kept, ids, fresh, sets = [], [], [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    tokens = S.words(text)
                    if len(tokens) < max(min_words, size):
                        continue
                    runs = S.shingle_set(tokens, hashes, size)
                    kept.append(row)
                    ids.append(own := S.set_id(runs))
                    fresh.append(own not in done)  # else a copy; its class was banded by this task
                    if fresh[-1]:
                        if len(done) > 1_000_000:
                            done.clear()
                        done.add(own)
                        sets.append(runs)
                if not kept:
                    continue
                new = np.array(fresh, bool)
                values = signer.values(sets) if sets else np.empty((0, 2 * bands.functions), np.uint32)
                flat = np.concatenate([signer.keys(v) for v in values]) if sets else np.empty(0, np.int64)
                parts = np.zeros((len(kept), bands.longs), np.int64)
                if sets and bands.longs:
                    parts[new] = np.array([signer.sketch(v) for v in values])
                listed = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(new * bands.count)].astype(np.int32)), pa.array(flat), mask=pa.array(~new))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(kept, pa.int64())), pa.array(ids, pa.int64()), listed, *(pa.array(parts[:, k], mask=~new) for k in range(bands.longs))], names)

    return run


def _meet(crowd: int):
    """Rows (key, cls) in key order to pairs (a, b) of a key's classes, or (a, null) for each class of a key with more than ``crowd``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, full = None, np.empty(0, np.int64), False

        def rows(left: list, right: list, alone: list) -> Iterator[pa.RecordBatch]:
            for x, y in ((left, right), (alone, None)):
                if x:
                    a = np.concatenate(x)
                    b = pa.array(np.concatenate(y)) if y else pa.nulls(len(a), pa.int64())
                    for at in range(0, len(a), 100_000):
                        yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 100_000]), b.slice(at, 100_000)], ["a", "b"])

        for batch in batches:
            keys, classes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(keys):
                continue
            left, right, alone, size = [], [], [], 0
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            ends = np.r_[starts[1:], len(keys)]
            for s, e in zip(starts.tolist(), ends.tolist()):
                if keys[s] == key:
                    held = np.unique(np.r_[held, classes[s:e]])
                else:
                    if e - s == 1 and e != len(keys) and s != 0:
                        continue  # a whole group of one row meets nobody
                    if full:
                        alone.append(held)
                    elif len(held) > 1:
                        i, j = np.triu_indices(len(held), 1)
                        left.append(held[i])
                        right.append(held[j])
                        size += len(i)
                    key, held, full = keys[s], np.unique(classes[s:e]), False
                if len(held) > crowd:
                    alone.append(held)
                    held, full = np.empty(0, np.int64), True
                if size > 1_000_000:
                    yield from rows(left, right, [])
                    left, right, size = [], [], 0
            yield from rows(left, right, alone)
        if full:
            yield from rows([], [], [held])
        elif len(held) > 1:
            i, j = np.triu_indices(len(held), 1)
            yield from rows([held[i]], [held[j]], [])

    return run


def signatures(texts: DataFrame, bands: Bands, size: int, min_words: int) -> DataFrame:
    """(id, cls, keys, s0, s1, ...) of each text with enough words; keys and sketch are null for a copy met before."""
    id_type = texts.schema[0].dataType.simpleString()
    fields = [f"id {id_type}", "cls bigint", "keys array<bigint>", *(f"s{k} bigint" for k in range(bands.longs))]
    return texts.mapInArrow(_sign(bands, size, min_words), ", ".join(fields))


def meetings(signed: DataFrame, crowd: int = 2048) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a, b), a < b, of classes that share a band key, and the classes (cls) of crowded keys."""
    banded = signed.where("keys is not null").select("keys", "cls")
    rows = banded.select(F.explode("keys").alias("key"), "cls")
    n_keys = banded.agg(F.sum(F.size("keys").cast("bigint"))).first()[0] or 0
    n = max(int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_keys // KEYS_A_TASK))
    sampled = rows.where(F.pmod(F.xxhash64("cls"), F.lit(SAMPLE)) == 0).groupBy("key").agg(F.count_distinct("cls").alias("n")).where(F.col("n") * SAMPLE > 16 * crowd)
    hot = staged(sampled.select("key"), "crowded_keys")
    some = not hot.isEmpty()
    side = F.broadcast(hot) if some and is_small(hot, SMALL_IDS) else hot
    calm = rows.join(side, "key", "left_anti") if some else rows
    found = staged(calm.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_meet(crowd), "a bigint, b bigint"), "meetings")
    crowded = found.where("b is null").select(F.col("a").alias("cls"))
    if some:
        crowded = crowded.unionByName(rows.join(side, "key", "left_semi").select("cls"))
    return found.where("b is not null").distinct(), staged(crowded.distinct(), "crowded")


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = S.WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                sets = [S.shingle_set(S.words(t), hashes, size) for t in batch.column(1).slice(at, 500).to_pylist()]
                offsets = np.cumsum([0, *map(len, sets)])
                ids = pa.array([S.set_id(x) for x in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))], ["cls", "runs"])

    return run


def sets_of(texts: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(cls, runs): the sets, one row a class, of all texts whose id is in ``ids``."""
    wanted = ids.select("id").distinct()
    if is_small(wanted, SMALL_IDS):
        wanted = F.broadcast(wanted)
    few = texts.select("id", "text").join(wanted, "id", "left_semi")
    return few.mapInArrow(_sets(size), "cls bigint, runs array<bigint>").groupBy("cls").agg(F.first("runs").alias("runs"))


def alike_in_crowd(sets: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (a, b), a < b, that an exact prefix-filter join of the sets (cls, runs) with themselves lets through."""
    counts = sets.sparkSession.sparkContext.broadcast(prefixes.cell_counts(sets))
    rows = staged(sets.mapInArrow(prefixes.prefix_rows(counts, threshold), prefixes.PREFIX_SCHEMA), "crowd_prefixes")
    other = rows.select("run", F.col("cls").alias("b"), F.col("place").alias("place_e"), F.col("n").alias("n_e"))
    return prefixes.met(rows.withColumnRenamed("cls", "a").join(other, "run").where(F.col("a") < F.col("b")), ["a", "b"], threshold).select("a", "b")


def likeness(left: Column, right: Column) -> Column:
    """Members in both of two arrays without repeats, over members in either."""
    both = F.size(F.array_intersect(left, right))
    return both / (F.size(left) + F.size(right) - both)


@dataclass(frozen=True)
class NearDuplicates:
    """``members`` (id, cls): the class of each text; ``links`` (a, b, likeness): alike classes, a < b."""

    members: DataFrame
    links: DataFrame

    def pairs(self) -> DataFrame:
        """(id_a, id_b), id_a < id_b: every pair of texts that are alike, copies included."""
        left = self.members.select(F.col("id").alias("x"), F.col("cls").alias("a"))
        right = self.members.select(F.col("id").alias("y"), F.col("cls").alias("b"))
        across = self.links.select("a", "b").join(left, "a").join(right, "b")
        within = left.join(right, left["a"] == right["b"]).where("x < y")
        return across.select("x", "y").unionByName(within.select("x", "y")).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def near_duplicates(
    df: DataFrame,
    id_col: str,
    text_col: str,
    threshold: float = 0.8,
    size: int = 5,
    min_words: int = 0,
    recall: float = 0.99,
    crowd: int = 2048,
    slack: float | None = SLACK,
) -> NearDuplicates:
    """Texts whose sets of ``size``-word runs have a likeness of at least ``threshold``.

    Candidates come from min-max hashing (:class:`Bands`), so a pair at the threshold is found
    with probability ``recall`` and a closer one with more; what is returned is verified exactly.
    The sketch drops candidates whose estimate is ``slack`` standard deviations under the threshold;
    with ``slack=None`` all of them are verified.

    Rows with a null id or text, and texts of fewer than ``min_words`` or ``size`` words (empty
    ones among them), belong to no class. Rows that repeat an id with one text count once; rows of
    one id with several texts count with each. Other columns are ignored, whatever their names.
    An empty table gives empty results.
    """
    texts = df.select(df[id_col].alias("id"), df[text_col].alias("text")).where("id is not null and text is not null")
    bands = Bands.for_threshold(threshold, recall)
    signed = staged(signatures(spread(texts), bands, size, min_words), "signatures")
    members = signed.select("id", "cls").distinct()
    sketch = [f"s{k}" for k in range(bands.longs)]
    classes = signed.groupBy("cls").agg(F.min("id").alias("rep"), *(F.max(s).alias(s) for s in sketch))

    def side(name: str) -> DataFrame:
        return classes.select(F.col("cls").alias(name), F.col("rep").alias(f"rep_{name}"), *(F.col(s).alias(f"{name}_{s}") for s in sketch))

    n_bits = 64 * bands.longs
    met, crowded = meetings(signed, crowd)
    near = met.join(side("a"), "a").join(side("b"), "b")
    if n_bits and slack is not None:
        # Bits agree with probability (1 + likeness) / 2.
        agree = (1 + threshold) / 2
        least = n_bits * agree - slack * math.sqrt(n_bits * agree * (1 - agree))
        differing = sum((F.bit_count(F.col(f"a_{s}").bitwiseXOR(F.col(f"b_{s}"))) for s in sketch), F.lit(0))
        near = near.where(F.lit(n_bits) - differing >= least)
    near = staged(near.select("a", "b", "rep_a", "rep_b"), "candidates")
    ids = near.select(F.explode(F.array("rep_a", "rep_b")).alias("id"))
    near = near.select("a", "b")
    sets = sets_of(texts, ids, size)
    if not crowded.isEmpty():
        reps = classes.join(crowded, "cls", "left_semi").select(F.col("rep").alias("id"))
        crowd_sets = staged(sets_of(texts, reps, size).join(crowded, "cls", "left_semi"), "crowd_sets")
        near = near.unionByName(alike_in_crowd(crowd_sets, threshold)).distinct()
        sets = sets.unionByName(crowd_sets).dropDuplicates(["cls"])
    links = (
        near.join(sets.select(F.col("cls").alias("a"), F.col("runs").alias("runs_a")), "a")
        .join(sets.select(F.col("cls").alias("b"), F.col("runs").alias("runs_b")), "b")
        .select("a", "b", likeness(F.col("runs_a"), F.col("runs_b")).alias("likeness"))
        .where(F.col("likeness") >= threshold)
    )
    return NearDuplicates(members, staged(links, "links"))


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(cls, root): the smallest class reachable from each linked class.

    Alternating star steps: every node sends its smallest neighbour to the larger ones, then to the
    smaller ones, until nothing changes; a node's neighbours are only ever aggregated by minimum or
    joined, never collected. ``rounds`` bounds the steps; their number grows with the logarithm of
    the longest chain, and running out of them is an error, not a partial answer.
    """
    edges = staged(links.select(F.col("a").alias("u"), F.col("b").alias("v")), "edges")
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("v"), F.col("v").alias("u")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low2 = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low2.select("u", F.col("m").alias("v")))
        following = staged(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        same = following.exceptAll(edges).isEmpty() and edges.count() == following.count()
        edges = following
        if same:
            break
    else:
        raise RuntimeError("the groups did not settle; allow more rounds")
    roots = edges.select("v").distinct().select(F.col("v").alias("cls"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("cls"), F.col("v").alias("root")).unionByName(roots)


def with_labels(rows: DataFrame, labels: DataFrame, key: str, share: int = 2000) -> DataFrame:
    """``rows`` joined with ``labels`` (one row a key, ``n`` its number of rows), however many rows a key has.

    Keys with more than one row of ``share`` are at most ``share``, so their labels go to all tasks;
    the rows of the others are shuffled.
    """
    total = labels.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(labels.where(F.col("n") > total / share))
    columns = [c for c in rows.columns if c != key] + [c for c in labels.columns if c not in (key, "n")]
    few = rows.join(hot, key).select(key, *columns)
    rest = rows.join(hot.select(key), key, "left_anti").join(labels, key).select(key, *columns)
    return few.unionByName(rest)


def groups(found: NearDuplicates) -> DataFrame:
    """(id, group_id, n_links): one row a text; a text without likeness to another is its own group.

    ``group_id`` is the smallest id of the group, ``n_links`` the number of other classes its class is alike to.
    An id that carries texts of several classes has a row for each.
    """
    classes = found.members.groupBy("cls").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    ends = found.links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("n_links"))
    rooted = components(found.links).join(classes, "cls")
    smallest = rooted.groupBy("root").agg(F.min("low").alias("group_id"))
    linked = rooted.join(smallest, "root").join(ends, "cls").select("cls", "group_id", "n_links")
    labels = staged(classes.join(linked, "cls", "left").select("cls", "n", F.coalesce("group_id", "low").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "labels")
    return with_labels(found.members, labels, "cls").select("id", "group_id", "n_links")
