"""Texts of evaluation splits that occur, exactly or almost, in the training split.

An exact prefix-filter join. Word runs are put in one global order, rare ones first; two sets whose
likeness reaches the threshold share a run among the first few of each (their prefixes). Prefixes
of the evaluation side are indexed, those of the training side probe them, the lengths and the
positions of the shared run bound the overlap that is still possible, and what passes is verified.

Only runs of the evaluation side can be shared, so rarity is theirs: it is counted over all rows of
that side, the small one, and sent to the workers as an array of cells of a fixed bound
(:mod:`parchmint.llm.prefixes`). A run of the training side whose cell is empty is rarer than any
and meets nobody: it takes a place in the prefix and is not sent anywhere. So the training side, which
may be any size, is read once, and nothing of it is shuffled but the few runs that may meet.
The texts of candidates alone are read again to verify them.

Copies are collapsed into classes first, so a text that fills a third of a side is one class.

An index that is too large to be sent to all tasks meets the prefixes in a shuffle by hash. What is shuffled are the
members of many rows at once, sorted and packed into some ten bytes each (a row of its own takes
several times that), and a class that several tasks met is sent by one of them only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.llm import prefixes
from parchmint.llm import shingles as S
from parchmint.llm.near_dup import SMALL_IDS, likeness, sets_of
from parchmint.staging import SMALL_BYTES, is_small, spread, staged

#: Up to so many members of the evaluation side's prefixes are sent to all tasks, if they are no longer than 64 MB.
SMALL_INDEX = 2_000_000
#: Members of a bucket, those of both sides: what a task of the shuffle holds at once.
BUCKET = 500_000
#: So many members two sets must share within prefixes that are as much longer: more pairs of members are shuffled, but few pairs of sets remain.
SHARED = 8


def _sets(batches: Iterator[pa.RecordBatch], size: int, min_words: int) -> Iterator[tuple[pa.RecordBatch, list[int], list[int], list]]:
    """Slices of the rows, which of them have enough words, their classes, and their runs (none for a copy within the task)."""
    hashes, done = S.WordHashes(), set()
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            kept, ids, sets = [], [], []
            for row, text in enumerate(part.column(1).to_pylist()):
                tokens = S.words(text)
                if len(tokens) < max(min_words, size):
                    continue
                runs = S.shingle_set(tokens, hashes, size)
                kept.append(row)
                ids.append(own := S.set_id(runs))
                sets.append(None if own in done else runs.view(np.int64))
                if sets[-1] is not None:
                    if len(done) > 1_000_000:
                        done.clear()
                    done.add(own)
            if kept:
                yield part, kept, ids, sets


def _lists(sets: list, none: np.ndarray, kind) -> pa.ListArray:
    offsets = np.cumsum([0, *(0 if x is None else len(x) for x in sets)])
    whole = [x for x in sets if x is not None]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(whole) if whole else np.empty(0, kind)), mask=pa.array(none))


def _keys(seen: int, none: np.ndarray) -> pa.Array:
    """A number over all tasks for each set that is not none: the task's above that of the set in the task, ``seen`` before."""
    return pa.array((TaskContext.get().partitionId() << 32) + seen + np.cumsum(~none) - 1, pa.int64(), mask=none)


def _held(size: int, min_words: int):
    """Evaluation rows to (id, cls, key, runs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for part, kept, ids, sets in _sets(batches, size, min_words):
            none = np.array([x is None for x in sets], bool)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(kept, pa.int64())), pa.array(ids, pa.int64()), _keys(seen, none), _lists(sets, none, np.int64)], ["id", "cls", "key", "runs"])
            seen += int((~none).sum())

    return run


def _probe(counts, threshold: float, size: int, min_words: int):
    """Training rows to (id, cls, key, n, runs, places): the members of the prefix that the evaluation side may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, seen = counts.value, 0
        bits = len(cells).bit_length() - 1
        for part, kept, ids, sets in _sets(batches, size, min_words):
            none = np.array([x is None for x in sets], bool)
            runs, places = [], []
            for x in sets:
                if x is None:
                    runs.append(None), places.append(None)
                    continue
                first = prefixes.prefix(x, cells, threshold)
                some = np.flatnonzero(cells[prefixes.cell_of(first, bits)])
                runs.append(first[some]), places.append(some.astype(np.int32))
            n = pa.array([0 if x is None else len(x) for x in sets], pa.int32())
            columns = [part.column(0).take(pa.array(kept, pa.int64())), pa.array(ids, pa.int64()), _keys(seen, none), n, _lists(runs, none, np.int64), _lists(places, none, np.int32)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "cls", "key", "n", "runs", "places"])
            seen += int((~none).sum())

    return run


def _packed(columns: list[np.ndarray]) -> bytes:
    """Columns of numbers not below 0, each as a byte of its width and then its bytes of equal weight side by side."""
    out = []
    for x in columns:
        width = max(1, -(-int(x.max()).bit_length() // 8))
        out += [bytes([width]), x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()]
    return b"".join(out)


def _unpacked(data: bytes, rows: int, columns: int) -> list[np.ndarray]:
    """What :func:`_packed` packed."""
    out, at = [], 0
    for _ in range(columns):
        width = data[at]
        x = np.zeros((rows, 8), np.uint8)
        x[:, :width] = np.frombuffer(data, np.uint8, width * rows, at + 1).reshape(width, rows).T
        out.append(x.reshape(-1).view("<u8"))
        at += 1 + width * rows
    return out


def _repeated(keyed: DataFrame) -> dict[int, np.ndarray]:
    """By task, a bit for each of its sets (cls, key), packed: whether another set of the class is sent instead."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = []
            for numbers in batch.column(1):
                x = numbers.values.to_numpy()
                mark = np.zeros(int(x.max()) + 1, np.uint8)
                mark[x] = 1
                marks.append(np.packbits(mark).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.binary())], ["task", "marks"])

    several = keyed.groupBy("cls").agg(F.min("key").alias("least"), F.collect_list("key").alias("keys")).where(F.size("keys") > 1)
    others = several.select("least", F.explode("keys").alias("key")).where(F.col("key") != F.col("least"))
    by_task = others.groupBy(F.shiftright("key", 32).cast("int").alias("task")).agg(F.collect_list(F.col("key").bitwiseAND(F.lit(2**32 - 1))).alias("numbers"))
    return {r["task"]: np.frombuffer(bytes(r["marks"]), np.uint8) for r in by_task.mapInArrow(bits, "task int, marks binary").collect()}  # a bit a set


def _buckets(side: int, bits: int, repeated, counts=None, threshold: float = 0.0):
    """Rows (key, n, runs, places), or (key, runs) whose prefixes are taken, to rows (bucket, side, first, size, members) of many rows' members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy()
            sent = np.ones(len(key), bool)
            for task in np.unique(key >> 32).tolist():
                if task in repeated.value:
                    marks = np.unpackbits(repeated.value[task])
                    own = np.flatnonzero(key >> 32 == task)
                    number = key[own] & (2**32 - 1)
                    sent[own] = (number >= len(marks)) | (marks[np.minimum(number, len(marks) - 1)] == 0)
            rows = np.flatnonzero(sent)
            if not len(rows):
                continue
            batch, key = batch.take(pa.array(rows)), key[rows]
            listed = batch.column("runs")
            sizes = np.diff(listed.offsets.to_numpy())
            if counts is None:
                runs, places, n = listed.flatten().to_numpy(), batch.column("places").flatten().to_numpy(), batch.column("n").to_numpy()
            else:
                n = sizes
                firsts = [prefixes.prefix(x.values.to_numpy(), counts.value, threshold) for x in listed]
                sizes = np.array([len(x) for x in firsts])
                runs, places = np.concatenate(firsts), np.concatenate([np.arange(k) for k in sizes])
            runs, row = runs.view(np.uint64), np.repeat(np.arange(len(key)), sizes)
            order = np.argsort(runs, kind="stable")
            runs, row, places = runs[order], row[order], places[order]
            bucket = (runs >> np.uint64(64 - bits)).astype(np.int64)
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(runs) else np.empty(0, np.int64)
            ends, out = np.r_[starts[1:], len(runs)], []
            first = int(key.min())
            for s, e in zip(starts.tolist(), ends.tolist()):
                low = np.uint64(int(bucket[s]) << (64 - bits))
                out.append(_packed([np.diff(runs[s:e], prepend=low), key[row[s:e]] - first, n[row[s:e]], places[s:e]]))
            columns = [pa.array(bucket[starts].astype(np.int32)), *(pa.array(np.full(len(starts), x), kind) for x, kind in ((side, pa.int32()), (first, pa.int64()))), pa.array((ends - starts).astype(np.int32)) if len(starts) else pa.array([], pa.int32()), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "side", "first", "size", "members"])

    return run


_BUCKETS = "bucket int, side int, first bigint, size int, members binary"


def _pairs(bits: int, threshold: float, spread_bits: int):
    """Rows of :func:`_buckets` in the order of buckets to rows (bucket, first, first_e, size, pairs): many pairs of keys, one for each
    member that they share within their prefixes, with the number of members they must share there.

    For two sets of n and m members that must share s, the prefixes that count are the first ``n - s + SHARED`` and ``m - s + SHARED``,
    but no more than those of any partner. What is not shared there is beyond the prefix that ends first in the order.
    """

    def told(sides: list[list]) -> Iterator[tuple[np.ndarray, ...]]:
        if not (sides[0] and sides[1]):
            return
        (run, a, n, place), (run_e, b, n_e, place_e) = ([np.concatenate(x) for x in zip(*parts)] for parts in sides)
        order = np.argsort(run_e, kind="stable")
        run_e, b, n_e, place_e = run_e[order], b[order], n_e[order], place_e[order]
        low, high = np.searchsorted(run_e, run, "left"), np.searchsorted(run_e, run, "right")
        some = np.flatnonzero(high > low)
        low, many = low[some], (high - low)[some]
        ends = np.cumsum(many)
        at = 0
        while at < len(some):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 500_000, "right")))
            each = many[at:to]
            x = np.repeat(some[at:to], each)
            y = np.arange(len(x)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(low[at:to], each)
            at = to
            k, m = n[x], n_e[y]
            needed = np.ceil(threshold / (1 + threshold) * (k + m) - 1e-9).astype(np.int32)
            beyond, beyond_e = (np.maximum(np.ceil(threshold * size - 1e-9).astype(np.int32) - 1, needed - SHARED) for size in (k, m))
            fits = (place[x] < k - beyond) & (place_e[y] < m - beyond_e) & (np.minimum(k, m) >= threshold * np.maximum(k, m) - 1e-9)
            yield a[x[fits]], b[y[fits]], (needed - np.maximum(beyond, beyond_e))[fits]

    def batch_of(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        a, b, least = (np.concatenate(x) for x in zip(*held))
        bucket = _pair_bucket(a, spread_bits)
        order = np.lexsort((a, bucket))
        a, b, least, bucket = a[order], b[order], least[order], bucket[order]
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        ends = np.r_[starts[1:], len(a)]
        first_e = int(b.min())
        out = [_packed([np.diff(a[s:e], prepend=a[s]), b[s:e] - first_e, least[s:e]]) for s, e in zip(starts.tolist(), ends.tolist())]
        return pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int32)), pa.array(a[starts]), pa.array(np.full(len(starts), first_e)), pa.array((ends - starts).astype(np.int32)), pa.array(out, pa.binary())], ["bucket", "first", "first_e", "size", "pairs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides, held, size_held = -1, [[], []], [], 0
        for batch in _and_end(batches):
            rows = [(-2, 0, 0, 0, b"")] if batch is None else zip(*(batch.column(k).to_pylist() for k in range(5)))
            for bucket, side, first, size, members in rows:
                if bucket != now:
                    for found in told(sides):
                        if len(found[0]):
                            held.append(found)
                            size_held += len(found[0])
                        if size_held > 1_000_000:
                            yield batch_of(held)
                            held, size_held = [], 0
                    now, sides = bucket, [[], []]
                if size:
                    step, number, n, place = _unpacked(members, size, 4)
                    runs = np.cumsum(step, dtype=np.uint64) + np.uint64(bucket << (64 - bits))
                    sides[side].append((runs, number.astype(np.int64) + first, n.astype(np.int32), place.astype(np.int32)))
        if held:
            yield batch_of(held)

    return run


_PAIRS = "bucket int, first bigint, first_e bigint, size int, pairs binary"


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _pair_bucket(a: np.ndarray, bits: int) -> np.ndarray:
    return (S.mixed(a.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of :func:`_pairs` in the order of buckets to the pairs (a, b) that share as many members as they must."""
    now, held = -1, []
    for batch in _and_end(batches):
        rows = [(-2, 0, 0, 0, b"")] if batch is None else zip(*(batch.column(k).to_pylist() for k in range(5)))
        for bucket, first, first_e, size, pairs in rows:
            if bucket != now:
                if held:
                    a, b, least = (np.concatenate(x) for x in zip(*held))
                    order = np.lexsort((b, a))
                    a, b, least = a[order], b[order], least[order]
                    starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                    kept = starts[np.diff(np.r_[starts, len(a)]) >= least[starts]]
                    yield pa.RecordBatch.from_arrays([pa.array(a[kept]), pa.array(b[kept])], ["a", "b"])
                now, held = bucket, []
            if size:
                step, number, least = _unpacked(pairs, size, 3)
                held.append((np.cumsum(step).astype(np.int64) + first, number.astype(np.int64) + first_e, least.astype(np.int32)))


def _met_by_bucket(probes: DataFrame, held: DataFrame, counts, n_index: int, threshold: float) -> DataFrame:
    """(train_cls, eval_cls, id) of the classes that may be alike, however large both sides are."""
    spark = probes.sparkSession
    own = probes.where(F.size("runs") > 0)
    total = n_index + (own.agg(F.sum(F.size("runs").cast("bigint"))).first()[0] or 0)
    bits = min(20, max(6, int(np.ceil(np.log2(total / BUCKET + 1)))))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (1 << bits) // 4)
    repeated_t, repeated_e = (spark.sparkContext.broadcast(_repeated(x.where("key is not null").select("cls", "key"))) for x in (own, held))
    left = own.select("key", "n", "runs", "places").mapInArrow(_buckets(0, bits, repeated_t), _BUCKETS)
    right = held.where("key is not null").select("key", "runs").mapInArrow(_buckets(1, bits, repeated_e, counts, threshold), _BUCKETS)
    rows = left.unionByName(right).repartition(tasks, "bucket").sortWithinPartitions("bucket")
    pairs = rows.mapInArrow(_pairs(bits, threshold, bits + 2), _PAIRS).repartition(tasks, "bucket").sortWithinPartitions("bucket")
    met = staged(pairs.mapInArrow(_counted, "a bigint, b bigint"), "met_keys")
    few = F.broadcast(met) if is_small(met, SMALL_IDS) else met
    known = own.select(F.col("key").alias("a"), "id", F.col("cls").alias("train_cls")).join(few, "a")
    return known.join(held.where("key is not null").select(F.col("key").alias("b"), F.col("cls").alias("eval_cls")), "b").select("train_cls", "eval_cls", "id")


@dataclass(frozen=True)
class Overlap:
    """``members`` (id, side, cls) of both sides; ``links`` (train_cls, eval_cls, likeness), equal classes included."""

    members: DataFrame
    links: DataFrame

    def pairs(self) -> DataFrame:
        """(train_id, eval_id, likeness): every pair of rows, copies included."""
        train = self.members.where("side = 't'").select(F.col("id").alias("train_id"), F.col("cls").alias("train_cls"))
        held = self.members.where("side = 'e'").select(F.col("id").alias("eval_id"), F.col("cls").alias("eval_cls"))
        return self.links.join(train, "train_cls").join(held, "eval_cls").select("train_id", "eval_id", "likeness")


def split_overlap(
    train: DataFrame,
    evaluation: DataFrame,
    id_col: str,
    text_col: str,
    threshold: float = 0.8,
    size: int = 5,
    min_words: int = 0,
) -> Overlap:
    """Pairs of a training and an evaluation row whose sets of ``size``-word runs are alike by ``threshold`` or more.

    Exact: every such pair is found. Rows with a null id or text, and texts of fewer than
    ``min_words`` or ``size`` words, are in no pair. A repeated row counts once; an id with several
    texts counts with each. Other columns are ignored; an empty side gives an empty result.
    """
    spark = train.sparkSession
    texts, held = (spread(df.select(df[id_col].alias("id"), df[text_col].alias("text")).where("id is not null and text is not null")) for df in (train, evaluation))
    id_type = texts.schema["id"].dataType.simpleString()
    held_type = held.schema["id"].dataType.simpleString()
    held = staged(held.mapInArrow(_held(size, min_words), f"id {held_type}, cls bigint, key bigint, runs array<bigint>"), "held")
    held_sets = held.where("runs is not null").select("cls", "runs")
    counts = spark.sparkContext.broadcast(prefixes.cell_counts(held_sets))
    probes = staged(texts.mapInArrow(_probe(counts, threshold, size, min_words), f"id {id_type}, cls bigint, key bigint, n int, runs array<bigint>, places array<int>"), "probes")
    members = held.select("id", F.lit("e").alias("side"), "cls").distinct().unionByName(probes.select("id", F.lit("t").alias("side"), "cls").distinct())

    length = F.size("runs")
    n_index = held_sets.agg(F.sum((length - F.ceil(F.lit(threshold) * length - 1e-9) + 1).cast("bigint"))).first()[0] or 0
    if n_index <= SMALL_INDEX and 40 * n_index <= SMALL_BYTES:
        # Every task has the index: the members of one training row meet in order, and only candidates leave the task.
        # A class that several tasks met is counted several times; that lets more through, never less.
        index = held_sets.mapInArrow(prefixes.prefix_rows(counts, threshold), prefixes.PREFIX_SCHEMA)
        index = staged(index.select("run", F.col("cls").alias("eval_cls"), F.col("place").alias("place_e"), F.col("n").alias("n_e")), "index")
        sent = probes.where(F.size("runs") > 0).select("id", F.col("cls").alias("train_cls"), "n", F.inline(F.arrays_zip("runs", "places"))).withColumnsRenamed({"runs": "run", "places": "place"})
        rows = sent.join(F.broadcast(index), "run").select("id", "train_cls", "eval_cls", "place", "n", "place_e", "n_e")
        met = rows.mapInArrow(prefixes.met_in_order(threshold), f"id {id_type}, a bigint, b bigint").groupBy(F.col("a").alias("train_cls"), F.col("b").alias("eval_cls")).agg(F.min("id").alias("id"))
    else:
        met = _met_by_bucket(probes, held, counts, n_index, threshold)
    met = staged(met, "met")
    met_sets = sets_of(texts, met, size).withColumnsRenamed({"cls": "train_cls", "runs": "runs_t"})
    some = met.select(F.col("eval_cls").alias("cls")).distinct()
    some = F.broadcast(some) if is_small(some, SMALL_IDS) else some
    eval_sets = held_sets.join(some, "cls", "left_semi").dropDuplicates(["cls"]).withColumnsRenamed({"cls": "eval_cls", "runs": "runs_e"})
    links = met.join(met_sets, "train_cls").join(eval_sets, "eval_cls").select("train_cls", "eval_cls", likeness(F.col("runs_t"), F.col("runs_e")).alias("likeness"))
    return Overlap(members, staged(links.where(F.col("likeness") >= threshold), "overlap"))


def report(overlap: Overlap, evaluation: DataFrame, id_col: str, split_col: str, source_col: str) -> DataFrame:
    """(split, source, n_rows, n_overlapping, n_pairs) of the evaluation rows; null split and source are groups of their own."""
    rows = evaluation.select(evaluation[id_col].alias("eval_id"), evaluation[split_col].alias("split"), evaluation[source_col].alias("source")).where("eval_id is not null").distinct()
    pairs = overlap.pairs().groupBy("eval_id").agg(F.count("*").alias("pairs"))
    joined = rows.join(pairs, "eval_id", "left")
    return joined.groupBy("split", "source").agg(
        F.count("*").alias("n_rows"), F.count("pairs").alias("n_overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).cast("bigint").alias("n_pairs")
    )
