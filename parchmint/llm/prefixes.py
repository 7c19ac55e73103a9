"""Prefixes of sets in one global order, the rare members first: the filter of an exact similarity join.

Two sets whose likeness reaches a threshold share a member among the first few of each, whatever the
order, as long as it is one order. Rarity is read from an array of cells: members that fall into
one cell share a count, which may cost candidates but never a pair. The array is sized by the number of
members counted, up to 2**24 cells of one byte, so what is sent to the workers has a fixed bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The most cells, as a power of two: 16 MB in each worker. They tell some hundred million members apart.
MOST_BITS = 24


def cell_of(runs: np.ndarray, bits: int) -> np.ndarray:
    """The cell of each member: its first bits."""
    return (runs.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def cell_counts(sets: DataFrame, most_bits: int = MOST_BITS) -> np.ndarray:
    """How many members of the column ``runs`` fall into each cell, 255 at most; a power of two of cells, four for each member."""
    total = sets.agg(F.sum(F.size("runs").cast("bigint"))).first()[0] or 0
    bits = int(min(max(16, np.ceil(np.log2(4 * total + 1))), most_bits))
    cell = F.shiftrightunsigned("run", 64 - bits)
    held = sets.select(F.explode("runs").alias("run")).groupBy(cell.cast("int").alias("cell")).agg(F.least(F.count("*"), F.lit(255)).cast("smallint").alias("n")).toArrow()
    counts = np.zeros(1 << bits, np.uint8)
    counts[held["cell"].to_numpy()] = held["n"].to_numpy()
    return counts


def prefix(runs: np.ndarray, counts: np.ndarray, threshold: float) -> np.ndarray:
    """The members, rare first, of which two alike sets must share one."""
    bits = len(counts).bit_length() - 1
    order = np.lexsort((runs, counts[cell_of(runs, bits)]))
    n = len(runs)
    return runs[order[: n - int(np.ceil(threshold * n - 1e-9)) + 1]]


def prefix_rows(counts, threshold: float):
    """Rows (cls, runs) to rows (run, cls, place, n) of the prefixes; ``counts`` is a broadcast array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                runs, classes, places, sizes = [], [], [], []
                for cls, held in zip(part.column(0).to_pylist(), part.column(1)):
                    x = held.values.to_numpy()
                    first = prefix(x, counts.value, threshold)
                    runs.append(first)
                    classes.append(np.full(len(first), cls, np.int64))
                    places.append(np.arange(len(first), dtype=np.int32))
                    sizes.append(np.full(len(first), len(x), np.int32))
                if runs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (runs, classes, places, sizes)], ["run", "cls", "place", "n"])

    return run


PREFIX_SCHEMA = "run bigint, cls bigint, place int, n int"


def _needed(threshold: float) -> Column:
    """How many members sets of sizes ``n`` and ``n_e`` must share."""
    return F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("n") + F.col("n_e")) - 1e-9)


def may_reach(threshold: float) -> Column:
    """Whether the sizes ``n`` and ``n_e`` allow the threshold."""
    n, m = F.col("n"), F.col("n_e")
    return F.least(n, m) >= F.lit(threshold) * F.greatest(n, m) - 1e-9


def met(shared: DataFrame, keys: list[str], threshold: float, *more: Column) -> DataFrame:
    """Rows of shared prefix members (keys, place, n, place_e, n_e) to the pairs ``keys`` that may reach the threshold.

    All that two sets share up to the end of the prefix that ends first in the order is counted.
    Whatever else they share lies beyond that prefix in one and beyond the last shared member in the other.
    """
    pairs = shared.where(may_reach(threshold)).groupBy(*keys).agg(F.count("*").alias("k"), F.max("place").alias("last"), F.max("place_e").alias("last_e"), F.first("n").alias("n"), F.first("n_e").alias("n_e"), *more)
    beyond = lambda size: F.ceil(F.lit(threshold) * size - 1e-9) - 1
    n, m = F.col("n"), F.col("n_e")
    rest = F.greatest(F.least(beyond(n), m - F.col("last_e") - 1), F.least(beyond(m), n - F.col("last") - 1))
    return pairs.where(F.col("k") + rest >= _needed(threshold))


def met_in_order(threshold: float):
    """What :func:`met` tells, for rows (id, a, b, place, n, place_e, n_e) in which those of one ``a`` follow each other: to (id, a, b), in the task, without a shuffle."""

    def told(rows: pa.Table) -> pa.RecordBatch:
        a, b, place, n, place_e, n_e = (rows.column(k).to_numpy() for k in range(1, 7))
        order = np.lexsort((b, a))
        starts = np.flatnonzero(np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]) if len(a) else np.empty(0, np.int64)
        first = order[starts]
        if not len(first):
            return pa.RecordBatch.from_arrays([rows.column(k).combine_chunks() for k in range(3)], ["id", "a", "b"])
        k = np.diff(np.r_[starts, len(a)])
        last, last_e = (np.maximum.reduceat(x[order], starts).astype(np.int64) for x in (place, place_e))
        n, m = n[first].astype(np.int64), n_e[first].astype(np.int64)
        beyond = lambda size: np.ceil(threshold * size - 1e-9).astype(np.int64) - 1
        rest = np.maximum(np.minimum(beyond(n), m - last_e - 1), np.minimum(beyond(m), n - last - 1))
        needed = np.ceil(threshold / (1 + threshold) * (n + m) - 1e-9)
        kept = first[(k + rest >= needed) & (np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9)]
        return pa.RecordBatch.from_arrays([rows.column(c).combine_chunks().take(pa.array(kept)) for c in range(3)], ["id", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            a = batch.column(1).to_numpy()
            cut = int(np.flatnonzero(np.r_[True, a[1:] != a[:-1]])[-1])
            if cut or held and held[-1].column(1)[-1].as_py() != int(a[0]):
                yield told(pa.Table.from_batches([*held, batch.slice(0, cut)] if cut else held))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield told(pa.Table.from_batches(held))

    return run
