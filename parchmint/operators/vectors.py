"""Exact nearest neighbours, centroids and rank fusion over section vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchmint.sources.fetch import with_retries
from parchmint.staging import spread

#: Query vectors that are compared at once; a block is what tasks receive.
BLOCK = 2048


def as_doubles(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 minus the cosine; 1 where a vector is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, 1 - dot(a, b) / norms).otherwise(1.0)


def normalised(vector: Column) -> Column:
    """The vector at unit length; a zero vector as it is."""
    norm = F.sqrt(dot(vector, vector))
    return F.when(norm > 0, F.transform(vector, lambda x: x.cast("double") / norm)).otherwise(as_doubles(vector))


def knn(vectors: DataFrame, query: list[float], limit: int, metric: str = "l2", id_col: str = "doc_id", vector_col: str = "embedding") -> DataFrame:
    """Rows of ``vectors`` with their ``score`` (distance), the nearest ``limit``; ties by id.

    The query is a constant of the plan and the selection a ``TakeOrderedAndProject``. Vectors of
    another dimension than the query's are an error; null vectors are left out.
    """
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be from 1 to 1000")
    q = F.array(*[F.lit(float(x)) for x in query])
    distance = {"l2": l2, "cosine": cosine_distance}[metric]
    v = F.col(vector_col)
    sized = vectors.where(v.isNotNull()).withColumn(vector_col, F.when(F.size(v) == len(query), v).otherwise(F.raise_error(F.lit(f"vectors must have {len(query)} dimensions"))))
    return sized.withColumn("score", distance(v, q)).orderBy("score", id_col).limit(limit)


def _packed(size: int):
    """Rows (id, vector, group) to rows (ids, flat, groups) of up to ``size`` vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches, size):
            ids, v = table.column(0).combine_chunks(), table.column(1).combine_chunks()
            flat = v.flatten().cast(pa.float64())
            whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            yield pa.RecordBatch.from_arrays([whole(ids), whole(flat), whole(table.column(2).combine_chunks())], ["ids", "flat", "groups"])

    return run


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    held, rows = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, size - rows)
            held.append(part)
            rows, at = rows + part.num_rows, at + part.num_rows
            if rows == size:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _nearest(limit: int, metric: str, apart: bool):
    """Rows (query_ids, queries, ids, vectors, query_groups, groups), one block of each, to the nearest ``limit`` vectors of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                asked, ids = batch.column(0)[k].values, batch.column(2)[k].values
                q = batch.column(1)[k].values.to_numpy().reshape(len(asked), -1)
                v = batch.column(3)[k].values.to_numpy().reshape(len(ids), -1)
                qn, vn = (q**2).sum(1), (v**2).sum(1)
                products = q @ v.T
                if metric == "l2":
                    d = np.sqrt(np.maximum(qn[:, None] + vn[None] - 2 * products, 0))
                else:
                    norms = np.sqrt(qn)[:, None] * np.sqrt(vn)[None]
                    d = np.where(norms > 0, 1 - products / np.where(norms > 0, norms, 1), 1.0)
                if apart:
                    codes = pa.concat_arrays([batch.column(4)[k].values, batch.column(5)[k].values]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
                    d[codes[: len(asked), None] == codes[None, len(asked) :]] = np.inf
                # Ties at the edge must survive until ids decide them.
                last = min(limit, len(ids)) - 1
                edge = np.partition(d, last, axis=1)[:, last]
                at_q, at_v = np.nonzero((d <= edge[:, None] + 1e-9) & np.isfinite(d))
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(at_q)), ids.take(pa.array(at_v)), pa.array(d[at_q, at_v])], ["query_id", "id", "score"])

    return run


def knn_join(vectors: DataFrame, queries: DataFrame, limit: int, metric: str = "l2", id_col: str = "vec_id", vector_col: str = "embedding", chunk: int = 20_000, apart: str | None = None) -> DataFrame:
    """(query_id, id, score, rank): for every query row its ``limit`` nearest rows of ``vectors``, itself excepted, and those with the same value of the column ``apart``.

    Queries are packed into blocks of :data:`BLOCK` rows and vectors into chunks of ``chunk``; the plan pairs blocks
    with chunks, whatever the number of either, so a task holds one of each. Each pair keeps its best, which
    are ranked after one shuffle by query.
    """
    group = F.col(apart) if apart else F.lit(0)
    pick = lambda df: df.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), group.alias("g"))
    rows, asked = spread(pick(vectors)), pick(queries)
    kinds = lambda df: f"ids array<{df.schema[0].dataType.simpleString()}>, flat array<double>, groups array<{df.schema[2].dataType.simpleString()}>"
    blocks = asked.mapInArrow(_packed(BLOCK), kinds(asked)).withColumnsRenamed({"ids": "query_ids", "flat": "queries", "groups": "query_groups"})
    chunks = rows.mapInArrow(_packed(chunk), kinds(rows)).withColumnRenamed("flat", "vectors")
    paired = blocks.crossJoin(chunks).select("query_ids", "queries", "ids", "vectors", "query_groups", "groups")
    found = paired.mapInArrow(_nearest(limit + 1, metric, apart is not None), f"query_id {asked.schema[0].dataType.simpleString()}, id {rows.schema[0].dataType.simpleString()}, score double")
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9), "id")
    return found.where("query_id <> id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def centroids(vectors: DataFrame, key: str = "doc_id", vector_col: str = "embedding") -> DataFrame:
    """(key, centroid): the mean of a key's vectors at unit length; keys without vectors are not there.

    Sums by coordinate are partial on the map side, so a key with most of the rows is no burden.
    """
    parts = vectors.where(F.col(vector_col).isNotNull()).select(F.col(key), F.posexplode(vector_col).alias("at", "x"))
    means = parts.groupBy(key, "at").agg(F.avg(F.col("x").cast("double")).alias("m"))
    ordered = means.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "m"))).alias("s"))
    return ordered.select(key, normalised(F.col("s.m")).alias("centroid"))


def related(vectors: DataFrame, doc_id: str, limit: int = 20, metric: str = "l2") -> DataFrame:
    """The ``limit`` sections nearest to a document's centroid that are not its own."""
    own = centroids(vectors.where(F.col("doc_id") == doc_id)).first()
    if own is None:
        raise LookupError(f"{doc_id} has no vectors")
    return knn(vectors.where(F.col("doc_id") != doc_id), own["centroid"], limit, metric)


def fused(first: DataFrame, second: DataFrame, limit: int = 20, k: int = 60) -> DataFrame:
    """Two ranked lists (key, pos, ...) as one by reciprocal ranks: (key, score), smaller is better.

    Both lists are short already. A key twice in one list adds twice; ties keep the first list's
    order, then the second's.
    """
    both = first.select("key", "pos", F.lit(0).alias("list")).unionByName(second.select("key", "pos", F.lit(1).alias("list")))
    summed = both.groupBy("key").agg(F.sum(1.0 / (F.lit(k) + F.col("pos") + 1)).alias("gain"), F.min(F.struct("list", "pos")).alias("seen"))
    return summed.orderBy(F.desc(F.round("gain", 12)), "seen").limit(limit).select("key", (-F.col("gain")).alias("score"))


class HashingEmbedder:
    """Vectors of texts without a model or a network: signed word hashes at unit length. The same text always has the same vector."""

    def __init__(self, dimensions: int = 512):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> np.ndarray:
        import re
        import zlib

        out = np.zeros((len(texts), self.dimensions), np.float32)
        for row, text in enumerate(texts):
            for w in re.findall(r"[^\W_]+", text.lower()):
                h = zlib.crc32(w.encode())
                out[row, h % self.dimensions] += 1 if h >> 31 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms > 0, norms, 1)


def embedded(rows: DataFrame, text: Column, embedder, batch: int = 100, tries: int = 4, dimensions: int | None = None) -> DataFrame:
    """``rows`` with ``embedding``, by an object whose ``embed`` takes a list of texts; in batches of ``batch`` texts, each tried again if it fails.

    Vectors of another length than ``dimensions`` (null: any) are an error.
    """
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                texts = [t or " " for t in part.column(len(names)).to_pylist()]
                v = np.asarray(with_retries(lambda texts=texts: embedder.embed(texts), tries), np.float32)
                if v.ndim != 2 or len(v) != len(texts) or dimensions not in (None, v.shape[1]):
                    raise ValueError(f"vectors of shape {v.shape} for {len(texts)} texts")
                offsets = pa.array(np.arange(0, v.size + 1, v.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(v.ravel()))], [*names, "embedding"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.withColumn("_text", text).mapInArrow(run, f"{fields}, embedding array<float>")


def local_vector(spark: SparkSession, text: str, embedder) -> list[float]:
    """A query's vector."""
    return [float(x) for x in np.asarray(embedder.embed([text or " "]))[0]]
