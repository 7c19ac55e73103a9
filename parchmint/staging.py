"""Intermediate tables that survive the loss of executors.

A staged table is written to the folder the cluster shares (``spark.checkpoint.dir``) and read
again, which cuts the lineage and lets several consumers use one computation. Only where that
setting is absent, as in tests on one machine, a folder of this process is used, and removed at its end.

What a session staged is deleted when its process ends, or earlier by :class:`scratch`, for a caller
that has consumed the results.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; set for the session where the cluster names none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("a cluster must name its shared folder in spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if app not in _own:
        path = tempfile.mkdtemp(prefix="parchmint-")
        _own[app] = f"file://{path}"
        spark.sparkContext.setCheckpointDir(_own[app])
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for ``name`` in the shared folder."""
    path = f"{shared_dir(spark)}/parchmint/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def file_system(spark: SparkSession, path: str):
    """A path as the file systems' library has it, and its file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of its file system, which a path without one has from the cluster's settings."""
    target, files = file_system(spark, path)
    return files.makeQualified(target).toString()


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables or files."""
    for path in paths:
        target, files = file_system(spark, path)
        files.delete(target, True)
    left = set(paths)
    app = spark.sparkContext.applicationId
    _made[app] = [p for p in _made.get(app, []) if p not in left]


class scratch:
    """A context whose staged tables are deleted at its end: for callers that consume their results inside."""

    def __init__(self, spark: SparkSession):
        self.spark, self.app = spark, spark.sparkContext.applicationId

    def __enter__(self) -> scratch:
        self.before = set(_made.get(self.app, []))
        return self

    def __exit__(self, *_) -> None:
        removed(self.spark, [p for p in _made.get(self.app, []) if p not in self.before])


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a file of the shared folder, whatever file system that is on."""
    target, files = file_system(spark, path)
    out = files.create(target)
    try:
        for at in range(0, len(data), 1 << 20):
            out.write(bytearray(data[at : at + (1 << 20)]))
    finally:
        out.close()


def staged(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and return a DataFrame that reads it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What is sent to all tasks is no larger than this.
SMALL_BYTES = 64 * 2**20


def is_small(df: DataFrame, rows: int, most_bytes: int = SMALL_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows and ``most_bytes`` bytes, strings at their length; reads no further than one row beyond.

    ``df`` is evaluated for it, so it should be staged.
    """
    size = F.lit(8)
    for f in df.schema.fields:
        size = size + (F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) + 16 if f.dataType.simpleString() == "string" else F.lit(8))
    row = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    return row["n"] <= rows and row["b"] <= most_bytes


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores.

    A small file is one task's work however many cores wait; a table of many files stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
