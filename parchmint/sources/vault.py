"""Vault folders of markdown files."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.functions import hashing
from parchmint.functions.frontmatter import parser
from parchmint.staging import file_system, staged


def read_files(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """(path, modified_at, text) of the files below a folder; temporary and swap files are not documents."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder, wholetext=True)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified_at"), F.col("value").alias("text"))
    name = F.substring_index("path", "/", -1)
    return rows.where(~name.startswith(".tmp-") & ~name.startswith(".") & ~name.endswith("~"))


def read_vault(spark: SparkSession, folder: str, strict: bool = True) -> DataFrame:
    """Documents with bodies; strict, files without readable metadata are left out.

    Their reasons are what :func:`broken_files` gives. A body's hash is the stored one, else computed, else the file's hash.
    """
    parsed = read_files(spark, folder).select("path", parser(strict)("text").alias("d"))
    return parsed.where("d.error is null").select(*document_columns())


def document_columns() -> list[Column]:
    """The columns of a document from ``path`` and the struct ``d`` of a parsed file."""
    hashed = F.coalesce(F.col("d.body_hash"), hashing.body_hash(F.col("d.body")), F.col("d.content_hash")).alias("body_hash")
    return [F.col("d.id").alias("id"), F.col("path"), *[F.col(f"d.{c}").alias(c) for c in ("title", "source", "content_type", "captured_at", "updated_at", "tags", "extra", "content_hash")], hashed, F.col("d.body").alias("body")]


def broken_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, error) of the files that strict reading leaves out."""
    return read_files(spark, folder).select("path", parser(True)("text").alias("d")).where("d.error is not null").select("path", F.col("d.error").alias("error"))


def snapshot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind, path) between two listings (path, modified_at): what a file stream cannot tell, deletions, included.

    A file that moved is deleted under its old path and created under the new one.
    """
    a, b = before.select("path", F.col("modified_at").alias("was")), after.select("path", F.col("modified_at").alias("now"))
    met = a.join(b, "path", "full_outer")
    kind = F.when(F.col("was").isNull(), "created").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "updated")
    return met.select(kind.alias("kind"), "path").where("kind is not null")


def pending(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files that an import's ledger (path) does not have yet."""
    return files.join(ledger.select("path").distinct(), "path", "left_anti")


def migrate(spark: SparkSession, folder: str, ledger_path: str, write) -> DataFrame:
    """Import the files of a vault folder that the ledger does not have, and record them: (n_files, n_written, n_broken, n_skipped, files_per_second).

    ``write`` takes documents with bodies. Only when it has returned does the ledger, a table (path, error), get the
    paths, so an import that ends early goes on where it stopped; broken files are recorded with their error.
    """
    began = time.monotonic()
    target, files = file_system(spark, ledger_path)
    ledger = spark.read.parquet(ledger_path) if files.exists(target) else spark.createDataFrame([], "path string, error string")
    every = read_files(spark, folder)
    fresh = staged(pending(every, ledger).select("path", parser(True)("text").alias("d")), "fresh")
    good = fresh.where("d.error is null").select(*document_columns())
    write(good)
    fresh.select("path", F.col("d.error").alias("error")).write.mode("append").parquet(ledger_path)
    counts = fresh.agg(F.count("*").alias("n"), F.count("d.error").alias("broken")).first()
    n, broken, total = counts["n"], counts["broken"], every.count()
    return spark.createDataFrame([(n, n - broken, broken, total - n, progress_rate(n, time.monotonic() - began))], "n_files long, n_written long, n_broken long, n_skipped long, files_per_second double")


def progress_rate(n: int, seconds: float) -> float:
    """Items a second."""
    return n / seconds if seconds > 0 else 0.0


def write_files(docs: DataFrame, folder: str) -> DataFrame:
    """One markdown file a document at its ``path`` below ``folder``, from (path, text): (path, n_bytes, error).

    For export to a folder that all workers see. A file is written beside its place and renamed, so readers never see half of one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = os.path.abspath(folder)
        for batch in batches:
            out = []
            for path, text in zip(*(batch.column(k).to_pylist() for k in range(2))):
                try:
                    place = os.path.abspath(os.path.join(root, path))
                    if not place.startswith(root + os.sep):
                        raise ValueError("outside the folder")
                    os.makedirs(os.path.dirname(place), exist_ok=True)
                    data = (text or "").encode()
                    half = os.path.join(os.path.dirname(place), f".tmp-{uuid.uuid4().hex}")
                    with open(half, "wb") as f:
                        f.write(data)
                    os.replace(half, place)
                    out.append((path, len(data), None))
                except (OSError, ValueError, TypeError) as error:  # told, so that the other files are written
                    out.append((path, None, str(error)))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.string())], ["path", "n_bytes", "error"])

    return docs.select("path", "text").mapInArrow(run, "path string, n_bytes bigint, error string")


def write_markdown(captures: DataFrame, path: str) -> None:
    """Captures (columns of a capture) as one text file each line-separated row: whole documents in the ``text`` column, as Parquet-free text.

    One row becomes one record of the text sink.
    """
    from parchmint.functions.frontmatter import rendered

    columns = ["title", "url", "content_type", "captured_at", "tags", "author", "sender_email", "content_markdown"]
    captures.select(rendered(*[F.col(c) for c in columns]).alias("value")).write.option("lineSep", "\0").text(path)
