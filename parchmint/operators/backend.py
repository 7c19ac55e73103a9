"""Where captures go: a vault's tables or a service, chosen by configuration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.operators import documents
from parchmint.schemas import BODIES
from parchmint.sources.fetch import with_retries
from parchmint.staging import file_system


class Backend(Protocol):
    """Takes writes (seq, body, title, source, content_type, captured_at, tags, extra) and returns what became of them (kind, id, path)."""

    def write(self, writes: DataFrame) -> DataFrame: ...


@dataclass
class TableBackend:
    """A vault as tables in a folder: each write makes the next snapshot and appends to the change log."""

    spark: SparkSession
    path: str

    def _current(self) -> tuple[int, DataFrame]:
        target, files = file_system(self.spark, f"{self.path}/docs")
        numbers = [int(s.getPath().getName()) for s in files.listStatus(target) if s.getPath().getName().isdigit()] if files.exists(target) else []
        # A snapshot counts once it is complete.
        done = [n for n in numbers if files.exists(file_system(self.spark, f"{self.path}/docs/{n}/_SUCCESS")[0])]
        if not done:
            return 0, self.spark.createDataFrame([], BODIES)
        return max(done), self.spark.read.schema(BODIES).parquet(f"{self.path}/docs/{max(done)}")

    def docs(self) -> DataFrame:
        return self._current()[1]

    def changes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/changes")

    def write(self, writes: DataFrame, now: Column | None = None) -> DataFrame:
        number, docs = self._current()
        done = documents.create(docs, writes, F.current_timestamp() if now is None else now)
        done.docs.write.mode("overwrite").parquet(f"{self.path}/docs/{number + 1}")
        done.changes.write.mode("append").parquet(f"{self.path}/changes")
        return done.changes.select("kind", "id", "path")


class Client(Protocol):
    """A service that takes one document and answers (kind, id, path)."""

    def put(self, document: dict) -> tuple[str, str, str | None]: ...


@dataclass
class ServiceBackend:
    """A service behind a client object that is sent to the workers; failures are rows of kind "failed"."""

    client: Client
    tries: int = 3

    def write(self, writes: DataFrame) -> DataFrame:
        client, tries = self.client, self.tries

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    try:
                        out.append(with_retries(lambda row=row: client.put(row), tries))
                    except Exception as error:  # told, not raised: the other rows go on
                        out.append(("failed", None, str(error)[:2000]))
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.string()) for k in range(3)], ["kind", "id", "path"])

        return writes.mapInArrow(run, "kind string, id string, path string")


def backend_of(spark: SparkSession, settings: dict[str, str], client: Client | None = None) -> Backend:
    """The backend that settings name: BACKEND is "table" (with VAULT_PATH) or "service" (with a client)."""
    kind = settings.get("BACKEND", "table").strip().lower()
    if kind == "table":
        if not settings.get("VAULT_PATH"):
            raise documents.StoreError("VAULT_PATH is not set")
        return TableBackend(spark, settings["VAULT_PATH"].rstrip("/"))
    if kind == "service":
        if client is None:
            raise documents.StoreError("a service needs a client")
        return ServiceBackend(client)
    raise documents.StoreError(f"unknown backend {kind!r}")
