"""Session settings the library relies on, and a factory for local use."""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from parchmint.staging import shared_dir, write_bytes

#: Options that change results, not only speed: timestamps are UTC, later map keys win.
SEMANTIC = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}

#: Options that only save work: sessions of a busy key are merged before they are shuffled.
SAVING = {"spark.sql.sessionWindow.merge.sessions.in.local.partition": "true"}

LOCAL = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once, through the shared folder."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    archive = f"{shared_dir(spark)}/parchmint/code-{uuid.uuid4().hex}/parchmint_code.zip"
    write_bytes(spark, archive, packed.getvalue())
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def prepare(spark: SparkSession) -> SparkSession:
    """Set the options of :data:`SEMANTIC` and :data:`SAVING` on an existing session, ship the package, return the session."""
    ship(spark)
    for key, value in (SEMANTIC | SAVING).items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cpus: int | None = None, memory: str = "8g", name: str = "parchmint") -> SparkSession:
    """A session on this machine, for tests and the benchmark."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    for key, value in {
        **LOCAL,
        **SEMANTIC,
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.driver.memory": memory,
    }.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
