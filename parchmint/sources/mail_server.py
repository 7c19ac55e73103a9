"""Mail as a source that is read in batches or watched, with acknowledgement once a batch is stored."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from parchmint.sources.fetch import with_retries
from parchmint.sources.mailbox import captures_of, search_criterion

RAW = "uid BIGINT, raw BINARY"
#: Attempts to reach the server before a batch is given up, and seconds between looks of a watch and after a lost connection.
TRIES, POLL, RECONNECT = 3, 30.0, 5.0


class MailServer(Protocol):
    """A mailbox: unseen message numbers by criterion, raw messages, and marking as seen."""

    def search(self, criterion: str) -> list[int]: ...

    def fetch(self, uid: int) -> bytes: ...

    def mark_seen(self, uid: int) -> None: ...


def unseen(spark: SparkSession, server: MailServer, since: str | None = None, criterion: str | None = None, most: int = 500) -> DataFrame:
    """(uid, raw) of the oldest ``most`` messages that match; what cannot be fetched is left for the next batch.

    A mailbox is one connection, so the messages of a batch, a bounded number, pass through the driver.
    """
    uids = with_retries(lambda: server.search(search_criterion(since, criterion)), TRIES)
    rows = []
    for uid in sorted(uids)[:most]:
        try:
            rows.append((uid, bytearray(with_retries(lambda uid=uid: server.fetch(uid), TRIES))))
        except Exception:  # one message does not keep the others
            continue
    return spark.createDataFrame(rows, RAW)


def ingest(spark: SparkSession, server: MailServer, store: Callable[[DataFrame], None], keep: Callable[[DataFrame], DataFrame] | None = None, **options) -> tuple[int, int]:
    """One batch: fetch, parse, filter, store, and only then acknowledge; (fetched, stored).

    A failing store acknowledges nothing, so the batch comes again; the write's idempotence bears that.
    """
    messages = unseen(spark, server, **options)
    uids = [r["uid"] for r in messages.select("uid").collect()]  # a batch's numbers
    if not uids:
        return 0, 0
    captures = captures_of(messages).where("error is null")
    kept = captures if keep is None else keep(captures)
    n = kept.count()
    store(kept)
    for uid in uids:
        with_retries(lambda uid=uid: server.mark_seen(uid), TRIES)
    return len(uids), n


def watch(spark: SparkSession, server: MailServer, store: Callable[[DataFrame], None], keep: Callable[[DataFrame], DataFrame] | None = None, rounds: int | None = None, pause: float = POLL, sleep: Callable[[float], None] = time.sleep, **options) -> Iterator[tuple[int, int]]:
    """Batch after batch as mail arrives, each round's (fetched, stored); a lost connection is tried again after a while.

    ``rounds`` ends the watch (null: never).
    """
    done = 0
    while rounds is None or done < rounds:
        done += 1
        try:
            yield ingest(spark, server, store, keep, **options)
        except ConnectionError:
            yield 0, 0
            sleep(RECONNECT)
            continue
        sleep(pause)
