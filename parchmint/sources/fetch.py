"""Interfaces to the network: a fetcher of pages, of transcripts, of labels; each an object that is passed in."""

from __future__ import annotations

import time
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame


class Fetcher(Protocol):
    """Gets a page's markup, or raises."""

    def fetch(self, url: str) -> str: ...


class Tiers:
    """Fetchers tried one after the other until one gives more than ``least`` characters."""

    def __init__(self, *fetchers: Fetcher, least: int = 200):
        self.fetchers, self.least = fetchers, least

    def fetch(self, url: str) -> str:
        error: Exception = LookupError(url)
        for f in self.fetchers:
            try:
                if len(text := f.fetch(url)) > self.least:
                    return text
            except Exception as e:  # the next tier is the handler
                error = e
        raise error


def with_retries(call, tries: int = 4, pause: float = 1.0, final=()):
    """The result of ``call``, tried again after doubling pauses; errors of the types in ``final`` are not."""
    for k in range(tries):
        try:
            return call()
        except final:
            raise
        except Exception:
            if k == tries - 1:
                raise
            time.sleep(pause * 2**k)


def fetched(pages: DataFrame, fetcher: Fetcher, url_col: str = "url") -> DataFrame:
    """``pages`` with ``html`` and ``fetch_error``: what a fetcher got for each address, in the workers."""
    names = pages.columns
    at_url = names.index(url_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html, errors = [], []
            for url in batch.column(at_url).to_pylist():
                try:
                    html.append(fetcher.fetch(url))
                    errors.append(None)
                except Exception as error:  # a page that cannot be had is a row, not a failed task
                    html.append(None)
                    errors.append(str(error)[:2000])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(html, pa.string()), pa.array(errors, pa.string())], [*names, "html", "fetch_error"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields)
    return pages.mapInArrow(run, f"{fields}, html string, fetch_error string")
