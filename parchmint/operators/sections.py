"""Sections: the heading-bounded chunks of a markdown body."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from parchmint.staging import spread

UNDERLINE = {"=": 1, "-": 2}
FENCE = re.compile(r"^\s*(```|~~~)")


def _heading(line: str) -> tuple[int, str] | None:
    """Level and text of an ATX heading."""
    bare = line.rstrip("\r\n")
    marks = len(bare) - len(bare.lstrip("#"))
    if not 1 <= marks <= 6 or not bare[marks : marks + 1].isspace():
        return None
    title = bare[marks:].strip()
    if title and not title.strip("#"):
        return marks, ""
    closing = re.search(r"\s#+$", title)
    return marks, (title[: closing.start()] if closing else title).strip()


def headings(lines: list[str]) -> Iterator[tuple[int, int, int, str]]:
    """The headings outside fences: first line, line after, level, text."""
    fence, k = None, 0
    while k < len(lines):
        mark = FENCE.match(lines[k])
        if mark or fence:
            if fence is None:
                fence = mark.group(1)
            elif lines[k].lstrip().startswith(fence):
                fence = None
        elif (atx := _heading(lines[k])) is not None:
            yield k, k + 1, *atx
        elif lines[k].strip() and k + 1 < len(lines) and (under := set(lines[k + 1].rstrip())) in ({"="}, {"-"}):
            yield k, k + 2, UNDERLINE[under.pop()], lines[k].strip()
            k += 1
        k += 1


def parse_sections(body: str, doc_title: str | None = None) -> list[dict]:
    """The sections of a body: level, title, path and text, in order.

    Text before the first heading is a section of level 0 without a title, always there. Fences
    hide headings until one of the same kind closes them. A line of = or - under a non-blank line
    makes that line a heading. A path holds the document's title, the open ancestors of smaller
    level and the own title.
    """
    lines = body.splitlines(keepends=True)
    marks = [(0, 0, 0, None), *headings(lines)]
    ends = [m[0] for m in marks[1:]] + [len(lines)]
    open_titles: dict[int, str] = {}
    out = []
    for (_, start, level, title), end in zip(marks, ends):
        if level:
            open_titles = {k: t for k, t in open_titles.items() if k < level} | {level: title}
        path = ([doc_title] if doc_title else []) + [open_titles[k] for k in sorted(open_titles)]
        out.append({"level": level, "title": title, "path": path, "body": "".join(lines[start:end])})
    return out


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"ord": pa.int32(), "level": pa.int32(), "title": pa.string(), "path": pa.list_(pa.string()), "body": pa.string()}
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            rows, columns = [], {name: [] for name in kinds}
            for row, (doc_title, body) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                if body is None:
                    continue
                for n, section in enumerate(parse_sections(body, doc_title)):
                    rows.append(row)
                    for name in kinds:
                        columns[name].append(n if name == "ord" else section[name])
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), *[pa.array(columns[n], kinds[n]) for n in kinds]], ["doc_id", *kinds])


def sections_of(docs: DataFrame, id_col: str = "id", title_col: str | None = "title", body_col: str = "body") -> DataFrame:
    """(doc_id, ord, level, title, path, body) of the sections of each document; a null body has none."""
    title = docs[title_col] if title_col else docs[id_col].cast("string").substr(1, 0)
    rows = docs.select(docs[id_col].alias("doc_id"), title.alias("title"), docs[body_col].alias("body"))
    id_type = rows.schema[0].dataType.simpleString()
    return spread(rows).mapInArrow(_explode, f"doc_id {id_type}, ord int, level int, title string, path array<string>, body string")
