"""Recorded pages of boards as a data source: format("recorded_pages"), with a partition for each endpoint.

Writing: each task appends bodies to one data file and describes its pages in an index beside it, ordered by endpoint, fetch
and page; the commit writes one manifest that names the files of all tasks that succeeded, so a task that is run twice or
lost leaves nothing that a reader sees. Reading: manifests say where an endpoint's index entries lie; a filter on
endpoint_id is pushed down and leaves out whole partitions. The page loop runs while reading: bodies after the one that
ends a fetch aren't read, and never more bytes of a fetch than its limit. Paths are opened through Arrow's file systems.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyarrow import fs as arrow_fs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from . import payloads

SCHEMA = "endpoint_id long, fetch_id long, page int, http_status int, token string, region string, body string, last boolean"
_FACTS = ("endpoint_id", "fetch_id", "page", "http_status", "token", "region")


def _strict(text: bytes) -> Any:
    """Parsed JSON; null for what isn't any, for non-finite numbers and for objects that name a key twice."""

    def once(pairs: list[tuple[str, Any]]) -> dict:
        out = dict(pairs)
        if len(out) < len(pairs):
            raise ValueError("a key comes twice")
        return out

    def refuse(constant: str) -> None:
        raise ValueError(constant)

    try:
        return json.loads(text, object_pairs_hook=once, parse_constant=refuse)
    except (ValueError, RecursionError):
        return None


@dataclass
class PageLoop:
    """Which pages of one fetch count: they do until the first bad one, and a short page is the last.

    Bad: a page that isn't the next one, a status other than 200, no list, too many rows, a body beyond what is left of the
    limit, a page or an id that was there before.
    """

    left: int = payloads.BODY_BYTES
    following: int = 0
    ended: bool = False
    prints: set[str] = field(default_factory=set)
    ids: set[str] = field(default_factory=set)

    def take(self, page: int, status: int | None, body: bytes) -> bool | None:
        """True for a page that is the last, False for one that others may follow, None for a bad one."""
        self.left -= len(body)
        rows = _strict(body) if self.left >= 0 and page == self.following < payloads.MOST_PAGES and status == 200 else None
        if not isinstance(rows, list) or len(rows) > payloads.PAGE_ROWS:
            return self._bad()
        mark = hashlib.sha256(json.dumps(rows, sort_keys=True).encode()).hexdigest()
        named = [r["id"].strip() for r in rows if isinstance(r, dict) and isinstance(r.get("id"), str)]
        named = [i for i in named if i]
        if mark in self.prints or len(set(named)) < len(named) or self.ids & set(named):
            return self._bad()
        self.prints.add(mark)
        self.ids.update(named)
        self.following += 1
        self.ended = len(rows) < payloads.PAGE_ROWS
        return self.ended

    def _bad(self) -> None:
        self.ended = True


@dataclass
class Endpoint(InputPartition):
    """An endpoint's index entries: (name of the files, offset and length in the index) of each task that wrote some."""

    endpoint_id: int
    parts: tuple[tuple[str, int, int], ...]

    def __init__(self, endpoint_id: int, parts: Sequence[tuple[str, int, int]]) -> None:
        super().__init__(endpoint_id)
        self.endpoint_id, self.parts = endpoint_id, tuple(parts)


class PagesReader(DataSourceReader):
    def __init__(self, path: str, loop: bool) -> None:
        self.path, self.loop, self.only = path, loop, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("endpoint_id",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = wanted if self.only is None else self.only & wanted
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        fs, root = arrow_fs.FileSystem.from_uri(self.path)
        of: dict[int, list[tuple[str, int, int]]] = {}
        for info in fs.get_file_info(arrow_fs.FileSelector(f"{root}/_manifests", allow_not_found=True)):
            with fs.open_input_stream(info.path) as f:
                for name, endpoint, at, size in json.loads(f.read()):
                    if self.only is None or endpoint in self.only:
                        of.setdefault(endpoint, []).append((name, at, size))
        return [Endpoint(e, sorted(parts)) for e, parts in sorted(of.items())] or [Endpoint(-1, ())]

    def read(self, partition: Endpoint) -> Iterator[tuple]:
        fs, root = arrow_fs.FileSystem.from_uri(self.path)
        pages = []
        for name, at, size in partition.parts:
            with fs.open_input_file(f"{root}/{name}.index") as f:
                pages += [(*json.loads(line), name) for line in f.read_at(size, at).splitlines()]
        loops: dict[int, PageLoop] = {}
        files: dict[str, Any] = {}
        for *facts, at, size, name in sorted(pages, key=lambda p: (p[1], p[2])):
            loop = loops.setdefault(facts[1], PageLoop())
            if self.loop and loop.ended:
                continue
            if name not in files:
                files[name] = fs.open_input_file(f"{root}/{name}.data")
            body = files[name].read_at(min(size, max(loop.left, 0) + 1) if self.loop else size, at)
            last = loop.take(facts[2], facts[3], body) if self.loop else None
            if not self.loop or last is not None:
                yield (*facts, body.decode("utf-8", "replace"), last)
        for f in files.values():
            f.close()


@dataclass
class Written(WriterCommitMessage):
    entries: list[tuple[str, int, int, int]]


class PagesWriter(DataSourceWriter):
    def __init__(self, path: str, columns: list[str], overwrite: bool) -> None:
        self.path, self.columns, self.overwrite = path, columns, overwrite

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        fs, root = arrow_fs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        name, at, pages = uuid.uuid4().hex, 0, []
        data = None
        for row in iterator:
            values = dict(zip(self.columns, row, strict=True))
            body = (values["body"] or "").encode()
            data = data or fs.open_output_stream(f"{root}/{name}.data")
            data.write(body)
            pages.append([*(values.get(c) for c in _FACTS), at, len(body)])
            at += len(body)
        if data is None:
            return Written([])
        data.close()
        of: dict[int, bytearray] = {}
        for p in sorted(pages, key=lambda p: tuple(p[:3])):
            of.setdefault(p[0], bytearray()).extend(json.dumps(p).encode() + b"\n")
        entries, at = [], 0
        with fs.open_output_stream(f"{root}/{name}.index") as f:
            for endpoint, lines in of.items():
                f.write(bytes(lines))
                entries.append((name, endpoint, at, len(lines)))
                at += len(lines)
        return Written(entries)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = arrow_fs.FileSystem.from_uri(self.path)
        fs.create_dir(f"{root}/_manifests", recursive=True)
        old = [x.path for x in fs.get_file_info(arrow_fs.FileSelector(f"{root}/_manifests"))] if self.overwrite else []
        with fs.open_output_stream(f"{root}/_manifests/{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([e for m in messages if m for e in m.entries]).encode())
        for path in old:
            fs.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = arrow_fs.FileSystem.from_uri(self.path)
        for name in {e[0] for m in messages if m for e in m.entries}:
            for end in ("data", "index"):
                fs.delete_file(f"{root}/{name}.{end}")


class RecordedPages(DataSource):
    """Options: path (absolute, or a URI), and pages: `counted` (the page loop of the second board, the default) or `all`.

    Rows to write have endpoint_id, fetch_id, page and body, and http_status, token and region where they are known; a null
    body is empty. `last` is null with pages=all. A folder that isn't there reads as an empty table.
    """

    @classmethod
    def name(cls) -> str:
        return "recorded_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagesReader(self.options["path"], self.options.get("pages", "counted") == "counted")

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return PagesWriter(self.options["path"], schema.names, overwrite)
