"""A data source of the pages of large documents, read by ranges of pages, in batches or as a stream.

``page_source(open_document)`` makes the source for a parser: a function that opens a seekable file and
gives an object with ``pages``, their number, and ``text(i)`` for a page from 0 on. A file of
``LARGE`` bytes and more is opened once to count its pages and read by several tasks; smaller ones are
read whole. A page is tried ``retries`` times; then it is a row with an empty text and the
error, and the others of its file come as they are. As a stream, files come in the order in which
they were written, then by name, and an offset says up to which page of which file rows have come.

Defined cases: a file that does not open is one row, page 0, with the error; a file without pages gives no
row; an empty or missing folder gives no rows; a file that has grown since an offset continues at its
next page; files whose names begin with a dot or underscore are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

PAGES_A_TASK = 256
LARGE = 8 << 20
SCHEMA = "path string, page_no int, text string, error string"
_NAMES = ["path", "page_no", "text", "error"]


@dataclass
class _Pages(InputPartition):
    """Pages from ``start`` up to, not including, ``stop`` of a file; to its end if that is None."""

    path: str
    start: int
    stop: int | None


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


class _Files:
    def __init__(self, options, open_document: Callable):
        self.uri, self.open_document = options["path"], open_document
        self.each, self.large, self.retries = (int(options.get(k, d)) for k, d in (("pages", PAGES_A_TASK), ("large", LARGE), ("retries", 3)))

    def listed(self) -> list[tuple[int, str, int]]:
        """(time, path, size) of the files of the folder in the order in which they were written."""
        from pyarrow import fs

        store, folder = _filesystem(self.uri)
        found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return sorted((i.mtime_ns, i.path, i.size) for i in found if i.type == fs.FileType.File and not i.base_name.startswith((".", "_")))

    def count(self, path: str) -> int | None:
        """Number of pages; None if the file does not open."""
        store, _ = _filesystem(self.uri)
        try:
            with store.open_input_file(path) as f:
                return int(self.open_document(f).pages)
        except Exception:  # whatever a parser raises; the task that reads the file says what
            return None

    def ranges(self, path: str, start: int, stop: int | None) -> list[_Pages]:
        return [_Pages(path, start, None)] if stop is None else [_Pages(path, a, min(a + self.each, stop)) for a in range(start, stop, self.each)]

    def rows(self, part: _Pages) -> Iterator[pa.RecordBatch]:
        store, _ = _filesystem(self.uri)
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True))
            held.clear()
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], names=_NAMES)

        try:
            with store.open_input_file(part.path) as f:
                document = self.open_document(f)
                for i in range(part.start, document.pages if part.stop is None else part.stop):
                    error = None
                    for _ in range(max(1, self.retries)):
                        try:
                            held.append((part.path, i + 1, document.text(i) or "", None))
                            break
                        except Exception as e:  # whatever a parser raises on one page
                            error = f"{type(e).__name__}: {e}"
                    else:
                        held.append((part.path, i + 1, "", error))
                    if len(held) == 64:
                        yield batch()
        except Exception as e:
            held.append((part.path, 0, "", f"{type(e).__name__}: {e}"))
        if held:
            yield batch()


class _Reader(DataSourceReader):
    def __init__(self, files: _Files):
        self.files = files

    def partitions(self) -> list[_Pages]:
        out = []
        for _, path, size in self.files.listed():
            out += self.files.ranges(path, 0, self.files.count(path) if size >= self.files.large else None)
        return out or [_Pages("", 0, 0)]

    def read(self, part: _Pages) -> Iterator[pa.RecordBatch]:
        if part.path:
            yield from self.files.rows(part)


class _StreamReader(DataSourceStreamReader):
    """Offsets are {time, path, page}: all files before that one, and so many pages of it."""

    def __init__(self, files: _Files):
        self.files = files

    def initialOffset(self) -> dict:
        return {"time": -1, "path": "", "page": 0}

    def latestOffset(self) -> dict:
        found = self.files.listed()
        if not found:
            return self.initialOffset()
        time, path, _ = found[-1]
        return {"time": time, "path": path, "page": self.files.count(path) or 0}

    def partitions(self, start: dict, end: dict) -> list[_Pages]:
        out = []
        for time, path, _ in self.files.listed():
            if time > end["time"] or (time, path) > (end["time"], end["path"]):
                continue
            done = start["page"] if path == start["path"] else 0 if (time, path) > (start["time"], start["path"]) else None
            if done is None:
                continue
            last = end["page"] if path == end["path"] else self.files.count(path)
            out += [_Pages(path, 0, None)] if last is None else self.files.ranges(path, done, last)
        return out or [_Pages("", 0, 0)]

    def read(self, part: _Pages) -> Iterator[pa.RecordBatch]:
        if part.path:
            yield from self.files.rows(part)

    def commit(self, end: dict) -> None:
        pass


def page_source(open_document: Callable, name: str = "document_pages") -> type[DataSource]:
    """The data source of a parser, to be registered: ``spark.dataSource.register(page_source(f))``.

    Options: path of a folder, pages (of a task), large (bytes from which a file is split), retries.
    """

    class PageSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return _Reader(_Files(self.options, open_document))

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _StreamReader(_Files(self.options, open_document))

    return PageSource
