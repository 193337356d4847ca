"""Archives of many documents in few files, as a data source: `spark.dataSource.register(ArchiveSource)`, format `tagweft_archive`.

A folder holds data files and one list of files for each commit. A record is a mark, the document's number, the length of
its text in bytes, and the text in UTF-8. Files are read by ranges of bytes: a reader begins at the first mark in its range and
reads the records that begin there, so a file of any size is dealt over many tasks. A schema without `text` makes readers
skip the texts. Tasks write to files of their own, and only those of tasks that succeeded are named by a commit: what a lost
or repeated task has written is never read. In a stream, the commits are the offsets.

Paths are what pyarrow.fs can open (local ones and file:// of a folder that all executors reach, s3://, hdfs://, gs://). Null ids and
texts stay null.
"""

from __future__ import annotations

import json
import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "doc_id long, text string"
#: Begins every record.
MARK = b"\xfetagweft-record\xff"
HEAD = struct.Struct("<qBq")  # number, whether it is null, length (below 0: null)
#: Bytes of a range, by default, and rows of a batch.
RANGE, ROWS = 32 << 20, 1000


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _commits(path: str) -> list[str]:
    """The names of a folder's lists, in order of their commits."""
    system, folder = _opened(path)
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.base_name for f in found if f.base_name.startswith("commit-"))


def _files(path: str, commits: list[str]) -> list[tuple[str, int]]:
    system, folder = _opened(path)
    found = []
    for name in commits:
        with system.open_input_file(posixpath.join(folder, name)) as f:
            found += [tuple(x) for x in json.loads(f.read())]
    return found


@dataclass
class Range(InputPartition):
    name: str
    start: int
    end: int


def _ranges(path: str, commits: list[str], size: int) -> list[Range]:
    return [Range(name, at, min(at + size, length)) for name, length in _files(path, commits) for at in range(0, length, size)]


def _first_mark(file, start: int, end: int) -> int | None:
    """Where the first mark begins in a range."""
    at, rest = start, b""
    file.seek(start)
    while at < end + len(MARK):
        block = file.read(1 << 16)
        found = (rest + block).find(MARK)
        if found >= 0:
            place = at - len(rest) + found
            return place if place < end else None
        if not block:
            return None
        rest = (rest + block)[-len(MARK) + 1 :]
        at += len(block)
    return None


def read_range(path: str, part: Range, columns: list[str]) -> Iterator[pa.RecordBatch]:
    kinds = {"doc_id": pa.int64(), "text": pa.string()}
    rows: list[tuple] = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([r[c == "text"] for r in rows], kinds[c]) for c in columns], columns)

    system, folder = _opened(path)
    with system.open_input_file(posixpath.join(folder, part.name)) as file:
        at = _first_mark(file, part.start, part.end)
        while at is not None and at < part.end:
            file.seek(at + len(MARK))
            head = file.read(HEAD.size)
            if len(head) < HEAD.size:
                break
            number, is_null, length = HEAD.unpack(head)
            text = file.read(length).decode() if length >= 0 and "text" in columns else None
            rows.append((None if is_null else number, text))
            at += len(MARK) + HEAD.size + max(0, length)
            if len(rows) >= ROWS:
                yield batch()
                rows = []
    if rows:
        yield batch()


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.size, self.columns = options["path"], int(options.get("rangebytes", RANGE)), columns

    def partitions(self) -> list[Range]:
        return _ranges(self.path, _commits(self.path), self.size) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.name:
            yield from read_range(self.path, partition, self.columns)


class ArchiveStreamReader(DataSourceStreamReader):
    """Offsets are the names of commits, '' before the first."""

    def __init__(self, options: dict, columns: list[str]):
        self.path, self.size, self.columns = options["path"], int(options.get("rangebytes", RANGE)), columns

    def initialOffset(self) -> dict:
        return {"commit": ""}

    def latestOffset(self) -> dict:
        return {"commit": max(_commits(self.path), default="")}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return _ranges(self.path, [c for c in _commits(self.path) if start["commit"] < c <= end["commit"]], self.size)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from read_range(self.path, partition, self.columns)


@dataclass
class Written(WriterCommitMessage):
    name: str
    length: int


class ArchiveWriter(DataSourceWriter):
    """Appends a commit to the folder, or with overwrite one that replaces all before."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, iterator) -> Written:
        system, folder = _opened(self.path)
        system.create_dir(folder, recursive=True)
        name, length = f"data-{uuid.uuid4().hex}", 0
        with system.open_output_stream(posixpath.join(folder, name)) as out:
            for row in iterator:
                text = None if row.text is None else row.text.encode()
                record = MARK + HEAD.pack(row.doc_id or 0, row.doc_id is None, -1 if text is None else len(text)) + (text or b"")
                out.write(record)
                length += len(record)
        return Written(name, length)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = _opened(self.path)
        system.create_dir(folder, recursive=True)
        before = _commits(self.path)
        done = [[m.name, m.length] for m in messages if m is not None and m.length]
        number = int(before[-1].split("-")[1]) + 1 if before else 0
        name = f"commit-{number:012d}"
        with system.open_output_stream(posixpath.join(folder, f".{name}")) as out:
            out.write(json.dumps(done).encode())
        system.move(posixpath.join(folder, f".{name}"), posixpath.join(folder, name))
        for old in before if self.overwrite else ():
            system.delete_file(posixpath.join(folder, old))

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = _opened(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(posixpath.join(folder, m.name))


class ArchiveSource(DataSource):
    """Options: path, and rangeBytes (bytes of a task's range)."""

    @classmethod
    def name(cls) -> str:
        return "tagweft_archive"

    def schema(self) -> str:
        return SCHEMA

    def _columns(self, schema) -> list[str]:
        names = schema.fieldNames()
        if not names or set(names) - {"doc_id", "text"}:
            raise ValueError(f"an archive has the columns {SCHEMA}, not {names}")
        return names

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self._lowered(), self._columns(schema))

    def streamReader(self, schema) -> ArchiveStreamReader:
        return ArchiveStreamReader(self._lowered(), self._columns(schema))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        self._columns(schema)
        return ArchiveWriter(self._lowered(), overwrite)

    def _lowered(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}
