"""Data sources of archives for spark.read and writeStream: notes, samples of logs, and queues.

Notes and logs: filters on folders are pushed to the listing, so other folders aren't listed; names and sizes are planned on the driver into
partitions of bounded bytes and numbers of files, tasks read them. A queue is a list of commits: a commit names the part files that tasks wrote, so
rows are seen whole or not at all, a task that fails leaves no file, and a stream reads from commit to commit. A commit in mode overwrite replaces
what came before it for readers of the whole queue; to streams it brings nothing new. One writer commits at a time.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileInfo, FileSelector, FileSystem, FileType
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamArrowWriter,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

NOTES, LOGS, QUEUE = "archive_notes", "archive_logs", "archive_queue"
#: Bytes and files of a partition, bytes read at once from a log, bytes of a batch of notes.
PART_BYTES, PART_FILES, BLOCK, BATCH_BYTES = 64 << 20, 4096, 1 << 16, 8 << 20


def opened(root: str) -> tuple[FileSystem, str]:
    """File system and path of a folder that driver and tasks share."""
    root = re.sub(r"^file:/(?!/)", "file:///", root)
    return FileSystem.from_uri((root if "://" in root else f"file://{root}").rstrip("/"))


def listed(fs: FileSystem, at: str, recursive: bool = False) -> list[FileInfo]:
    return fs.get_file_info(FileSelector(at, allow_not_found=True, recursive=recursive))


def folders(fs: FileSystem, at: str) -> list[str]:
    return sorted(f.base_name for f in listed(fs, at) if f.type == FileType.Directory)


@dataclass
class Files(InputPartition):
    """Path below the root, milliseconds of the last change and bytes of some files."""

    files: list[tuple[str, int, int]]


def packed(files: Iterable[tuple[str, int, int]]) -> list[Files]:
    """Files in partitions that are bounded in bytes (or one file) and in number; at least one partition."""
    out, size = [Files([])], 0
    for f in files:
        if out[-1].files and (size + f[2] > PART_BYTES or len(out[-1].files) >= PART_FILES):
            out.append(Files([]))
            size = 0
        out[-1].files.append(f)
        size += f[2]
    return out


class Pruned(DataSourceReader):
    """A reader whose columns in `keys` are names of folders; equality with them is pushed to the listing."""

    keys: tuple[str, ...] = ()

    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.options, self.only = options["path"], dict(options), {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if name not in self.keys:
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.only[name] = self.only[name] & values if name in self.only else values

    def wanted(self, key: str, value: str | None) -> bool:
        return key not in self.only or value in self.only[key]


class NoteReader(Pruned):
    keys = ("project", "folder")

    def partitions(self) -> list[Files]:
        fs, base = opened(self.root)
        keyword_only = self.options.get("keyword_only", "false").lower() == "true"

        def found() -> Iterator[tuple[str, int, int]]:
            below = [("topics", f) for f in listed(fs, f"{base}/topics")] if self.wanted("project", None) and self.wanted("folder", "topics") else []
            for project in filter(lambda p: self.wanted("project", p), folders(fs, f"{base}/projects")):
                at = f"projects/{project}"
                own = listed(fs, f"{base}/{at}")
                inner = [f.base_name for f in own if f.type == FileType.Directory and self.wanted("folder", f.base_name)]
                below += [(at, f) for f in own if self.wanted("folder", None)]
                below += [(at, f) for name in sorted(inner) for f in listed(fs, f"{base}/{at}/{name}", recursive=True)]
            for _, f in below:
                path = posixpath.relpath(f.path, base)
                name = f.base_name
                hidden = name.startswith("_") and (keyword_only or name != "_project.md")
                aside = "/_templates/" in path or (not keyword_only and "/_views/" in path)
                if f.type == FileType.File and f.size and name.endswith(".md") and not name.startswith(".") and not hidden and not aside:
                    yield path, f.mtime_ns // 1_000_000, f.size

        return packed(sorted(found()))

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, base = opened(self.root)
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            path, project, folder, raw, ms, n = zip(*rows, strict=True)
            times = pa.array([datetime.fromtimestamp(x / 1000, UTC) for x in ms], pa.timestamp("us", tz="UTC"))
            text = [pa.array(c, pa.string()) for c in (path, project, folder, raw)]
            return pa.RecordBatch.from_arrays([*text, times, pa.array(n, pa.int64())], names=["path", "project", "folder", "raw", "modified", "bytes"])

        for path, ms, n in partition.files:
            with fs.open_input_stream(f"{base}/{path}") as f:
                raw = f.read().decode(errors="replace")
            top, *rest = path.split("/")
            project, folder = (None, top) if top == "topics" else (rest[0], rest[1] if len(rest) > 2 else None)
            rows.append((path, project, folder, raw, ms, n))
            size += len(raw)
            if size >= BATCH_BYTES:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()


class Notes(DataSource):
    """path below the root, project and folder (null where a note has none; topics: folder topics), raw, modified, bytes of each note.

    Option keyword_only: overviews and everything else that begins with an underscore left out, views read. Undecodable bytes become replacement characters; empty files are left out.
    """

    @classmethod
    def name(cls) -> str:
        return NOTES

    def schema(self) -> str:
        return "path string, project string, folder string, raw string, modified timestamp, bytes long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return NoteReader(self.options)


class LogReader(Pruned):
    keys = ("project",)

    def partitions(self) -> list[Files]:
        fs, base = opened(self.root)
        least = int(self.options.get("min_bytes", 1024))
        found = (f for p in folders(fs, base) if self.wanted("project", p) for f in listed(fs, f"{base}/{p}", recursive=True))
        logs = (f for f in found if f.type == FileType.File and f.base_name.endswith(".jsonl") and f.size >= least)
        # Of a log only its first lines are read, so its size doesn't count.
        return packed((posixpath.relpath(f.path, base), 0, min(f.size, BLOCK)) for f in logs if self.wanted("project", f.path.split("/")[-2]))

    def lines(self, fs: FileSystem, path: str, most: int) -> int:
        """Lines that aren't blank, counted up to `most`; no block is read after that."""
        n, text = 0, False
        with fs.open_input_file(path) as f:
            while n < most and (block := f.read(BLOCK)):
                *ends, last = block.split(b"\n")
                for line in ends:
                    n += text or bool(line.strip(b" \r"))
                    text = False
                text = text or bool(last.strip(b" \r"))
        return min(n + text, most)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        (fs, base), most = opened(self.root), int(self.options.get("most", 11))
        if rows := [(p.split("/")[-2], posixpath.basename(p).removesuffix(".jsonl"), fs.get_file_info(f"{base}/{p}").size, self.lines(fs, f"{base}/{p}", most)) for p, _, _ in partition.files]:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["project", "session", "bytes", "lines"])


class Logs(DataSource):
    """project (a log's folder), session, bytes, lines (not blank, counted up to option `most`) of each log of at least min_bytes."""

    @classmethod
    def name(cls) -> str:
        return LOGS

    def schema(self) -> str:
        return "project string, session string, bytes long, lines long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return LogReader(self.options)


@dataclass
class Written(WriterCommitMessage):
    part: str | None


@dataclass
class Part(InputPartition):
    part: str | None


class Commits:
    """The commits of a queue, numbered from 1."""

    def __init__(self, root: str) -> None:
        self.fs, self.base = opened(root)
        self.at = f"{self.base}/_commits"

    def numbers(self) -> list[int]:
        return sorted(int(f.base_name[:-5]) for f in listed(self.fs, self.at) if re.fullmatch(r"\d+\.json", f.base_name))

    def read(self, n: int) -> dict:
        with self.fs.open_input_stream(f"{self.at}/{n:012d}.json") as f:
            return json.loads(f.read())

    def add(self, parts: list[str], schema: str, replaces: bool = False, writer: str = "", batch: int = -1) -> None:
        """A batch of a stream is committed once, however often it is written."""
        numbers = self.numbers()
        if batch >= 0:
            last = next((c["batch"] for c in map(self.read, reversed(numbers)) if c["writer"] == writer), -1)
            if last >= batch:
                self.remove(parts)
                return
        self.fs.create_dir(self.at, recursive=True)
        made, n = f"{self.at}/.{uuid.uuid4().hex}", (numbers or [0])[-1] + 1
        with self.fs.open_output_stream(made) as f:
            f.write(json.dumps({"parts": parts, "schema": schema, "replaces": replaces, "writer": writer, "batch": batch}).encode())
        self.fs.move(made, f"{self.at}/{n:012d}.json")

    def parts(self, numbers: list[int]) -> list[str]:
        """Of the whole queue: from its last replacing commit on."""
        out: list[str] = []
        for c in map(self.read, reversed(numbers)):
            out += c["parts"]
            if c["replaces"]:
                break
        return out

    def remove(self, parts: Iterable[str | None]) -> None:
        for p in parts:
            if p and self.fs.get_file_info(f"{self.base}/{p}").type == FileType.File:
                self.fs.delete_file(f"{self.base}/{p}")


def part_rows(root: str, part: str | None, names: list[str]) -> Iterator[pa.RecordBatch]:
    if part:
        fs, base = opened(root)
        with fs.open_input_file(f"{base}/{part}") as f:
            yield from pq.ParquetFile(f).iter_batches(batch_size=8192, columns=names)


class QueueReader(DataSourceReader):
    def __init__(self, root: str, names: list[str]) -> None:
        self.root, self.names = root, names

    def partitions(self) -> list[Part]:
        commits = Commits(self.root)
        return [Part(p) for p in commits.parts(commits.numbers())] or [Part(None)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return part_rows(self.root, partition.part, self.names)


class QueueStream(DataSourceStreamReader):
    """Offsets are numbers of commits."""

    def __init__(self, root: str, names: list[str]) -> None:
        self.root, self.names = root, names

    def initialOffset(self) -> dict:
        return {"commit": 0}

    def latestOffset(self) -> dict:
        return {"commit": (Commits(self.root).numbers() or [0])[-1]}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        commits = Commits(self.root)
        new = [c for c in map(commits.read, range(start["commit"] + 1, end["commit"] + 1)) if not c["replaces"]]
        return [Part(p) for c in new for p in c["parts"]] or [Part(None)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return part_rows(self.root, partition.part, self.names)


class QueueTask:
    """What a task writes: one part file, or none if it has no rows or fails."""

    def __init__(self, root: str, schema: StructType, replaces: bool = False, writer: str = "") -> None:
        self.root, self.schema, self.replaces, self.writer = root, schema.json(), replaces, writer

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = opened(self.root)
        fs.create_dir(base, recursive=True)
        part, made, writer = f"part-{uuid.uuid4().hex}.parquet", f"{base}/.{uuid.uuid4().hex}", None
        out = fs.open_output_stream(made)
        try:
            for batch in iterator:
                if batch.num_rows:
                    writer = writer or pq.ParquetWriter(out, batch.schema)
                    writer.write_batch(batch)
            if writer:
                writer.close()
            out.close()
        except BaseException:
            out.close()
            fs.delete_file(made)
            raise
        if not writer:
            fs.delete_file(made)
            return Written(None)
        fs.move(made, f"{base}/{part}")
        return Written(part)


class QueueWriter(QueueTask, DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        Commits(self.root).add([m.part for m in messages if m and m.part], self.schema, self.replaces)

    def abort(self, messages: list[Written | None]) -> None:
        Commits(self.root).remove(m.part for m in messages if m)


class QueueStreamWriter(QueueTask, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:
        if parts := [m.part for m in messages if m and m.part]:
            Commits(self.root).add(parts, self.schema, writer=self.writer, batch=batchId)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        Commits(self.root).remove(m.part for m in messages if m)


class Queue(DataSource):
    """Rows of any columns, appended or (mode overwrite) replaced by commits. Streams that write it name themselves by option `writer`, if there are several."""

    @classmethod
    def name(cls) -> str:
        return QUEUE

    def schema(self) -> StructType:
        commits = Commits(self.options["path"])
        numbers = commits.numbers()
        if not numbers:
            raise ValueError("a queue without commits needs a schema")
        return StructType.fromJson(json.loads(commits.read(numbers[-1])["schema"]))

    def reader(self, schema: StructType) -> DataSourceReader:
        return QueueReader(self.options["path"], schema.fieldNames())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return QueueStream(self.options["path"], schema.fieldNames())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return QueueWriter(self.options["path"], schema, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return QueueStreamWriter(self.options["path"], schema, writer=self.options.get("writer", ""))


def swept(root: str) -> int:
    """Removes part files that commits before the last replacing one alone name, once nobody reads these any more; their number. Commits stay, for the offsets of streams that have read them."""
    commits = Commits(root)
    numbers = commits.numbers()
    live = set(commits.parts(numbers))
    old = {p for c in map(commits.read, numbers) for p in c["parts"]} - live
    there = {f.base_name for f in listed(commits.fs, commits.base)} & old
    commits.remove(there)
    return len(there)


def registered(spark: SparkSession) -> SparkSession:
    """The session with these formats; pushed filters are switched on for Python's sources."""
    if spark.conf.get("spark.lorekeep.formats", None) is None:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        for source in (Notes, Logs, Queue):
            spark.dataSource.register(source)
        spark.conf.set("spark.lorekeep.formats", "true")
    return spark
