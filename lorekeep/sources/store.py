"""Derived tables that a session keeps in the folder which driver and executors share, and files of notes."""

from __future__ import annotations

import itertools
import posixpath
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KEPT: dict[tuple, str] = {}


def folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Unset: a new local one if driver and executors are one process, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the session ends."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).deleteOnExit(at)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, whatever is asked of it."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A table of at most so many rows may be broadcast; it is counted first.
BROADCAST_ROWS = 50_000


def small_side(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def state(spark: SparkSession, path: str) -> tuple[tuple[str, int, int], ...]:
    """Names, sizes and times of a file or of the files in a folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))


def kept(spark: SparkSession, name: str, write: Callable[[str], object], of: str) -> DataFrame:
    """The table that write(path) makes as Parquet from the table at `of`, once for each application, name and state of that table; later calls read it."""
    key = (spark.sparkContext.applicationId, name, state(spark, of))
    if key not in _KEPT:
        path = fresh(spark, "kept")
        write(path)
        _KEPT[key] = path
    return spark.read.parquet(_KEPT[key])


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Writes each row (path below root, raw) as a file from the tasks; path and bytes of each. A file appears whole or not at all, so a task may run again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = FileSystem.from_uri(root if "://" in root else f"file://{root}")
        for batch in batches:
            sizes = []
            for path, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                to, data = posixpath.join(base, path), (raw or "").encode()
                fs.create_dir(posixpath.dirname(to), recursive=True)
                part = f"{posixpath.dirname(to)}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as f:
                    f.write(data)
                fs.move(part, to)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return files.select("path", "raw").mapInArrow(run, "path string, bytes long")


def write_parts(parts: DataFrame, root: str) -> DataFrame:
    """Writes files from their parts (path below root, part, raw), each streamed in the order of its parts, however long it is; path and bytes of each. A file appears whole or not at all."""
    dealt = parts.select("path", "part", "raw").repartition("path").sortWithinPartitions("path", "part").select("path", "raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = FileSystem.from_uri(root if "://" in root else f"file://{root}")
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for path, own in itertools.groupby(rows, lambda row: row[0]):
            to, size = posixpath.join(base, path), 0
            fs.create_dir(posixpath.dirname(to), recursive=True)
            part = f"{posixpath.dirname(to)}/.{uuid.uuid4().hex}"
            with fs.open_output_stream(part) as f:
                for _, raw in own:
                    size += f.write((raw or "").encode())
            fs.move(part, to)
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": pa.array([size], pa.int64())})

    return dealt.mapInArrow(run, "path string, bytes long")
