"""Small helpers that the operators share: written tables, bounded Arrow batches, words and shingles of bytes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

#: A table of at most so many rows may be broadcast; the callers count first.
BROADCAST_ROWS = 50_000
#: Texts are cut into words by pieces of about so many bytes, so a very long text needs no more memory than a piece's words.
PIECE = 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")
SEED = 42


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Unset: a new local one if driver and executors are one process, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts the lineage and survives the loss of executors. Removed when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if a count shows that it is small, else unchanged, so that a shuffle join is planned. df should be a written table."""
    n = df.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def free(name: str, *frames: DataFrame) -> str:
    """The name, with underscores added while one of the frames has a column of that name."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, order: list[Column], sums: tuple[str, ...] = (), nth: str = "nth") -> DataFrame:
    """df with its place (from 1) in an order that has no ties, and for each of `sums` the sum over the rows before as <name>_before.

    A table of at most BROADCAST_ROWS rows is one window; a larger one is dealt by ranges, numbered within each and moved on by what the ranges before hold, a row for each range.
    """
    def before(w: WindowSpec) -> list[Column]:
        up_to = w.rowsBetween(Window.unboundedPreceding, -1)
        return [F.row_number().over(w).alias(nth), *[F.coalesce(F.sum(c).over(up_to), F.lit(0)).alias(f"{c}_before") for c in sums]]

    if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return df.select("*", *before(Window.orderBy(*order)))
    dealt = written(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    own = dealt.select("*", *before(Window.partitionBy("range").orderBy(*order)))
    per = dealt.groupBy("range").agg(F.count("*").alias("rows"), *[F.sum(c).alias(f"{c}_all") for c in sums])
    up_to = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    moved = per.select("range", *[F.coalesce(F.sum(c).over(up_to), F.lit(0)).alias(f"{c}_moved") for c in ("rows", *(f"{c}_all" for c in sums))])
    out = own.join(F.broadcast(moved), "range")  # a row for each shuffle partition
    kept = [F.col(c) for c in df.columns]
    return out.select(
        *kept,
        (F.col(nth) + F.col("rows_moved")).alias(nth),
        *[(F.col(f"{c}_before") + F.col(f"{c}_all_moved")).alias(f"{c}_before") for c in sums],
    )


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows, so that long texts don't add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null: empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces(text: bytes, size: int = PIECE) -> Iterator[bytes]:
    """Cut at white space into pieces of about size bytes; joined they are the text."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            found = SPACE.search(text, end)
            end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def shingle_hashes(text: bytes, n: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of each run of n words (A-Z lower-cased, cut at ASCII white space, joined by a space), repeats included, in arrays of bounded size. Fewer words: their whole sequence; none: nothing."""
    carry: list[bytes] = []
    some, digest = False, xxhash.xxh64_intdigest
    for piece in pieces(text):
        words = carry + piece.lower().split()
        if len(words) < n:
            carry = words
            continue
        joined = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(words) - n + 1].tolist()
        yield np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[n - 1 :].tolist(), strict=True)], np.uint64)
        some, carry = True, words[len(words) - n + 1 :]
    if not some and carry:
        yield np.array([digest(b" ".join(carry), seed)], np.uint64)
