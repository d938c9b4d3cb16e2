"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the k smallest distinct hashes of a text's five-word shingles, in order. Sketches of parts merge into that of
the whole, and two sketches estimate resemblance, containment and the number of distinct shingles.

The query needs each document's next one, in descending order of doc_id. Documents are dealt once by ranges of doc_id and, within
an id, of a hash of the text, so many rows of one id, or without one, are many ranges. The first document of each range goes to the range before it
too, so each meets its successor in its own task. No window over all rows, and the texts are shuffled once.

Defined cases: null or empty text, or no words: the empty sketch, like itself (1) and unlike others (0); fewer than five
words: one shingle, the whole sequence; null doc_id: last in order; repeated doc_id: by a hash of the text within it; rows
with the same doc_id and text follow one another, in one task; one row: its own successor; empty table: empty result. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import common

K, WORDS = 128, 5


def sketch(text: bytes, k: int = K, words: int = WORDS) -> np.ndarray:
    return merged(common.shingle_hashes(text, words), k)


def merged(parts: Iterable[np.ndarray], k: int = K) -> np.ndarray:
    """The sketch of a whole from its parts' sketches or hashes."""
    out = np.empty(0, np.uint64)
    for part in parts:
        if len(out) == k:
            part = part[part < out[-1]]
        out = np.unique(np.concatenate([out, part]))[:k]
    return out


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Shared part of the k smallest hashes of both; exact if both texts have fewer than k distinct shingles."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:k]
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(union))


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated part of a's shingles that b has too."""
    if not len(a):
        return 1.0
    shared = resemblance(a, b, k) * distinct_count(merged([a, b], k), k)
    return min(1.0, shared / distinct_count(a, k))


def packed(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def unpacked(a: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(a), ">u8").astype(np.uint64)


def fingerprinted(docs: DataFrame, text: str = "text", k: int = K, words: int = WORDS) -> DataFrame:
    """docs with the column fingerprint, in place; one narrow stage."""
    common.bounded_batches(docs.sparkSession)
    kept = docs.drop("fingerprint")
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([packed(sketch(x, k, words)) for x in common.raw(batch.column(at))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, "fingerprint"])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("fingerprint", StringType())]))


def edited(text: str, following: str) -> str:
    """The last third of text replaced by as much of the start of following."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = [x.split()[0] for x in RESULT.split(", ")]


def compared(doc_id: int | None, text: str, own: np.ndarray, following: str, other: np.ndarray) -> tuple:
    changed = edited(text, following).encode()
    theirs = sketch(changed)
    return doc_id, len(text), hashlib.sha256(changed).hexdigest(), packed(own), packed(theirs), resemblance(own, theirs), resemblance(own, other)


#: Sampled rows for each range, from which the ranges' bounds are taken.
PER_RANGE = 64


def ranges(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many bounds are not above each key; both have rows that are compared from the first column on, and bounds are in order."""
    both = np.concatenate([bounds, keys])
    is_key = np.arange(len(both)) >= len(bounds)
    order = np.lexsort((is_key, *both.T[::-1]))
    below = np.cumsum(~is_key[order])
    out = np.empty(len(both), np.int64)
    out[order] = below
    return out[len(bounds) :]


def order_keys(ids: pa.Array, hashes: np.ndarray) -> np.ndarray:
    """Rows of numbers in the order of the documents: those with an id first, ids descending, then the text's hash."""
    none = ids.is_null().to_numpy(zero_copy_only=False)
    known = ids.cast(pa.int64()).fill_null(0).to_numpy()
    return np.stack([none.astype(np.int64), np.where(none, 0, ~known), hashes], axis=1)


def text_hashes(texts: pa.Array) -> np.ndarray:
    """Spark's xxhash64 of each text."""
    return np.array([xxhash.xxh64_intdigest(t, common.SEED) for t in common.raw(texts)], np.uint64).view(np.int64)


def with_next(docs: DataFrame) -> DataFrame:
    """Rows part, guest, doc_id, text, dealt by part and sorted, so that in each part, read in order, a document's next one follows it; a part's last
    row is a guest, the first of the next part. docs: doc_id, text (not null)."""
    spark = docs.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Bounds of the ranges, as a sort by ranges takes them: from a sample of keys whose size is bounded by the number of ranges.
    share = min(1.0, PER_RANGE * parts / max(docs.count(), 1))
    sample = docs.where(F.rand(7) < share).select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("hash")).toArrow().combine_chunks()
    keys = order_keys(sample["doc_id"].combine_chunks(), sample["hash"].to_numpy()) if sample.num_rows else np.empty((0, 3), np.int64)
    keys = keys[np.lexsort(keys.T[::-1])]
    bounds = np.unique(keys[:: max(1, len(keys) // parts)][1:], axis=0)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = order_keys(batch.column(0), text_hashes(batch.column(1)))
            of = ranges(keys, bounds)
            order = np.lexsort((*keys.T[::-1], of))
            first = order[np.r_[True, of[order][1:] != of[order][:-1]][: len(order)]]
            yield pa.RecordBatch.from_pydict({"range": of[first], "none": keys[first, 0], "down": keys[first, 1], "hash": keys[first, 2]})

    found = docs.select("doc_id", "text").mapInArrow(firsts, "range long, none long, down long, hash long")
    rows = found.groupBy("range").agg(F.min(F.struct("none", "down", "hash")).alias("first")).collect()  # a row for each range
    heads = sorted((r["range"], tuple(r["first"])) for r in rows)
    part_of, head_of = np.zeros(len(bounds) + 1, np.int32), np.zeros((len(bounds) + 1, 3), np.int64)
    for part, (n, first) in enumerate(heads):
        part_of[n], head_of[n] = part, first

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = order_keys(batch.column(0), text_hashes(batch.column(1)))
            of = ranges(keys, bounds)
            guests = np.flatnonzero((keys == head_of[of]).all(axis=1))
            own, before = part_of[of], (part_of[of[guests]] - 1) % max(len(heads), 1)
            out = batch.take(pa.array(np.r_[np.arange(len(of)), guests]))
            marks = [pa.array(np.r_[own, before], pa.int32()), pa.array(np.r_[np.zeros(len(of)), np.ones(len(guests))], pa.int32())]
            yield pa.RecordBatch.from_arrays([*marks, *out.columns], names=["part", "guest", "doc_id", "text"])

    spread = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(deal, "part int, guest int, doc_id long, text string")
    return spread.repartition("part").sortWithinPartitions("part", "guest", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.bounded_batches(spark)
    docs = common.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    fields = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *[(n, pa.string()) for n in NAMES[2:5]], *[(n, pa.float64()) for n in NAMES[5:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of, closed = None, None, False
        for batch in batches:
            rows = []
            for part, guest, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != of:
                    held, of, closed = None, part, False
                if closed:
                    continue  # further rows of the guest's id
                own = sketch(text.encode())
                if held:
                    rows.append(compared(*held, text, own))
                held, closed = (doc_id, text, own), bool(guest)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)

    return with_next(docs).mapInArrow(run, RESULT)
