"""Quality classifier: a factorisation machine.

A text's features are hashed words, structure statistics (shares of character classes, repeated words, line and word
lengths) and metadata (its length). Each feature has a weight and a short vector; the pairwise interactions are summed in linear
time by half of (sum of v x)^2 - sum of (v x)^2.

The model is fitted on a bounded sample of labelled rows (SAMPLE, by order of a hash, so it doesn't depend on the input's
order); their features are computed by Spark and one task fits the weights, which have a fixed size. All rows are scored in one
narrow stage.

Defined cases: null or empty text: scored on its structure alone; null labels don't take part; several labels for one id:
the smallest; several documents for one id: one is learnt from; no usable labels: every score is 0.5, so the stage keeps all; null doc_id: never
learnt from, held_out false; texts of any length: read in pieces; extra columns stay, but quality_score is replaced (in the stage it stays);
empty table: empty result.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import common

BUCKETS, STATS, FACTORS = 2048, 18, 8
#: The classifier is fitted on at most so many labelled rows.
SAMPLE, EPOCHS, THRESHOLD = 6000, 24, 0.3
MEMO = 500_000


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -30, 30)))

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Linear part and pairwise interactions by the sum-of-squares identity; x has few rows and only non-zero columns."""
        x = x.copy()
        x[:, BUCKETS:] = np.clip((x[:, BUCKETS:] - self.mean) / self.scale, -4, 4)
        s = x @ self.vectors
        return self.bias + x @ self.weights + 0.5 * ((s * s).sum(1) - (x * x) @ (self.vectors * self.vectors).sum(1))


class Buckets(dict):
    """Bucket of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = bucket = zlib.crc32(word.lower()) % BUCKETS
        return bucket


def features(text: bytes, buckets: Buckets) -> np.ndarray:
    """BUCKETS hashed word frequencies of length 1, then STATS statistics."""
    counts, chars = np.zeros(BUCKETS), np.zeros(256)
    words = same = 0
    last = -1
    for piece in common.pieces(text):
        chars += np.bincount(np.frombuffer(piece, np.uint8), minlength=256)
        found = np.fromiter(map(buckets.__getitem__, piece.split()), np.int64)
        if len(found):
            counts += np.bincount(found, minlength=BUCKETS)
            words += len(found)
            same += int((found[1:] == found[:-1]).sum()) + (found[0] == last)
            last = found[-1]
    n, w = max(len(text), 1), max(words, 1)
    upper, lower, digits, high = chars[65:91].sum(), chars[97:123].sum(), chars[48:58].sum(), chars[128:].sum()
    white = chars[9:14].sum() + chars[32]
    marks = n - upper - lower - digits - high - white
    lines = chars[10] + 1
    ends = chars[46] + chars[33] + chars[63]
    stats = [
        upper / n,
        digits / n,
        high / n,
        white / n,
        marks / n,
        chars[33] / n,
        chars[[35, 36, 37, 38, 42]].sum() / n,
        chars[124] / n,
        (chars[44] + chars[46]) / n,
        upper / max(upper + lower, 1),
        same / w,
        np.count_nonzero(counts) / min(w, BUCKETS),
        counts.max() / w,
        (n - white) / w / 10,
        np.log1p(words),
        np.log1p(n / lines),
        ends / w,
        lines / w,
    ]
    value = np.log1p(counts)
    return np.concatenate([value / max(np.sqrt((value * value).sum()), 1e-9), stats]).astype(np.float32)


def fit(x: np.ndarray, y: np.ndarray, seed: int = 11) -> Model:
    """Logistic loss, Adagrad on small batches."""
    stats = x[:, BUCKETS:].astype(np.float64)
    mean, scale = stats.mean(0), stats.std(0) + 1e-6
    x = x.astype(np.float32)
    x[:, BUCKETS:] = np.clip((stats - mean) / scale, -4, 4)
    rng = np.random.default_rng(seed)
    bias, w, v = 0.0, np.zeros(x.shape[1]), rng.normal(0, 0.02, (x.shape[1], FACTORS))
    gb, gw, gv = 1e-6, np.full(w.shape, 1e-6), np.full(v.shape, 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 128):
            rows = order[at : at + 128]
            xb, yb = x[rows].astype(np.float64), y[rows]
            s = xb @ v
            squares = xb * xb
            margin = bias + xb @ w + 0.5 * ((s * s).sum(1) - squares @ (v * v).sum(1))
            g = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - yb) / len(rows)
            db, dw, dv = g.sum(), xb.T @ g + 1e-5 * w, xb.T @ (g[:, None] * s) - v * (squares.T @ g)[:, None] + 1e-4 * v
            gb, gw, gv = gb + db * db, gw + dw * dw, gv + dv * dv
            bias, w, v = bias - 0.1 * db / np.sqrt(gb), w - 0.1 * dw / np.sqrt(gw), v - 0.03 * dv / np.sqrt(gv)
    return Model(mean, scale, float(bias), w, v)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model from the labels that are not held out; None without both labels."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = common.written(usable.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(sample), "quality-sample")
    # At most `sample` rows: of several documents with one id the one whose text has the smallest hash.
    joined = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    rows = joined.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "quality")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in batches:
            made = pa.array([features(t, buckets).tobytes() for t in common.raw(batch.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), made], names=["doc_id", "quality", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, y, x = [], [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            y += batch.column(1).to_pylist()
            x += [np.frombuffer(v, np.float32) for v in batch.column(2).to_pylist()]
        if len(set(y)) == 2:
            order = sorted(range(len(ids)), key=lambda i: (ids[i], x[i].tobytes()))[:sample]
            model = fit(np.stack([x[i] for i in order]), np.array([y[i] for i in order], float))
            yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(tuple(model))], pa.binary())})

    found = rows.mapInArrow(describe, "doc_id long, quality int, x binary").repartition(1).mapInArrow(learn, "model binary").head()
    return Model(*pickle.loads(found[0])) if found else None


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with the column quality_score (0 to 1, higher: likelier good)."""
    common.bounded_batches(docs.sparkSession)
    kept = docs.drop("quality_score")
    at = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in batches:
            out = np.full(batch.num_rows, 0.5)
            texts = common.raw(batch.column(at)) if model else []
            for i in range(0, len(texts), 64):
                out[i : i + 64] = model.scores(np.stack([features(t, buckets) for t in texts[i : i + 64]]).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "quality_score"])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("quality_score", DoubleType())]))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = trained(docs, common.table(spark, sf_dir, "labels"))
    slim = scored(docs, model).select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"))
    return slim.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; all their columns as they were."""
    model = trained(common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "labels"))
    own = common.free("own_score", docs)
    kept = docs.withColumnsRenamed({c: own for c in docs.columns if c.lower() == "quality_score"})
    good = scored(kept, model).where(F.col("quality_score") >= THRESHOLD).drop("quality_score")
    return good.toDF(*docs.columns)
