"""Line dedup by a sharded minimal perfect hash.

A line's key is the line without white space at its ends, A-Z lower-cased. Keys of at least MIN_CHARS code points are hashed to 128
bits and counted by document. The distinct hashes that reach the limit are dealt to shards; each shard builds a minimal
perfect hash over them, which indexes compact arrays: a 64-bit fingerprint, the count, and the largest doc_id that holds the line.
Documents then probe the arrays: their line hashes go to the shards, and what must go (its count reaches the limit and another doc_id holds
it) comes back as a list of hashes for each document. No table of lines is joined. A hash that isn't in a shard is told by its fingerprint (64
bits beside the 64 of the shard's).

Each shard has copies, and a probe goes to one of them: so many that a copy answers GROUP_PROBES probes on average, whatever the share of lines that
repeat, and more of a shard whose hottest line alone has more. The number of probes is counted while the lines are.

All counts are exact; nothing is sampled or capped. Python works on batches inside tasks, Spark deals, counts and joins.

Defined cases: null or empty text: one empty line, kept; rows are documents, also when a doc_id repeats; rows with the
holder's doc_id all keep the line; null doc_id: smaller than any other; what a row loses is kept by its doc_id and a hash of its text, so rows
without an id are apart; very long texts: one text at a time; extra columns stay, but kept_text, n_lines and n_dropped are replaced; in the stage all
columns stay; empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import common

MIN_CHARS, MIN_DOCS = 20, 3
#: Keys of a shard, copies of it at least, and probes that a copy answers, on average.
SHARD_KEYS, SALTS, GROUP_PROBES = 65_536, 8, 1_000_000
WHITE = b" \t\n\x0b\x0c\r"
NO_ID = -(2**63)
ADDED = ("kept_text", "n_lines", "n_dropped")
GAMMA, LEVELS = 2.0, 48


def keys(text: bytes, min_chars: int = MIN_CHARS) -> list[bytes | None]:
    """128-bit hash of each line's key; None for lines that are too short."""
    out: list[bytes | None] = []
    digest = xxhash.xxh3_128_digest
    for line in text.split(b"\n"):
        key = line.strip(WHITE)
        n = len(key)
        if n >= min_chars and (n >= 4 * min_chars or len(key.decode()) >= min_chars):
            out.append(digest(key.lower()))
        else:
            out.append(None)
    return out


def mixed(h: np.ndarray, level: int) -> np.ndarray:
    """Another hash of h for each level."""
    with np.errstate(over="ignore"):
        h = (h + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit values: a value takes the first level on which it is alone in its place; its number is the count of taken places before it."""

    def __init__(self, bits: list[np.ndarray]) -> None:
        self.bits = bits
        self.ranks, at = [], 0
        for b in bits:
            self.ranks.append(at + np.cumsum(b) - b)
            at += int(b.sum())

    @classmethod
    def over(cls, values: np.ndarray) -> PerfectHash:
        bits, left = [], np.unique(values.astype(np.uint64))
        for level in range(LEVELS):
            if not len(left):
                return cls(bits)
            places = mixed(left, level) % np.uint64(max(8, int(GAMMA * len(left))))
            taken = np.bincount(places.astype(np.int64), minlength=max(8, int(GAMMA * len(left))))
            bits.append((taken == 1).astype(np.int64))
            left = left[taken[places.astype(np.int64)] > 1]
        raise ValueError("values left after the last level")

    def find(self, values: np.ndarray) -> np.ndarray:
        """Number of each value; any number or -1 for values that it was not built over."""
        out = np.full(len(values), -1, np.int64)
        open_ = np.arange(len(values))
        for level, (b, rank) in enumerate(zip(self.bits, self.ranks, strict=True)):
            places = (mixed(values[open_].astype(np.uint64), level) % np.uint64(len(b))).astype(np.int64)
            hit = b[places] == 1
            out[open_[hit]] = rank[places[hit]]
            open_ = open_[~hit]
        return out

    def packed(self) -> tuple[bytes, list[int]]:
        return b"".join(np.packbits(b.astype(np.uint8)).tobytes() for b in self.bits), [len(b) for b in self.bits]

    @classmethod
    def unpacked(cls, data: bytes, sizes: list[int]) -> PerfectHash:
        bits, at = [], 0
        for n in sizes:
            width = (n + 7) // 8
            bits.append(np.unpackbits(np.frombuffer(data, np.uint8, width, at), count=n).astype(np.int64))
            at += width
        return cls(bits)


INDEX = "shard long, most long, bits binary, sizes array<long>, fingerprints binary, counts binary, holders binary"


def built(table: pa.Table) -> pa.Table:
    """Arrays of one shard, from its rows shard, h1, h2, count, holder; h1 and h2 make one key, h1's collisions are told apart by level hashing over both."""
    h1, h2 = (table[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
    value = h1 ^ mixed(h2, 97)
    index = PerfectHash.over(value)
    at = index.find(value)
    prints, counts, holders = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint32), np.zeros(len(at), np.int64)
    prints[at], counts[at], holders[at] = h2, np.minimum(table["count"].to_numpy(), 2**32 - 1), table["holder"].to_numpy()
    data, sizes = index.packed()
    return pa.table(
        {
            "shard": [table["shard"][0].as_py()],
            "most": [int(table["count"].to_numpy().max())],
            "bits": [data],
            "sizes": pa.array([sizes], pa.list_(pa.int64())),
            "fingerprints": [prints.tobytes()],
            "counts": [counts.tobytes()],
            "holders": [holders.tobytes()],
        }
    )


PROBE = "id long, of long, h1 long"


def probed(min_docs: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of the probes id, of, h1, h2 of a copy of a shard those that must go."""
    fields = pa.schema([("id", pa.int64()), ("of", pa.int64()), ("h1", pa.int64())])

    def run(probes: pa.Table, shard: pa.Table) -> pa.Table:
        if not probes.num_rows or not shard.num_rows:
            return fields.empty_table()
        row = {c: shard[c][0].as_py() for c in ("bits", "sizes", "fingerprints", "counts", "holders")}
        index = PerfectHash.unpacked(row["bits"], row["sizes"])
        h1, h2, ids = (probes[c].to_numpy() for c in ("h1", "h2", "id"))
        at = index.find(h1.view(np.uint64) ^ mixed(h2.view(np.uint64), 97))
        prints, counts, holders = (np.frombuffer(row[c], t) for c, t in (("fingerprints", np.uint64), ("counts", np.uint32), ("holders", np.int64)))
        known = (at >= 0) & (prints[at] == h2.view(np.uint64))
        gone = known & (counts[at] >= min_docs) & (holders[at] != ids)
        return pa.table({"id": ids[gone], "of": probes["of"].to_numpy()[gone], "h1": h1[gone]}, schema=fields)

    return run


def hashed(docs: DataFrame) -> DataFrame:
    """id, of (a hash of the text), h1, h2: the distinct line hashes of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests = [], []
            for text in common.raw(batch.column(2)):
                own = set(keys(text)) - {None}
                sizes.append(len(own))
                digests += own
            both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            rows = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            yield pa.RecordBatch.from_pydict(
                {"id": batch.column(0).take(rows), "of": batch.column(1).take(rows), "h1": pa.array(both[:, 0]), "h2": pa.array(both[:, 1])}
            )

    return docs.select(identity().alias("id"), text_hash().alias("of"), "text").mapInArrow(run, "id long, of long, h1 long, h2 long")


def identity() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def text_hash() -> Column:
    return F.xxhash64("text")


def dropped_hashes(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame | None:
    """id, of and the h1 of the lines that its documents lose; None if no line repeats often enough."""
    spark = docs.sparkSession
    lines, seen = hashed(docs), Observation()
    counted = lines.groupBy("h1", "h2").agg(F.count("*").alias("count"), F.max("id").alias("holder")).observe(seen, F.sum("count").alias("probes"))
    counts = common.written(counted.where(F.col("count") >= min_docs), "line-counts")
    n = counts.count()
    if not n:
        return None
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(parts, -(-n // SHARD_KEYS))
    least = max(SALTS, -(-seen.get["probes"] // (shards * GROUP_PROBES)))
    shard = F.pmod("h1", F.lit(shards)).alias("shard")
    index = common.written(counts.select(shard, "*").groupBy("shard").applyInArrow(built, INDEX), "line-index")
    salts = F.greatest(F.lit(least), F.ceil(F.col("most") / GROUP_PROBES)).cast("int")
    hot = common.written(index.select("shard", salts.alias("salts")).where(F.col("salts") > least), "line-hot-shards")
    probes = lines.select(shard, "*")
    probes = probes.join(common.small_side(hot), "shard", "left") if hot.head(1) else probes.withColumn("salts", F.lit(None).cast("int"))
    salt = F.pmod(F.xxhash64("id", "of", F.lit(5)), F.coalesce("salts", F.lit(least))).cast("long")
    probes = probes.select("shard", salt.alias("salt"), "id", "of", "h1", "h2")
    copies = index.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts.cast("long") - 1)))
    hits = probes.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInArrow(probed(min_docs), PROBE)
    return common.written(hits.groupBy("id", "of").agg(F.collect_set("h1").alias("gone")), "line-drops")


def deduplicated(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with kept_text, n_lines and n_dropped: every repeated line stays only with its last holder."""
    common.bounded_batches(docs.sparkSession)
    rows = docs.drop(*ADDED)
    drops = dropped_hashes(rows, min_docs)
    gone = common.free("gone", rows)
    if drops is None:
        joined = rows.withColumn(gone, F.lit(None).cast("array<long>"))
    else:
        id_, of = common.free("id_", rows), common.free("of_", rows)
        # Dealt by id at every size: the table of hashes grows with the input, so it is never broadcast.
        drops = drops.select(F.col("id").alias(id_), F.col("of").alias(of), F.col("gone").alias(gone)).hint("merge")
        joined = rows.join(drops, (identity() == F.col(id_)) & (text_hash() == F.col(of)), "left").drop(id_, of)
    at, n = joined.columns.index("text"), len(joined.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, lost = [], [], []
            for text, away in zip(common.raw(batch.column(at)), batch.column(n).to_pylist(), strict=True):
                lines = text.split(b"\n")
                counts.append(len(lines))
                if away:
                    away = set(away)
                    lines = [x for x, k in zip(lines, keys(text), strict=True) if k is None or int.from_bytes(k[:8], "little", signed=True) not in away]
                    text = b"\n".join(lines)
                texts.append(text)
                lost.append(counts[-1] - len(lines))
            made = [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(lost, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *made], names=[*batch.schema.names[:n], *ADDED])

    added = [StructField(c, t) for c, t in zip(ADDED, (StringType(), LongType(), LongType()), strict=True)]
    return joined.mapInArrow(run, StructType([*rows.schema.fields, *added]))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = deduplicated(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their kept lines, n_chars (if there is one) anew where lines went; a document that loses all its text goes."""
    row, none = common.free("row", docs), common.free("none", docs)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    kept = deduplicated(docs.select("doc_id", "text", F.struct(F.col("text").isNull().alias(none), *rest).alias(row)))
    kept = kept.where((F.col("n_dropped") == 0) | (F.length("kept_text") > 0))
    made = {c: F.col(row)[c] for c in rest} | {"doc_id": F.col("doc_id"), "text": F.when(~F.col(row)[none], F.col("kept_text"))}
    if "n_chars" in rest:
        made["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(made["n_chars"])
    return kept.select(*[made[c].alias(c) for c in docs.columns])


SQL = r"""
WITH l AS (SELECT rowid AS r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT r) >= 3),
m AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id IS DISTINCT FROM c.holder AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
