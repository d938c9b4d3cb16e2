"""Best documents of many keyword queries without scoring every posting.

Documents are dealt to shards of about SHARD by a hash of their paths and numbered there in the order of the paths, so their texts are dealt without a join; a shard keeps its
postings by term. A query's terms are taken from the highest bound of their part of a score down: a document that has only terms whose bounds sum up to less than a score that k
documents are known to reach can't be one of the best k, so the lists of these terms are only looked up for the documents found before.

Queries go to the shards in packs of HELD, each a row with a dictionary of its terms; a shard is one task, which holds the shard's postings, once, and one pack at a time. A shard
gives on no more than k documents for each query. The first of the shards, the square root of their number, are searched first: what they find is a score that a document
in the others has to reach. A window merges what all give on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators import inverted
from lorekeep.sources import store

SHARD, RANGE = 32_768, 32
#: A shard has fewer documents where they are few, to keep all tasks busy.
FEW = 1_024
#: Queries of a pack.
HELD = 4_096
#: Blocks are narrowed to the asked terms if these are at most so many; else all terms' blocks are dealt to their shards.
WANTED = 1 << 20
#: A list with one in so many documents of a shard is held as an array over all of them too.
DENSE = 8
#: Lists of a row of blocks, and of a pack.
POSTINGS, PACK = ("docs", "tf", "length"), ("words", "idf", "asks", "ends", "code", "floor")
#: Scores are ranked after rounding to so many places; ties go by path.
PLACES = 6
SLACK = 10.0**-PLACES
#: Below any score.
LEAST = np.finfo(float).tiny


class Ranked(NamedTuple):
    """places: path, shard, doc. blocks: shard, term, docs, tf, length (lists; see lists()). terms: term, df."""

    places: DataFrame
    blocks: DataFrame
    terms: DataFrame


def numbered(paths: DataFrame) -> DataFrame:
    """path, at: a number from the path alone."""
    return paths.select("path", F.xxhash64("path").alias("at"))


def size(rows: int, tasks: int) -> int:
    """Documents of a shard, about."""
    return min(SHARD, max(FEW, -(-rows // tasks)))


def places(of: DataFrame, shard: int = SHARD) -> DataFrame:
    """path, shard, doc from numbered(); doc grows with the path."""
    shards = max(1, -(-of.count() // shard))
    dealt = of.select("path", F.pmod("at", F.lit(shards)).cast("int").alias("shard"))
    return dealt.withColumn("doc", F.row_number().over(Window.partitionBy("shard").orderBy("path")) - 1)


def shards_of(placed: DataFrame) -> int:
    return (placed.agg(F.max("shard")).head()[0] or 0) + 1


def blocks(postings: DataFrame, placed: DataFrame) -> DataFrame:
    """shard, term, docs, tf, length (lists, sorted by docs) from postings. A row has the postings of one shard, at most SHARD. Of stored texts, text_blocks() makes the same without moving a row for each posting."""
    p = postings.join(placed, "path").select("shard", "term", F.struct("doc", F.col("tf").cast("int").alias("tf"), F.col("length").cast("int").alias("length")).alias("x"))
    each = p.groupBy("shard", "term").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return each.select("shard", "term", F.col("x.doc").alias("docs"), F.col("x.tf").alias("tf"), F.col("x.length").alias("length"))


def text_blocks(docs: DataFrame, text: Column, placed: DataFrame, stemmed: bool = False) -> DataFrame:
    """The same from documents (path), those of placed, and their words between single spaces; only texts are shuffled, once, to their shard's task, where their place in the order of paths is their number. A term has a row or more in a shard."""
    shards = shards_of(placed)
    dealt = docs.select("path", text.alias("text"), F.pmod(F.xxhash64("path"), F.lit(shards)).cast("int").alias("shard"))
    own = dealt.repartitionById(shards, "shard").sortWithinPartitions("path")  # a partition is a shard
    return inverted.blocks(own.withColumn("doc", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).cast("int")), F.col("text"), stemmed)


def terms(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def block_terms(made: DataFrame) -> DataFrame:
    """term, df from blocks: a document is in one row of a term only."""
    return made.groupBy("term").agg(F.sum(F.size("docs").cast("long")).alias("df"))


def postings(made: DataFrame, placed: DataFrame) -> DataFrame:
    """term, path, tf, length from blocks."""
    each = made.select("shard", "term", F.explode(F.arrays_zip("docs", "tf", "length")).alias("x")).select("shard", "term", F.col("x.docs").alias("doc"), F.col("x.tf").cast("long").alias("tf"), "x.length")
    return each.join(placed, ["shard", "doc"]).select("term", "path", "tf", "length")


def built(catalog: DataFrame, postings: DataFrame, shard: int = SHARD) -> Ranked:
    """Written in the shared folder, for postings that no stored index has."""
    p = store.written(postings, "postings")
    placed = store.written(places(numbered(catalog), shard), "places")
    return Ranked(placed, store.written(blocks(p, placed), "blocks"), store.written(terms(p), "terms"))


class List(NamedTuple):
    """A term's postings in a shard, as arrays; starts: where each block's postings begin, and the end."""

    ranges: np.ndarray
    most_tf: np.ndarray
    least_length: np.ndarray
    starts: np.ndarray
    docs: np.ndarray
    tf: np.ndarray
    length: np.ndarray


class Lists(Mapping[str, List]):
    """By term; a list is cut out of the shard's arrays when it is asked for."""

    def __init__(self, terms: list[str], at: np.ndarray, block: np.ndarray, blocks: tuple[np.ndarray, ...], postings: tuple[np.ndarray, ...]) -> None:
        self.number = {term: i for i, term in enumerate(terms)}
        self.at, self.block, self.blocks, self.postings = at, block, blocks, postings

    def __getitem__(self, term: str) -> List:
        i = self.number[term]
        a, b = self.at[i], self.at[i + 1]
        x, y = self.block[a], self.block[b]
        return List(*(c[a:b] for c in self.blocks), self.block[a : b + 1] - x, *(c[x:y] for c in self.postings))

    def __iter__(self) -> Iterator[str]:
        return iter(self.number)

    def __len__(self) -> int:
        return len(self.number)


def coded(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The distinct values of a column, and their number for each row."""
    x = column.combine_chunks()
    x = (pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x).dictionary_encode()
    return x.dictionary, x.indices.to_numpy()


def lists(table: pa.Table) -> Lists:
    """By term, from the rows of a shard; a term's rows hold different documents."""
    names, term = coded(table["term"])
    term = np.repeat(term, pc.list_value_length(table["docs"]).to_numpy())
    docs, tf, length = (pc.list_flatten(table[c]).to_numpy() for c in POSTINGS)
    del table
    order = np.lexsort((docs, term))
    docs, term, tf, length = docs[order], term[order], tf[order], length[order]
    del order
    ranges = docs // RANGE
    first = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(ranges, prepend=-1) != 0))
    most, least = np.maximum.reduceat(tf, first), np.minimum.reduceat(length, first)
    at = term[first].searchsorted(np.arange(len(names) + 1))
    return Lists(names.to_pylist(), at, np.append(first, len(docs)), (ranges[first], most, least), (docs, tf, length))


class Weights(NamedTuple):
    average: float
    k1: float
    b: float

    def of(self, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        """A posting's part of the score without its term's own weight; grows with tf, falls with length."""
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length / self.average))


class Part(NamedTuple):
    """What a term adds to the scores of a shard's documents; row: the same over all documents, if the term is in many."""

    docs: np.ndarray
    scores: np.ndarray
    most: float
    row: np.ndarray | None

    def at(self, docs: np.ndarray) -> np.ndarray:
        if self.row is not None:
            return self.row[docs]
        i = np.minimum(self.docs.searchsorted(docs), len(self.docs) - 1)
        return np.where(self.docs[i] == docs, self.scores[i], 0.0)


class Shard:
    """Searches a shard's lists; what a term adds is worked out when it is first asked for, with the term's one weight."""

    def __init__(self, of: Mapping[str, List], weights: Weights, documents: int) -> None:
        self.of, self.weights = of, weights
        self.parts: dict[str, Part | None] = {}
        self.sums = np.zeros(documents)

    def part(self, term: str, idf: float) -> Part | None:
        if term not in self.parts:
            x, made = self.of.get(term), None
            if x is not None:
                docs, scores, row = x.docs.astype(np.int32, copy=False), idf * self.weights.of(x.tf, x.length), None
                if len(docs) * DENSE >= len(self.sums):
                    row = np.zeros(len(self.sums))
                    row[docs] = scores
                made = Part(docs, scores, float(scores.max()), row)
            self.parts[term] = made
        return self.parts[term]

    def best(self, parts: list[Part], k: int, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents and scores of the best k for the parts of a query's terms, ties by number, and how many postings were read. floor: a score that k documents anywhere are known to reach; those below it may be left out."""
        parts = sorted(parts, key=lambda p: -p.most)
        rest = [0.0] * (len(parts) + 1)  # what the terms from here on can add
        for i in range(len(parts) - 1, -1, -1):
            rest[i] = rest[i + 1] + parts[i].most
        least, seeded, read = floor - SLACK, 0, 0
        if rest[0] < max(least, LEAST):
            return np.empty(0, np.int32), np.empty(0), 0
        if floor <= 0:  # the first lists with k documents, each scored in whole, give a floor
            docs, seeded = parts[0].docs, 1
            while len(docs) < k and seeded < len(parts):
                docs, seeded = np.union1d(docs, parts[seeded].docs), seeded + 1
            whole = seeded == 1
            found = parts[0].scores.copy() if whole else np.zeros(len(docs))
            for p in parts[whole:]:
                found += p.at(docs)
            read += len(docs) * (len(parts) if whole else len(parts) + seeded)
            least = np.partition(found, -k)[-k] - SLACK if len(found) >= k else least
        needed = next((i for i in range(len(parts)) if rest[i] < least), len(parts))
        if needed > seeded:
            docs, found, more = self.united(parts, needed, least, rest)
            read += more
        kept = found >= least if len(found) <= 4 * k else found >= max(least, np.partition(found, -k)[-k] - SLACK)
        docs, found = docs[kept], found[kept]
        order = np.lexsort((docs, -np.round(found, PLACES)))[:k]
        return docs[order], found[order], read

    def united(self, parts: list[Part], needed: int, least: float, rest: list[float]) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents that have one of the needed terms and can reach the least score, with their scores."""
        lists, low, sums = parts[:needed], max(least - rest[needed], LEAST), self.sums
        if any(p.row is not None for p in lists):
            for p in lists:
                if p.row is None:
                    sums[p.docs] += p.scores
                else:
                    sums += p.row
            docs = np.flatnonzero(sums >= low).astype(np.int32)
            found = sums[docs]
            sums.fill(0)
        else:
            for p in lists:
                sums[p.docs] += p.scores
            every = np.concatenate([p.docs for p in lists])
            docs = np.sort(every[sums[every] >= low])
            docs = docs[np.diff(docs, prepend=-1) > 0]
            found = sums[docs]
            sums[every] = 0
        read = sum(len(p.docs) for p in lists)
        for p, more in zip(parts[needed:], rest[needed + 1 :], strict=True):
            found += p.at(docs)
            read += len(docs)
            kept = found >= least - more
            docs, found = docs[kept], found[kept]
        return docs, found, read


def best(asked: list[tuple[str, float]], of: Mapping[str, List], weights: Weights, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents and scores of the best k of a shard for terms with their weights, ties by number; and how many postings were read."""
    shard = Shard(of, weights, max((int(of[term].docs[-1]) + 1 for term, _ in asked if term in of), default=0))
    return shard.best([p for term, idf in asked if (p := shard.part(term, idf))], k)


def packed(weighed: DataFrame, packs: int) -> DataFrame:
    """pack, asking (one struct in a list) from query, term, idf, floor: a row for each pack of queries; code: the words of its queries one after another, each query's up to its end."""
    kind = weighed.schema["query"].dataType.simpleString()
    ddl = f"pack int, asking array<struct<words: array<string>, idf: array<double>, asks: array<{kind}>, ends: array<int>, code: array<int>, floor: array<double>>>"

    def pack(rows: pa.Table) -> pa.Table:
        (words, word), (asks, ask) = coded(rows["term"]), coded(rows["query"])
        idf, floor = np.zeros(len(words)), np.zeros(len(asks))
        idf[word], floor[ask] = rows["idf"].to_numpy(), rows["floor"].to_numpy()
        ends = np.bincount(ask).cumsum()
        columns = [words, pa.array(idf), asks, inverted.ints(ends), inverted.ints(word[np.argsort(ask, kind="stable")]), pa.array(floor)]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
        one = pa.ListArray.from_arrays(pa.array([0, 1], pa.int32()), pa.StructArray.from_arrays(lists, PACK))
        return pa.table([rows["pack"].slice(0, 1), one], names=["pack", "asking"])

    dealt = weighed.select(F.pmod(F.xxhash64("query"), F.lit(packs)).cast("int").alias("pack"), "query", "term", "idf", "floor")
    return dealt.groupBy("pack").applyInArrow(pack, ddl)


FOUND = pa.schema([("shard", pa.int32()), ("doc", pa.int32()), ("score", pa.float64()), ("read", pa.int64())])


def answered(shard: Shard, number: int, pack: dict[str, Any], k: int) -> pa.RecordBatch:
    """query, shard, doc, score, read of a pack's queries in a shard."""
    parts = [shard.part(w, f) for w, f in zip(pack["words"].to_pylist(), pack["idf"].to_pylist(), strict=True)]
    code, ends, out, begin = pack["code"].to_pylist(), pack["ends"].to_pylist(), [], 0
    for end, floor in zip(ends, pack["floor"].to_pylist(), strict=True):
        out.append(shard.best([p for c in code[begin:end] if (p := parts[c]) is not None], k, floor))
        begin = end
    sizes = [len(docs) for docs, _, _ in out]
    of = np.repeat(np.arange(len(out)), sizes)
    docs, scores = (np.concatenate([x[i] for x in out]) for i in (0, 1))
    columns = [np.full(len(docs), number), docs, scores, np.array([x[2] for x in out])[of]]
    arrays = [pack["asks"].take(pa.array(of)), *(pa.array(c).cast(f.type) for c, f in zip(columns, FOUND, strict=True))]
    return pa.RecordBatch.from_arrays(arrays, names=["query", *FOUND.names])


def searched(blocks: DataFrame, packs: DataFrame, first: int, end: int, weights: Weights, k: int, documents: int) -> DataFrame:
    """query, shard, doc, score, read of the shards from first up to end: a shard's blocks come to its task before the packs, which are taken one at a time."""
    kind = packs.schema["asking"].dataType.elementType["asks"].dataType.elementType.simpleString()
    none = lambda of, *names: [F.array().cast(of.schema[c].dataType).alias(c) for c in names]  # noqa: E731  Arrow's lists take a null slower than an empty one
    shards = F.explode(F.sequence(F.lit(first), F.lit(end - 1))).alias("shard")
    own = blocks.where(F.col("shard").between(first, end - 1)).select("shard", F.lit(-1).alias("pack"), "term", *POSTINGS, *none(packs, "asking"))
    rows = own.union(packs.select(shards, "pack", F.lit("").alias("term"), *none(blocks, *POSTINGS), "asking"))
    dealt = rows.repartitionById(end - first, F.col("shard") - first).sortWithinPartitions("shard", "pack")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, shard = None, [], None
        for batch in batches:
            number, pack = batch["shard"].to_numpy(), batch["pack"].to_numpy()
            cuts = np.flatnonzero((np.diff(number, prepend=-1) != 0) | (np.diff(pack, prepend=-2) != 0))
            for a, b in zip(cuts, np.append(cuts[1:], len(batch)), strict=True):
                if number[a] != at:
                    at, held, shard = number[a], [], None
                if pack[a] < 0:
                    held.append(batch.slice(a, b - a).select(["term", *POSTINGS]))
                    continue
                if shard is None:
                    rows, held = pa.Table.from_batches(held) if held else None, []
                    shard, rows = Shard(lists(rows) if rows else {}, weights, documents), None
                asking = batch["asking"][a].values
                yield answered(shard, at, {c: asking.field(c)[0].values for c in PACK}, k)

    return dealt.mapInArrow(run, f"query {kind}, shard int, doc int, score double, read long")


def topk(ranked: Ranked, asked: DataFrame, statistics: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query, shard, doc, score, read: of each shard no more than the best k for each row of asked (query, term), the best k of all among them, with how many postings that query's search of the shard read.

    Statistics is one row of n and avg. Terms in more than half of all documents weigh almost nothing.
    """
    asked = store.written(asked.select("query", "term"), "asked")
    wanted = asked.select("term").distinct()
    few = wanted.limit(WANTED + 1).count() <= WANTED
    known = ranked.terms.join(F.broadcast(wanted), "term", "left_semi") if few else ranked.terms
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weighed = asked.join(known, "term").crossJoin(F.broadcast(statistics)).select("query", "term", idf.alias("idf"))  # one row
    weighed = store.written(weighed, "weighed")
    count = weighed.select("query").distinct().count()
    extent = ranked.places.agg(F.max("shard"), F.max("doc")).head()
    kind = asked.schema["query"].dataType.simpleString()
    if extent[0] is None or not count:
        return asked.sparkSession.createDataFrame([], f"query {kind}, shard int, doc int, score double, read long")
    shards, documents, packs = extent[0] + 1, extent[1] + 1, -(-count // HELD)
    weights = Weights(statistics.head()["avg"], k1, b)
    blocks = ranked.blocks.join(F.broadcast(wanted), "term", "left_semi") if few else ranked.blocks
    search = lambda of, first, end: searched(blocks, packed(of, packs), first, end, weights, k, documents)
    first = math.isqrt(shards) if packs > 1 else 0
    if not first:
        return search(weighed.withColumn("floor", F.lit(0.0)), 0, shards)
    early = store.written(highest(search(weighed.withColumn("floor", F.lit(0.0)), 0, first), k), "early")
    floors = early.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k).select("query", "floor")
    return early.unionByName(search(weighed.join(floors, "query", "left").fillna(0.0, ["floor"]), first, shards))


def highest(found: DataFrame, k: int) -> DataFrame:
    """Of each query the k highest scores, with their ties."""
    w = Window.partitionBy("query").orderBy(F.round("score", PLACES).desc())
    return found.withColumn("rank", F.rank().over(w)).where(F.col("rank") <= k).drop("rank")


def merged(found: DataFrame, ranked: Ranked, k: int) -> DataFrame:
    """query, path, score, rank of the best k over all shards, ties by path."""
    top = highest(found, k).join(ranked.places, ["shard", "doc"])
    w = Window.partitionBy("query").orderBy(F.round("score", PLACES).desc(), "path")
    return top.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "path", "score", "rank")
