"""SimHash near-dedup by a Gray-order hierarchical index.

A fingerprint has 64 bits, each set if it is set in over half of the text's shingle hashes. Equal fingerprints are one
node. Two fingerprints that differ in at most d bits agree in all of m - d out of m blocks of bits, for some choice of
blocks; every fingerprint goes to a bucket for each choice, and within a bucket

* fingerprints are sorted by Gray rank, so neighbours differ in few bits;
* runs of neighbours form groups, runs of groups upper nodes; a node holds the masked bit pattern that all below it share;
* pairs of nodes are compared from the top: differences are accumulated over the bits that become shared, a pair of
  groups is pruned as a whole once these exceed d, and taken as a whole if no remaining bits could exceed it.

The search is exact. m is the smallest number of blocks that keeps buckets of random fingerprints small, by the number of fingerprints.
A bucket above LARGE rows is cut into parts, and each pair of parts is a bucket, so no task holds an unbounded group. A
bucket reports a forest of its linked fingerprints, not their pairs; components over all buckets follow.

Near copies at a shingle resemblance of 0.8 differ in some 15 % of their bits, too many of 64 for blocks that must agree. The
stage of a pipeline therefore takes WIDE words of 64 bits, buckets by runs of bits dealt over pairs of words and links by the difference over all
words; the number of runs sets how many of the pairs at 0.8 meet (99 %, one standard deviation below their mean; more above), at every number of
documents. These links make groups of candidates only: within a group sets of shingles are compared, and a document goes if its resemblance to
one that stays is 0.8 or more, by doc_id: the smallest of all that are alike stays. A group of up to PART distinct sets is one step; a larger one goes in
rounds, each against its LEADERS undecided sets of smallest doc_id, until all are decided, which gives the same. So the work in a group is its size times
the number of its sets that stay.

Defined cases: null or empty text, or no words: fingerprint zero, linked like any other; null doc_id: gets its
fingerprint's component and links nothing; repeated doc_id or rows: one node if their texts are equal, else linked only by their texts; very long
texts: read in pieces; extra columns stay; empty table: empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .components import components

BITS, DIFFER = 64, 4
#: Words of a wide fingerprint, and bits of these that candidates differ in at most: 15.1 % of 1,024 are expected at a resemblance of 0.8, with a
#: standard deviation of 11.5 bits; three of these are added.
WIDE, WIDE_DIFFER = 16, 190
#: Distinct sets of a group that one task compares, and sets of a larger group that a round compares the others with.
PART, LEADERS = 256, 64
#: Rows of a bucket before it is cut, children of a node, and rows that a task works on at once.
LARGE, FAN, AT_ONCE = 1024, 8, 1 << 16
#: Mean number of random fingerprints in a bucket at most.
BUCKET = 64


def scrambled(h: np.ndarray, word: int) -> np.ndarray:
    """Hashes for each further word of a fingerprint; the first takes them as they are."""
    if not word:
        return h
    with np.errstate(over="ignore"):
        h = (h ^ np.uint64(word * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 255 * 128):
        bits = np.unpackbits(h[at : at + 255 * 128].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = len(bits) // 255 * 255
        ones += bits[:full].reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[full:].sum(axis=0, dtype=np.uint8)
    return ones


def fingerprint(text: bytes, shingle: int, width: int = 1) -> list[int]:
    """Signed 64-bit integers, one for each word of the fingerprint."""
    total, ones = 0, np.zeros((width, BITS), np.int64)
    for hashes in common.shingle_hashes(text, shingle):
        for word in range(width):
            ones[word] += bit_counts(scrambled(hashes, word))
        total += len(hashes)
    return np.packbits(2 * ones > total, axis=1, bitorder="little").view(np.int64).ravel().tolist()


def names(width: int) -> list[str]:
    return [f"s{i}" for i in range(width)]


def fingerprinted(docs: DataFrame, shingle: int, width: int = 1) -> DataFrame:
    """doc_id and the fingerprint's words s0, s1, ...; one narrow stage."""
    common.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t, shingle, width) for t in common.raw(batch.column(1))], np.int64).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(made[:, i]) for i in range(width))], names=["doc_id", *names(width)])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in names(width)))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each value in the order of the Gray code."""
    r = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def blocks(m: int) -> list[int]:
    """The 64 bits as m masks of neighbouring bits."""
    sizes = [BITS // m + (i < BITS % m) for i in range(m)]
    return [((1 << s) - 1) << int(a) for s, a in zip(sizes, np.cumsum([0, *sizes]), strict=False)]


#: Bits that must agree, as masks of words of the fingerprint.
Choice = list[tuple[int, int]]


def exact_choices(n: int, differ: int = DIFFER) -> list[Choice]:
    """Bits of word 0 that must agree, for n fingerprints: pairs within `differ` agree on at least one choice."""
    for m in range(differ + 1, 17):
        if n / 2.0 ** ((BITS // m) * (m - differ)) <= BUCKET:
            break
    return [[(0, sum(c))] for c in combinations(blocks(m), m - differ)]


def wide_choices(n: int, missed: float = 0.01, agree: float = 0.84, seed: int = 7) -> list[Choice]:
    """Runs of bits, dealt within pairs of words, so many that all but `missed` of the pairs whose bits agree with probability `agree` share one.

    A run has 13 bits, more as n grows so that buckets stay small; then there are more runs, so the share that meets doesn't depend on n.
    """
    bits = max(13, int(np.ceil(np.log2(max(n, 1) / (16 * BUCKET)))))
    count = int(np.ceil(np.log(missed) / np.log1p(-(agree**bits))))
    draw, out = np.random.default_rng(seed), []
    while len(out) < count:
        dealt = [draw.permutation(2 * BITS) for _ in range(WIDE // 2)]
        for at in range(0, 2 * BITS - bits + 1, bits):
            for pair, order in enumerate(dealt):
                run = [int(x) for x in order[at : at + bits]]
                masks = [(2 * pair + side, sum(1 << (x % BITS) for x in run if x // BITS == side)) for side in (0, 1)]
                out.append([(word, mask) for word, mask in masks if mask])
    return out[:count]


def levels(values: np.ndarray, bucket: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """From single fingerprints up: (shared mask, pattern, first child, end of children) of each node; no node spans two buckets. values (a row of words each) are in Gray order within their bucket."""
    n = len(values)
    out = [(np.full_like(values, ~np.uint64(0)), values, np.arange(n), np.arange(n) + 1)]
    owner = bucket
    while True:
        mask, pattern, _, _ = out[-1]
        first_of = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        if len(first_of) == len(owner):
            return out
        place = np.arange(len(owner)) - np.repeat(first_of, np.diff(np.r_[first_of, len(owner)]))
        starts = np.flatnonzero(place % FAN == 0)
        every = np.bitwise_and.reduceat(pattern & mask, starts, axis=0)
        some = np.bitwise_or.reduceat(pattern & mask, starts, axis=0)
        shared = np.bitwise_and.reduceat(mask, starts, axis=0) & ~(every ^ some)
        out.append((shared, every & shared, starts, np.r_[starts[1:], len(owner)]))
        owner = owner[starts]


def count_bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=1, dtype=np.int64)


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item its number repeated counts times, and 0, 1, ... within each."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


def linked(values: np.ndarray, bucket: np.ndarray, differ: int) -> np.ndarray:
    """Smallest index that each value reaches by links within its bucket."""
    tree = levels(values, bucket)
    roots = np.arange(len(values))

    def union(a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = roots[a], roots[b]
            low, high = np.minimum(x, y), np.maximum(x, y)
            open_ = low != high
            if not open_.any():
                return
            a, b = a[open_], b[open_]
            np.minimum.at(roots, high[open_], low[open_])
            while True:
                up = roots[roots]
                if (up == roots).all():
                    break
                roots[:] = up

    def search(level: int, a: np.ndarray, b: np.ndarray, seen: np.ndarray, acc: np.ndarray) -> None:
        """Pairs of nodes, bits compared so far and differences among them."""
        size = AT_ONCE // values.shape[1]
        for at in range(0, len(a), size):
            step(level, *(x[at : at + size] for x in (a, b, seen, acc)))

    def step(level: int, a: np.ndarray, b: np.ndarray, seen: np.ndarray, acc: np.ndarray) -> None:
        mask, pattern, _, _ = tree[level]
        new = mask[a] & mask[b] & ~seen
        acc = acc + count_bits((pattern[a] ^ pattern[b]) & new)
        near = acc <= differ
        a, b, seen, acc = a[near], b[near], (seen | new)[near], acc[near]
        if level == 0:
            apart = a != b
            union(a[apart], b[apart])
            return
        whole = acc + count_bits(~seen) <= differ
        if whole.any():
            for x, y in zip(*(x[whole] for x in (a, b)), strict=True):
                below = np.r_[under(level, x), under(level, y)]
                union(below, np.full(len(below), below[0]))
            a, b, seen, acc = a[~whole], b[~whole], seen[~whole], acc[~whole]
        _, _, first, end = tree[level]
        na, nb = end[a] - first[a], end[b] - first[b]
        which, nth = spread(na * nb)
        x, y = first[a][which] + nth // nb[which], first[b][which] + nth % nb[which]
        once = x <= y
        search(level - 1, x[once], y[once], seen[which][once], acc[which][once])

    def under(level: int, node: int) -> np.ndarray:
        low, high = node, node + 1
        for at in range(level, 0, -1):
            low, high = tree[at][2][low], tree[at][3][high - 1]
        return np.arange(low, high)

    top = len(tree) - 1
    every = np.arange(len(tree[top][0]))
    search(top, every, every, np.zeros((len(every), values.shape[1]), np.uint64), np.zeros(len(every), np.int64))
    return roots


def agreeing(choice: Choice) -> F.Column:
    """The choice's bits, or a hash of them if they stand in two words: equal for fingerprints that agree on them; what differs is told apart later."""
    kept = [F.col(f"s{w}").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long")) for w, m in choice]
    return kept[0] if len(kept) == 1 else F.xxhash64(*kept)


def forest(nodes: DataFrame, choices: list[Choice], differ: int, width: int = 1) -> DataFrame:
    """Links a, b between ids of nodes (id, s0, ...; distinct fingerprints) that join all fingerprints which share a choice's bits and differ in at most `differ` bits, directly or by others of the same bucket."""
    words = names(width)
    picks = F.array(*[F.struct(F.lit(i).alias("choice"), agreeing(c).alias("key")) for i, c in enumerate(choices)])
    keyed = nodes.select("id", *words, F.explode(picks).alias("x")).select("x.choice", "x.key", "id", *words)
    sizes = common.written(keyed.groupBy("choice", "key").agg(F.count("*").alias("n")).where(F.col("n") > LARGE), "simhash-large")
    half = LARGE // 2
    if large := sizes.count():
        parts = F.ceil(F.col("n") / half).cast("int")
        keyed = keyed.join(common.small_side(sizes, large), ["choice", "key"], "left").withColumn("parts", F.coalesce(parts, F.lit(1)))
        own = F.pmod(F.xxhash64(*words, F.lit(3)), F.col("parts")).cast("int")
        pairs = F.transform(
            F.sequence(F.lit(0), F.col("parts") - 1),
            lambda j: F.struct(F.least(F.col("own"), j).alias("i"), F.greatest(F.col("own"), j).alias("j")),
        )
        keyed = keyed.withColumn("own", own).withColumn("pair", F.explode(pairs)).select("choice", "key", "pair.i", "pair.j", "id", *words)
    else:
        keyed = keyed.select("choice", "key", F.lit(0).alias("i"), F.lit(0).alias("j"), "id", *words)
    place = ["choice", "key", "i", "j"]
    dealt = keyed.repartition(*place).sortWithinPartitions(*place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray = np.empty((0, 5 + width), np.int64)

        def search(rows: np.ndarray) -> pa.RecordBatch:
            bucket = np.cumsum(np.r_[True, (rows[1:, :4] != rows[:-1, :4]).any(axis=1)])
            many = np.bincount(bucket)[bucket] > 1
            rows, bucket = rows[many], bucket[many]
            values = np.ascontiguousarray(rows[:, 5:]).view(np.uint64)
            order = np.lexsort((*(gray_rank(values[:, i]) for i in reversed(range(width))), bucket))
            rows, bucket, values = rows[order], bucket[order], values[order]
            roots = linked(values, bucket, differ) if len(rows) else np.empty(0, np.int64)
            far = roots != np.arange(len(roots))
            return pa.RecordBatch.from_pydict({"a": pa.array(rows[far, 4]), "b": pa.array(rows[roots[far], 4])})

        for batch in batches:
            rows = np.stack([c.cast(pa.int64()).to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            held = np.concatenate([held, rows])
            if len(held) >= AT_ONCE // 4:
                other = (held[:, :4] != held[-1, :4]).any(axis=1)
                if other.any():
                    end = int(np.flatnonzero(other)[-1]) + 1
                    yield search(held[:end])
                    held = held[end:]
        if len(held):
            yield search(held)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def grouped(docs: DataFrame, shingle: int, width: int = 1, differ: int = DIFFER) -> DataFrame:
    """doc_id, the fingerprint's words, and component_id: the smallest doc_id that each document reaches by links."""
    words = names(width)
    marked = common.written(fingerprinted(docs, shingle, width), "simhash")
    nodes = common.written(marked.groupBy(*words).agg(F.min("doc_id").alias("id")), "simhash-nodes")
    known = nodes.where(F.col("id").isNotNull())
    n = known.count()
    found = components(forest(known, exact_choices(n, differ) if width == 1 else wide_choices(n), differ, width))
    of = nodes.join(found, "id", "left").select(*words, F.coalesce("component", "id").alias("component_id"))
    return marked.join(of, words).select("doc_id", *words, "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = grouped(common.table(spark, sf_dir, "documents"), shingle=4)
    return made.select("doc_id", F.lower(F.lpad(F.hex("s0"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: bytes, shingle: int = 5) -> np.ndarray:
    """Distinct shingle hashes in ascending order."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *common.shingle_hashes(text, shingle)]))


def set_name(hashes: np.ndarray) -> int:
    """A signed 64-bit hash of a set; it tells apart sets with one fingerprint or doc_id."""
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), common.SEED)).view(np.int64)))


def with_sets(docs: DataFrame, keep: bool) -> DataFrame:
    """doc_id, wide fingerprint and the set's name; or (keep) doc_id, name and the set itself. One narrow stage."""
    common.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = common.raw(batch.column(1))
            sets = [shingle_set(t) for t in texts]
            named = pa.array([set_name(x) for x in sets], pa.int64())
            ids = batch.column(0).cast(pa.int64())
            if keep:
                yield pa.RecordBatch.from_arrays([ids, named, pa.array([x.tobytes() for x in sets], pa.binary())], names=["doc_id", "name", "hashes"])
            else:
                made = np.array([fingerprint(t, 5, WIDE) for t in texts], np.int64).reshape(-1, WIDE)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(made[:, i]) for i in range(WIDE)), named], names=["doc_id", *names(WIDE), "name"])

    made = "doc_id long, name long, hashes binary" if keep else "doc_id long, " + ", ".join(f"{c} long" for c in names(WIDE)) + ", name long"
    return docs.select("doc_id", "text").mapInArrow(run, made)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the resemblance of two sets is 0.8 or more."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def decided(sets: DataFrame) -> DataFrame:
    """id and name of the sets of each group (grp, id, name, hashes) that go: by id and name, a set stays unless it is alike one of its group before it that stays."""
    left, gone = sets, []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, stay, leaders, out = None, [], {}, []
        for batch in batches:
            for grp, part, parts, lead, i, name, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (grp, part) != place:
                    place, stay, leaders = (grp, part), [], {}
                h = np.frombuffer(h, np.uint64)
                if parts > 1 and not lead:
                    state = leaders.get((i, name))
                    out.append((i, name, state if state is not None else 2 if any(alike(h, x) for x in stay) else 0))
                    continue
                state = leaders.get((i, name))
                if state is None:
                    state = leaders[i, name] = 2 if any(alike(h, x) for x in stay) else 1
                    if state == 1:
                        stay.append(h)
                if parts == 1:
                    out.append((i, name, state))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["id", "name", "state"])
                out = []

    while True:
        sizes = common.written(left.groupBy("grp").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")), "near-copy-groups")
        spread = left.join(common.small_side(sizes), "grp").withColumn("part", F.pmod(F.xxhash64("id", "name", F.lit(3)), F.col("parts")).cast("int"))
        rows = spread.withColumn("lead", F.lit(False))
        if large := sizes.where("parts > 1").count():
            # All sets before these are decided, so their own order decides them. Partitions pass on their first ones only.
            w = Window.partitionBy("grp").orderBy("id", "name")
            within = left.select("grp", "id", "name").join(common.small_side(sizes.where("parts > 1"), large), "grp")
            picked = within.distinct().withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= LEADERS).drop("nth")
            picked = common.written(picked, "near-copy-leaders")
            lead = left.join(common.small_side(picked), ["grp", "id", "name"]).withColumn(
                "part",
                F.explode(F.sequence(F.lit(0), F.col("parts") - 1)),
            ).withColumn("lead", F.lit(True))
            rows = rows.unionByName(lead)
        dealt = rows.select(
            "grp",
            "part",
            "parts",
            "lead",
            "id",
            "name",
            "hashes",
        ).repartition("grp", "part").sortWithinPartitions("grp", "part", F.col("lead").desc(), "id", "name")
        made = common.written(dealt.mapInArrow(run, "id long, name long, state long"), "near-copy-states")
        gone.append(made.where("state = 2").select("id", "name"))
        if not large:
            break
        left = common.written(left.join(made.where("state = 0").select("id", "name").distinct(), ["id", "name"], "left_semi"), "near-copies-left")
    return gone[0] if len(gone) == 1 else common.written(functools.reduce(DataFrame.unionByName, gone), "near-copy-sets-gone")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles resemble each other by 0.8 or more one stays, the smallest doc_id; rows of one doc_id stay together, as do rows without an id."""
    words = names(WIDE)
    marked = common.written(with_sets(docs, keep=False), "simhash")
    nodes = common.written(marked.groupBy(*words).agg(F.min("doc_id").alias("id")), "simhash-nodes")
    known = nodes.where(F.col("id").isNotNull())
    n = known.count()
    found = components(forest(known, wide_choices(n), WIDE_DIFFER, WIDE))
    of = known.join(found, "id", "left").select(*words, F.coalesce("component", "id").alias("grp"))
    first = marked.where(F.col("doc_id").isNotNull()).groupBy(*words, "name").agg(F.min("doc_id").alias("id"))
    rows = common.written(marked.join(first, [*words, "name"]).join(of, words).select("doc_id", "grp", "id", "name"), "near-copy-rows")
    items = rows.where("doc_id = id").select("grp", "id", "name").distinct()
    several = rows.groupBy("grp").agg(
        F.min(F.struct("id", "name")).alias("low"),
        F.max(F.struct("id", "name")).alias("high"),
    ).where("low <> high").select("grp")
    asked = common.written(items.join(common.small_side(common.written(several, "near-copy-several")), "grp"), "near-copy-items")
    # Texts of candidates are dealt by id at every size, as their number grows with the input.
    texts = docs.join(asked.select(F.col("id").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")
    sets = with_sets(texts, keep=True).withColumnRenamed("doc_id", "id").join(common.small_side(asked), ["id", "name"])
    gone = decided(common.written(sets, "near-copy-sets"))
    states = rows.join(common.small_side(gone.distinct().withColumn("gone", F.lit(True))), ["id", "name"], "left")
    goes = states.groupBy("doc_id").agg(F.min(F.coalesce("gone", F.lit(False)) | (F.col("doc_id") != F.col("id"))).alias("goes"))
    away = common.written(goes.where("goes").select("doc_id"), "near-copies")
    return docs.join(common.small_side(away), "doc_id", "left_anti").select(*docs.columns)
