"""Merkle dataset manifest: a content-addressed graph of digests over all documents, proofs by descent, and verification.

A document's leaf is the digest of its fields. The leaves of a source, by doc_id, make a tree of runs of three; the sources' roots make another, whose root names
the data set. The graph is stored as records, digest to children, in segments of DEPTH levels: a block of at most FANOUT ** DEPTH neighbouring nodes is
raised in one task, the blocks' tops are the nodes of the next segment. Requests descend from the root: the digits of a rank pick a child at each record, the children not
picked are collected, and a segment hands the path that it found to all requests below it, so the upper levels are walked once for each block, not once for each
document. At the leaf the path is reversed: siblings from the leaf up to the root.

Ranks come from ranges of (source, doc_id): each range is sorted and numbered where it lies, and a row for each range and source says what stands before. So a source that
holds a third of all rows is many ranges and many blocks. Texts are read once, by built-in functions; after that a row has its digests only.

Defined cases: null in any field: '-'; null source: before all others, apart from ''; null doc_id: first in its source, never tampered with; ties of doc_id in a source: by
leaf, so equal rows may change places; repeated rows are leaves of their own and share their records; a source with one leaf: the leaf is its root, without a record; one source: its
root is the data set's; very long texts: one at a time; extra columns don't matter; empty table: empty result.
"""

from __future__ import annotations

import functools
import hashlib
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Children of a node, and levels of a segment.
FANOUT, DEPTH = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The number of the tree over the sources' roots; sources are numbered from 1.
TOP = 0

PATH = pa.list_(pa.struct([("digit", pa.int32()), ("siblings", pa.list_(pa.string()))]))
RECORDS = pa.schema([("tree", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("digest", pa.string()), ("children", pa.list_(pa.string())), ("top", pa.bool_())])
REACHED = pa.schema([("tree", pa.int64()), ("block", pa.int64()), ("digest", pa.string()), ("path", PATH), ("subroot", pa.string()), ("root", pa.string())])
PROOFS = pa.schema([("doc_id", pa.int64()), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())])
DDL = {
    RECORDS: "tree long, block long, n long, digest string, children array<string>, top boolean",
    REACHED: "tree long, block long, digest string, path array<struct<digit: int, siblings: array<string>>>, subroot string, root string",
    PROOFS: "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
}


def digest_of(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(**changed: Column) -> Column:
    """Digest of a document's fields, each as its number of bytes and its value."""
    def field(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[field(changed.get(c, F.col(c))) for c in FIELDS]).cast("binary"), 256)


def tampered_leaf() -> Column:
    """The leaf after a change that only deletes line ends, in documents whose number has an even checksum; null where nothing changes."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(chosen & F.col("text").contains("\n"), leaf(text=F.replace("text", F.lit("\n"), F.lit(""))))


class Leaves(NamedTuple):
    rows: DataFrame  # tree, rank (from 0), n (leaves of the tree), doc_id, leaf, tampered
    sources: DataFrame  # source, tree, n


def ranked(docs: DataFrame) -> Leaves:
    made = common.written(docs.select("doc_id", "source", leaf().alias("leaf"), tampered_leaf().alias("tampered")), "merkle-leaves")
    order = ("source", "doc_id", "leaf")
    at = F.monotonically_increasing_id()  # within a sorted range: one more for each row
    dealt = made.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", at).withColumn("range", F.shiftright("at", 33))
    dealt = common.written(dealt, "merkle-ranges")
    spans = dealt.groupBy("source", "range").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    spans = common.written(spans.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))), "merkle-spans")
    sources = common.numbered(spans.groupBy("source").agg(F.sum("rows").alias("n")), [F.col("source").asc_nulls_first()], nth="tree")
    sources = common.written(sources.select("source", F.col("tree").cast("long").alias("tree"), "n"), "merkle-sources")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    placed = spans.join(common.small_side(sources), same(spans, sources)).select(spans["source"], "range", "first", "before", "tree", "n")
    rows = dealt.join(common.small_side(placed), same(dealt, placed) & (dealt["range"] == placed["range"]))
    return Leaves(rows.select("tree", (F.col("before") + F.col("at") - F.col("first")).alias("rank"), "n", "doc_id", "leaf", "tampered"), sources)


def levels(n: int, most: int) -> int:
    """Levels of a block, if its tree has n nodes in this segment of at most so many levels."""
    depth = 0
    while depth < most and FANOUT**depth < n:
        depth += 1
    return depth


def raised(table: pa.Table, depth: int) -> pa.Table:
    """Records of a block, from its nodes tree, block, rank, n, digest; and its top."""
    table = table.sort_by("rank")
    tree, block, n = (table[c][0].as_py() for c in ("tree", "block", "n"))
    nodes, records = table["digest"].to_pylist(), {}
    for _ in range(levels(n, depth)):
        runs = [nodes[i : i + FANOUT] for i in range(0, len(nodes), FANOUT)]
        nodes = [digest_of(run) for run in runs]
        records |= zip(nodes, runs, strict=True)
    k = len(records)
    columns = [[tree] * (k + 1), [block] * (k + 1), [n] * (k + 1), [*records, nodes[0]], [*records.values(), None], [False] * k + [True]]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, RECORDS, strict=True)], schema=RECORDS)


class Graph(NamedTuple):
    """Stored records of trees, by segment from the leaves up. A block's top is a node of the next segment or, if its tree has no more nodes than a block, the tree's top."""

    segments: list[DataFrame]
    depth: int

    @property
    def block(self) -> int:
        return FANOUT**self.depth

    def block_of(self, rank: str) -> Column:
        return F.expr(f"{rank} div {self.block}").alias("block")

    def tops(self, nth: int) -> DataFrame:
        """Tops of the trees that end in a segment."""
        return self.segments[nth].where(F.col("top") & (F.col("n") <= self.block))

    def passed(self, nth: int) -> DataFrame:
        """Tops of the blocks whose trees go on above a segment."""
        return self.segments[nth].where(F.col("top") & (F.col("n") > self.block))

    def roots(self) -> DataFrame:
        """tree, digest of each tree's top."""
        each = [self.tops(i).select("tree", "digest") for i in range(len(self.segments))]
        return functools.reduce(DataFrame.unionByName, each)


def graph(nodes: DataFrame, depth: int = DEPTH) -> Graph:
    """The stored graph over nodes tree, rank, n, digest."""
    made = Graph([], depth)
    while True:
        blocks = nodes.select("tree", made.block_of("rank"), "rank", "n", "digest").groupBy("tree", "block")
        made.segments.append(common.written(blocks.applyInArrow(lambda t: raised(t, depth), DDL[RECORDS]), "merkle-records"))
        nodes = made.passed(-1)
        if not nodes.head(1):
            return made
        nodes = nodes.select("tree", F.col("block").alias("rank"), F.ceil(F.col("n") / made.block).alias("n"), "digest")


class Block(NamedTuple):
    """What the requests of a block descend through."""

    children: dict[str, list[str]]
    depth: int
    top: str
    path: list[dict]  # from the root to the top
    subroot: str
    root: str

    @classmethod
    def read(cls, table: pa.Table, depth: int) -> Block:
        rows = table.to_pylist()
        entry = next(r for r in rows if r["root"] is not None)
        n = next(r["n"] for r in rows if r["n"] is not None)
        return cls({r["digest"]: r["children"] for r in rows if r["children"]}, levels(n, depth), entry["digest"], entry["path"], entry["subroot"], entry["root"])

    def descend(self, rank: int) -> tuple[str, list[dict]]:
        """The node of this rank, and the digit and the unpicked children of each level on the way down."""
        node, path = self.top, []
        for level in reversed(range(self.depth)):
            digit, run = rank // FANOUT**level % FANOUT, self.children[node]
            path.append({"digit": digit, "siblings": run[:digit] + run[digit + 1 :]})
            node = run[digit]
        return node, path


def folded(node: str, path: list[dict]) -> str:
    """The root that a node and the siblings on its way from the root make."""
    for level in reversed(path):
        digit, others = level["digit"], level["siblings"]
        node = digest_of([*others[:digit], node, *others[digit:]])
    return node


def reach(requests: pa.Table, store: pa.Table, depth: int) -> pa.Table:
    """The nodes of a segment that the requests tree, rank ask for; each is the entry to a block of the segment below."""
    if not requests.num_rows:
        return REACHED.empty_table()
    block, tree = Block.read(store, depth), requests["tree"].to_pylist()
    ranks = requests["rank"].to_pylist()
    found = [block.descend(rank) for rank in ranks]
    columns = [tree, ranks, [x[0] for x in found], [block.path + x[1] for x in found], [block.subroot] * len(tree), [block.root] * len(tree)]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, REACHED, strict=True)], schema=REACHED)


def prove(requests: pa.Table, store: pa.Table, depth: int) -> pa.Table:
    """The proof of each leaf of a block (rank, doc_id, leaf, tampered): its siblings from the leaf up, and the root that it or its tampered form makes with them."""
    if not requests.num_rows:
        return PROOFS.empty_table()
    block, rows, above = Block.read(store, depth), [], {}
    upper = [s for level in reversed(block.path) for s in level["siblings"]]
    for doc_id, rank, own, other in zip(*(requests[c].to_pylist() for c in ("doc_id", "rank", "leaf", "tampered")), strict=True):
        node, path = block.descend(rank)
        if node != own:
            raise ValueError(f"the graph has another leaf than document {doc_id}'s at rank {rank}")
        siblings = [s for level in reversed(path) for s in level["siblings"]]
        top = folded(other or own, path)
        if top not in above:
            above[top] = folded(top, block.path)
        rows.append((doc_id, own, block.subroot, block.root, digest_of(siblings + upper), above[top], above[top] == block.root))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PROOFS, strict=True)], schema=PROOFS)


def descended(made: Graph, entries: DataFrame, requests: DataFrame, final: bool = False) -> DataFrame:
    """Requests (tree, rank and, if final, the columns of prove()) descend from the entries (tree, digest, path, subroot, root), each its tree's top, through the stored segments."""
    below, depth = None, made.depth
    for i in reversed(range(len(made.segments))):
        own = made.segments[i].where(~F.col("top")).select("tree", "block", "n", "digest", "children")
        here = made.tops(i).select("tree", "n").join(entries, "tree").withColumn("block", F.lit(0).cast("long"))
        if below is not None:
            here = here.unionByName(below.join(made.passed(i).select("tree", "block", "n"), ["tree", "block"]))
        store = own.unionByName(here, allowMissingColumns=True).groupBy("tree", "block")
        asked = made.passed(i - 1).select("tree", F.col("block").alias("rank")) if i else requests
        asked = asked.withColumn("block", made.block_of("rank")).groupBy("tree", "block")
        if i == 0 and final:
            return asked.cogroup(store).applyInArrow(lambda a, b: prove(a, b, depth), DDL[PROOFS])
        below = common.written(asked.cogroup(store).applyInArrow(lambda a, b: reach(a, b, depth), DDL[REACHED]), "merkle-reached")
    return below


class Manifest(NamedTuple):
    """The stored graph of a data set."""

    leaves: Leaves
    trees: Graph  # the sources' trees
    top: Graph  # the tree over their roots


def manifest(docs: DataFrame, depth: int = DEPTH) -> Manifest:
    leaves = ranked(docs)
    trees = graph(leaves.rows.withColumnRenamed("leaf", "digest"), depth)
    n = leaves.sources.count()
    roots = trees.roots().select(F.lit(TOP).cast("long").alias("tree"), (F.col("tree") - 1).alias("rank"), F.lit(n).cast("long").alias("n"), "digest")
    return Manifest(leaves, trees, graph(roots, depth))


def proofs(made: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each document."""
    no_path = F.array().cast("array<struct<digit: int, siblings: array<string>>>")
    root = made.top.roots().select("tree", "digest", no_path.alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    sources = made.leaves.sources.select(F.lit(TOP).cast("long").alias("tree"), (F.col("tree") - 1).alias("rank"))
    # A source's place in the tree over the roots is its number less one.
    entries = descended(made.top, root, sources).select((F.col("block") + 1).alias("tree"), "digest", "path", F.col("digest").alias("subroot"), "root")
    return descended(made.trees, entries, made.leaves.rows.drop("n"), final=True)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proofs(manifest(common.table(spark, sf_dir, "documents").select(*FIELDS)))


#: The checksum's bits are reduced one by one; a source's levels are lists, one made of the other; a proof is a slice of each level.
SQL = r"""
WITH RECURSIVE c AS (SELECT doc_id, source, lang, n_chars, text, replace(text, chr(10), '') AS cut,
  list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
    lambda crc, b: list_reduce([1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[], lambda s, k: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END, xor(crc, b)), 4294967295) & 1 = 1 AS even
  FROM documents),
e AS (SELECT *, list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR], lambda v: coalesce(strlen(v)::VARCHAR || ':' || v, '-')) AS head FROM c),
d AS (SELECT doc_id, source, sha256(array_to_string(head, '') || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf,
  CASE WHEN even THEN sha256(array_to_string(head, '') || coalesce(strlen(cut)::VARCHAR || ':' || cut, '-')) END AS tampered FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM d),
t(tree, level, nodes) AS (SELECT source, 0, list(leaf ORDER BY place) FROM r GROUP BY source
  UNION ALL SELECT tree, level + 1, list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i + 1:i + 3], ''))) FROM t WHERE len(nodes) > 1),
s AS (SELECT tree AS source, nodes[1] AS subroot, level AS height, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS place FROM t WHERE len(nodes) = 1),
u(level, nodes) AS (SELECT 0, list(subroot ORDER BY place) FROM s
  UNION ALL SELECT level + 1, list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i + 1:i + 3], ''))) FROM u WHERE len(nodes) > 1),
w AS (SELECT r.*, s.subroot, s.height, s.place AS upper, (SELECT nodes[1] FROM u WHERE len(nodes) = 1) AS root FROM r JOIN s ON r.source IS NOT DISTINCT FROM s.source),
p AS (SELECT w.doc_id, w.source, w.place, t.level, w.place // pow(3, t.level)::BIGINT AS nth, t.nodes FROM w JOIN t ON w.source IS NOT DISTINCT FROM t.tree AND t.level < w.height
  UNION ALL SELECT w.doc_id, w.source, w.place, w.height + u.level, w.upper // pow(3, u.level)::BIGINT, u.nodes FROM w, u WHERE len(u.nodes) > 1),
q AS (SELECT doc_id, source, place, level, nodes[nth // 3 * 3 + 1:nth] AS low, nodes[nth + 2:nth // 3 * 3 + 3] AS high FROM p),
x AS (SELECT source, place, list(struct_pack(low := low, high := high) ORDER BY level) AS path FROM q GROUP BY source, place),
f AS (SELECT w.*, coalesce(x.path, []) AS path FROM w LEFT JOIN x ON w.source IS NOT DISTINCT FROM x.source AND w.place = x.place),
g(doc_id, source, place, level, node, path) AS (SELECT doc_id, source, place, 0, coalesce(tampered, leaf), path FROM f
  UNION ALL SELECT doc_id, source, place, level + 1, sha256(array_to_string(path[level + 1].low, '') || node || array_to_string(path[level + 1].high, '')), path FROM g WHERE level < len(path))
SELECT f.doc_id, f.leaf, f.subroot, f.root, sha256(array_to_string(flatten(list_transform(f.path, lambda y: y.low || y.high)), '')) AS proof_sha256, g.node AS folded_root, g.node = f.root AS verified
FROM f JOIN g ON f.source IS NOT DISTINCT FROM g.source AND f.place = g.place AND g.level = len(f.path)
"""
