"""Embedding near-dedup by a robust-pruned flat graph.

* Equal vectors are one node with a multiplicity.
* Nodes are dealt to cells by a tree of centroids: each level fits up to FAN centroids on a bounded sample of a cell (SAMPLE vectors by a
  hash) and splits it, until no cell is the home of more than LARGEST nodes. So cells grow in number with the data, not in size. A node is
  at home in its nearest cell and a guest in the next ones of each level, so cells overlap.
* In each cell a graph is built over its home rows and guests (many guests: in blocks, each with all home rows): near candidates,
  robust-pruned (a candidate is left out if a nearer kept one is closer to it by the factor ALPHA), with reverse edges.
* The adjacency lists of a node from all its cells are united. Edges to nodes that live elsewhere stay if they are REACH alike or more.
* Every node searches its home cell over the united lists: greedy beam search from the medoid and from the node itself, then the range is
  expanded from all nodes found within the threshold. Where an edge of a found node leads to another cell, the query visits that
  cell too, from that edge's end, and expands there; a node found by a visitor visits the visitor's home in turn. Rounds
  of visits go on until no query has a new cell to see.
* What is found is verified by cosine in double precision.
* Recall is audited on nodes drawn by a hash of their number, whatever was found for them: they are compared with all vectors, until LINKED of them have a
  link or the last of the steps AUDIT is done. The audit is the mean share of links found, of nodes with up to MANY links and of those with more apart; the lower
  one counts. Below GOAL the work is repeated with twice the overlap, and in the end done exactly, in blocks of all rows, in rounds of bounded copies. The recall is a
  column of the result.

Candidates of the graph come from the cell's own similarities, block by block: a cell has a bounded size. Pairs aren't written: a task counts links and
returns a forest of linked nodes for the components. A ball of b near-equal, not equal, vectors spans b / SHARD cells or so, which its nodes all
visit; there the work grows as b times the cells.

Defined cases: each row is a vector of its own, also if its vec_id repeats or is null. Vectors that are null, empty, zero or hold null or
non-finite components link with nothing and are their own component; vectors of another length link only among their length. A row without a vec_id
counts as a link; its component_id is the smallest vec_id that it reaches, null if it reaches none. Empty table: empty result. Extra columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

#: Vectors that centroids are fitted on; children of a cell at most; home rows of a cell on average and at most; guests and visits of a task on average.
SAMPLE, FAN, SHARD, LARGEST, GUESTS, VISITS = 8192, 128, 1500, 6000, 4096, 4096
#: Levels of centroids at most, and the share of a cell that the largest child may take; beyond it a cell is split by a hash.
DEPTH, LOPSIDED = 7, 0.9
OVERLAP, DEGREE, CANDIDATES, ALPHA, BEAM, REACH = 3, 12, 32, 1.2, 8, 0.8
#: Audited nodes, by step; linked ones that are enough; a kind of nodes counts by itself if so many of it were seen; rows of a block of the exact way, and copies of a row in one of its rounds.
AUDIT, LINKED, SEEN, MANY, GOAL, BLOCK, COPIES = (1024, 4096, 16_384), 200, 8, 16, 0.95, 16_384, 64
#: Numbers of a matrix that a task holds at once, about; cosines this near to the threshold are summed again; share of a cell that is much.
AT_ONCE, NEAR, MUCH = 1 << 20, 1e-9, 0.05

EDGES = "node long, dim int, cell long, near array<long>, near_cell array<long>, alike array<float>"
FOUND = "kind int, a long, b long, dim int, cell long"
COUNT, LINK, VISIT = 0, 1, 2


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so squares neither overflow nor vanish."""
    v = v / np.maximum(np.abs(v).max(axis=1, keepdims=True), 1e-300)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1)


def flat(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of a column of lists, and their values one after the other."""
    lists = column.combine_chunks()
    return lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False).astype(kind)


def centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; the same for the same rows."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        some = np.abs(total).sum(axis=1) > 0
        c[some] = unit(total[some])
    return c


def keyed(table: DataFrame, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """id, v, k1, k2 of each row: v in the element type of the table and null if it can't be compared; k1, k2: 128 bits of hash that stand for it."""
    kind = "float" if table.schema[vec].dataType.simpleString() == "array<float>" else "double"
    usable = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vec, lambda x: x != 0)
    v = F.when(F.coalesce(usable, F.lit(False)), F.transform(F.col(vec).cast(f"array<{kind}>"), lambda x: x + F.lit(0).cast(kind)))
    rows = table.select(F.col(key).cast("long").alias("id"), v.alias("v"))
    return rows.withColumn("k1", F.when(F.col("v").isNotNull(), F.xxhash64("v"))).withColumn("k2", F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(7), "v")))


def nodes_of(rows: DataFrame) -> DataFrame:
    """node, id (smallest vec_id or null), n (rows), v, dim, k1, k2 of each distinct usable vector. node is only fixed once the table is written."""
    one = rows.where(F.col("v").isNotNull()).groupBy("k1", "k2").agg(F.first("v").alias("v"), F.min("id").alias("id"), F.count("*").alias("n"))
    return one.select(F.monotonically_increasing_id().alias("node"), "id", "n", "v", F.size("v").alias("dim"), "k1", "k2")


def kind_of(nodes: DataFrame) -> str:
    return nodes.schema["v"].dataType.simpleString()


def nearest(x: np.ndarray, c: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, centroid and place (0: nearest) of the m nearest centroids of each row."""
    m = min(m, len(c))
    picks = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :m]
    return np.repeat(np.arange(len(x)), m), picks.ravel(), np.tile(np.arange(m), len(x))


def with_cells(rows: pa.RecordBatch | pa.Table, at: np.ndarray, cells: np.ndarray, homes: np.ndarray) -> pa.Table:
    out = pa.table({c: rows[c] for c in ("node", "n", "dim", "v")}).take(pa.array(at))
    return out.append_column("cell", pa.array(cells.astype(np.int64))).append_column("home_cell", pa.array(homes.astype(np.int64)))


def placed_schema(v: str) -> str:
    return f"node long, n long, dim int, v {v}, cell long, home_cell long"


def top_cells(nodes: DataFrame, count: int, overlap: int) -> DataFrame:
    """The first level of placed(); narrow, so worked out again rather than written."""
    total = -(-count // SHARD)
    if total <= 1:
        one = F.lit(1).cast("long")
        return nodes.select("node", "n", "dim", "v", one.alias("cell"), one.alias("home_cell"))
    share = F.pmod(F.xxhash64("k1", F.lit(1)), F.lit(1 << 30)) < int(min(1.0, SAMPLE / count) * (1 << 30))
    sample = nodes.where(share).select("dim", "v", "k1", "k2").toPandas().sort_values(["k1", "k2"])
    fitted = {}
    for dim, g in sample.groupby("dim"):
        k = min(FAN, len(g), max(1, round(total * len(g) / len(sample))))
        fitted[int(dim)] = centroids(unit(np.stack([np.asarray(v, np.float64) for v in g["v"]])), k)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                if (c := fitted.get(int(dim))) is None:
                    at, child, place = np.arange(len(part)), np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
                else:
                    at, child, place = nearest(unit(vectors(part["v"])), c, overlap)
                home = child[place == 0]
                yield from with_cells(part, at, child + 1, home[at] + 1).to_batches()

    return nodes.select("node", "n", "dim", "v").mapInArrow(assign, placed_schema(kind_of(nodes)))


def deeper(rows: DataFrame, overlap: int, level: int) -> DataFrame | None:
    """Rows whose cells of over LARGEST home rows are split; None if there is none. A node at home stays so in the nearest child and is a guest in the next ones; guests go to the nearest only, and their home_cell is 0."""
    home = F.col("cell") == F.col("home_cell")
    per = rows.groupBy("dim", "cell").agg(F.count_if(home).alias("homes"), F.count("*").alias("every"))
    sizes = common.written(per.where(F.col("homes") > LARGEST), "vector-cells")
    if not (n := sizes.count()):
        return None
    marked = rows.join(common.small_side(sizes, n), ["dim", "cell"], "left")
    large = marked.where(F.col("homes").isNotNull())
    picked = large.where(home & (F.pmod(F.xxhash64("node", F.lit(level)), F.lit(1 << 30)) < F.lit(float(SAMPLE << 30)) / F.col("homes")))

    def fit(table: pa.Table) -> pa.Table:
        x = unit(vectors(table.sort_by("node")["v"]))
        k = min(FAN, len(x), -(-table["homes"][0].as_py() // SHARD))
        c = centroids(x, k)
        if np.bincount((x @ c.T).argmax(axis=1), minlength=k).max() > LOPSIDED * len(x):
            c = c[:0]
        one = table.select(["dim", "cell"]).slice(0, 1)
        return one.append_column("children", pa.array([k], pa.int32())).append_column("c", pa.array([c.ravel().tolist()], pa.list_(pa.float64())))

    fits = common.written(picked.groupBy("dim", "cell").applyInArrow(fit, "dim int, cell long, children int, c array<double>"), "vector-centroids")
    salts = F.ceil(F.col("every") / (8 * GUESTS)).cast("int")
    salted = large.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(5)), salts).cast("int"))
    copies = fits.join(common.small_side(sizes, n), ["dim", "cell"]).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    copies = copies.select("dim", "cell", "salt", "children", "c").toDF("dim", "cell", "salt", "children", "c")

    def assign(part: pa.Table, fit: pa.Table) -> pa.Table:
        if not part.num_rows:
            return with_cells(part, np.empty(0, np.int64), np.empty(0), np.empty(0))
        parent, k, dim = (fit[c][0].as_py() for c in ("cell", "children", "dim"))
        c = np.array(fit["c"][0].as_py()).reshape(-1, dim)
        if len(c):
            at, child, place = nearest(unit(vectors(part["v"])), c, overlap)
        else:  # too alike to be told apart by centroids
            m = min(overlap, k)
            with np.errstate(over="ignore"):
                first = (part["node"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % k
            at, place = np.repeat(np.arange(len(part)), m), np.tile(np.arange(m), len(part))
            child = (first[at] + place) % k
        at_home = (part["cell"].to_numpy() == part["home_cell"].to_numpy())[at]
        stays = at_home | (place == 0)
        cells = parent * 256 + child + 1
        return with_cells(part, at[stays], cells[stays], np.where(at_home & (place == 0), cells, 0)[stays])

    split = salted.groupBy("dim", "cell", "salt").cogroup(copies.groupBy("dim", "cell", "salt")).applyInArrow(assign, placed_schema(kind_of(rows)))
    return common.written(marked.where(F.col("homes").isNull()).select(split.columns).unionByName(split), "vector-rows")


def placed(nodes: DataFrame, count: int, overlap: int) -> DataFrame:
    """node, n, dim, v, cell, home_cell: a row for each cell that a node is at home or a guest in."""
    rows, split = top_cells(nodes, count, overlap), False
    if count > LARGEST:
        for level in range(2, DEPTH + 1):
            if (finer := deeper(rows, overlap, level)) is None:
                break
            rows, split = finer, True
    if not split:
        return rows
    homes = rows.where(F.col("cell") == F.col("home_cell")).select("node", "home_cell")
    return common.written(rows.drop("home_cell").join(homes, "node").select(rows.columns), "vector-placed")


def pruned(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges a, b and their cosine of the robust-pruned graph over unit vectors, with reverse edges, sorted by a."""
    n = len(x)
    m = min(CANDIDATES, n - 1)
    if m <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
    single = x.astype(np.float32)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for start in range(0, n, 256):
        rows = np.arange(start, min(n, start + 256))
        sims = single[rows] @ single.T
        sims[np.arange(len(rows)), rows] = -2
        near = np.argpartition(-sims, m - 1, axis=1)[:, :m]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable"), 1)
        sims = np.take_along_axis(sims, near, 1)
        gap = np.maximum(1 - sims, 0)
        between = np.maximum(1 - single[near] @ single[near].transpose(0, 2, 1), 0)
        alive, kept = np.ones((len(rows), m), bool), np.zeros((len(rows), m), bool)
        own = np.arange(len(rows))
        for _ in range(min(DEGREE, m)):
            pick = alive.argmax(axis=1)
            some = alive[own, pick]
            if not some.any():
                break
            kept[own[some], pick[some]] = True
            alive[own, pick] = False
            alive &= ~(ALPHA * between[own, pick] <= gap)
        a, b = np.nonzero(kept)
        out.append((rows[a], near[a, b], sims[a, b]))
    a, b, s = (np.concatenate(c) for c in zip(*out, strict=True))
    a, b, s = np.r_[a, b], np.r_[b, a], np.r_[s, s]
    order = np.lexsort((b, a))
    a, b, s = a[order], b[order], s[order]
    fresh = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    return a[fresh], b[fresh], s[fresh]


def cut(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Values as lists that begin at starts."""
    return pa.ListArray.from_arrays(pa.array(np.r_[starts, len(values)].astype(np.int32)), pa.array(values))


def adjacency(rows: DataFrame) -> DataFrame:
    """EDGES: the lists of each cell's graph, a row for each node of it; edges between nodes of other homes only from REACH on."""
    home = F.col("cell") == F.col("home_cell")
    per = rows.groupBy("dim", "cell").agg(F.ceil(F.count_if(~home) / GUESTS).cast("int").alias("blocks"))
    sizes = common.written(per.where("blocks > 1"), "vector-blocks")
    if n := sizes.count():
        rows = rows.join(common.small_side(sizes, n), ["dim", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        own = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int")
        rows = rows.withColumn("block", F.explode(F.when(home, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))))
    else:
        rows = rows.withColumn("block", F.lit(0))

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        node, homes = table["node"].to_numpy(), table["home_cell"].to_numpy()
        a, b, s = pruned(unit(vectors(table["v"])))
        stays = (homes[a] == homes[b]) | (s >= REACH)
        a, b, s = a[stays], b[stays], s[stays]
        some, starts = np.unique(a, return_index=True)
        made = {
            "node": node[some],
            "dim": table["dim"].to_numpy()[some],
            "cell": homes[some],
            "near": cut(node[b], starts),
            "near_cell": cut(homes[b], starts),
            "alike": cut(s, starts),
        }
        return pa.table(made)

    return rows.select("node", "dim", "v", "cell", "home_cell", "block").groupBy("dim", "cell", "block").applyInArrow(build, EDGES)


class Cell:
    """Home rows of a cell and their united lists, from a table in which a node's vector and its lists are rows of their own."""

    def __init__(self, table: pa.Table) -> None:
        own = table.filter(table["v"].is_valid()).sort_by("node")
        self.node, self.n, self.x = own["node"].to_numpy(), own["n"].to_numpy(), unit(vectors(own["v"]))
        self.dim, self.cell = table["dim"][0].as_py(), table["cell"][0].as_py()
        lists = table.filter(table["near"].is_valid())
        size, near = flat(lists["near"], np.int64)
        near_cell = flat(lists["near_cell"], np.int64)[1]
        a = np.searchsorted(self.node, np.repeat(lists["node"].to_numpy(), size))
        inside = near_cell == self.cell
        edges = np.unique(np.stack([a[inside], np.searchsorted(self.node, near[inside])], axis=1), axis=0)
        count = np.bincount(edges[:, 0], minlength=len(self.node))
        self.table = np.full((len(self.node), max(int(count.max()), 1)), -1, np.int64)
        self.table[edges[:, 0], np.arange(len(edges)) - np.repeat(np.cumsum(count) - count, count)] = edges[:, 1]
        #: Edges that lead elsewhere: place here, node there, its cell.
        self.out = np.unique(np.stack([a[~inside], near[~inside], near_cell[~inside]], axis=1), axis=0)
        self.entries = self.entry_points()

    def entry_points(self) -> np.ndarray:
        """The medoid, and a node of each part of the graph that it doesn't reach."""
        seen, starts = np.zeros(len(self.node), bool), []
        for start in [int((self.x @ self.x.mean(axis=0)).argmax()), *range(len(self.node))]:
            if seen[start]:
                continue
            starts.append(start)
            front = np.array([start])
            seen[start] = True
            while len(front):
                front = np.unique(self.table[front])
                front = front[front >= 0]
                front = front[~seen[front]]
                seen[front] = True
        return np.array(starts)

    def searched(self, queries: np.ndarray, own: np.ndarray, least: float) -> np.ndarray:
        """Which home rows each query (unit vectors) finds at or above `least`: greedy search from the entry points and from the places `own` (-1: none), then range expansion.

        A range that covers much of the cell is compared with all of it at once. Cosines that round-off could move over the threshold are summed
        again, alike in either order of a pair.
        """
        sims = self.cosines(queries, own, least - NEAR)
        hits = sims >= least + NEAR
        a, b = np.nonzero((sims >= least - NEAR) & ~hits)
        hits[a, b] = (queries[a] * self.x[b]).sum(axis=1) >= least
        return hits

    def cosines(self, queries: np.ndarray, own: np.ndarray, least: float) -> np.ndarray:
        """Cosine of each query and home row; -2 where the search didn't come by."""
        n, q = len(self.node), len(queries)
        rows = np.arange(q)
        visited, opened, sims = np.zeros((q, n), bool), np.zeros((q, n), bool), np.full((q, n), -2.0)

        def see(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            s = np.einsum("ij,ij->i", queries[a], self.x[b])
            visited[a, b], sims[a, b] = True, s
            return s

        visited[:, self.entries] = True
        sims[:, self.entries] = queries @ self.x[self.entries].T
        a, b = np.nonzero(own >= 0)
        see(a, own[a, b])
        beam = min(BEAM, n)
        ids = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
        scores = np.take_along_axis(sims, ids, 1)
        ids = np.where(scores > -2, ids, -1)
        while True:
            ready = (ids >= 0) & ~opened[rows[:, None], np.maximum(ids, 0)]
            act = np.flatnonzero(ready.any(axis=1))
            if not len(act):
                break
            node = ids[act, np.where(ready[act], scores[act], -9).argmax(axis=1)]
            opened[act, node] = True
            near = self.table[node]
            fresh = (near >= 0) & ~visited[act[:, None], np.maximum(near, 0)]
            r, c = np.nonzero(fresh)
            found = np.full(near.shape, -3.0)
            found[r, c] = see(act[r], near[r, c])
            every, score = np.concatenate([ids[act], np.where(fresh, near, -1)], 1), np.concatenate([scores[act], found], 1)
            order = np.argpartition(-score, beam - 1, axis=1)[:, :beam]
            ids[act], scores[act] = np.take_along_axis(every, order, 1), np.take_along_axis(score, order, 1)
        # Range expansion starts at what is found, and at the places that edges led to, found or not.
        a, b = np.nonzero(own >= 0)
        first = np.zeros((q, n), bool)
        first[a, own[a, b]] = True
        while True:
            r, node = np.nonzero(((sims >= least) | first) & ~opened)
            if not len(r):
                return sims
            if len(r) > MUCH * q * n and len(r) > 1 << 12:
                return queries @ self.x.T
            for at in range(0, len(r), 1 << 15):
                who, what = r[at : at + (1 << 15)], node[at : at + (1 << 15)]
                opened[who, what] = True
                near = self.table[what]
                i, c = np.nonzero((near >= 0) & ~visited[who[:, None], np.maximum(near, 0)])
                key = np.unique(who[i] * n + near[i, c])
                see(key // n, key % n)


def spanning(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that join all that the square matrix joins: what three rounds of smallest neighbours join, and the links that these left."""
    n = len(hits)
    low = np.arange(n)
    for _ in range(3):
        for at in range(0, n, 256):
            low[at : at + 256] = np.minimum(low[at : at + 256], np.where(hits[at : at + 256], low, n).min(axis=1))
    a, b = [np.arange(n)], [low]
    for at in range(0, n, 256):
        r, c = np.nonzero(hits[at : at + 256] & (low[at : at + 256, None] != low))
        a.append(at + r), b.append(c)
    return forest(np.concatenate(a), np.concatenate(b))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each id to the smallest one that it reaches."""
    ids, both = np.unique(np.r_[a, b], return_inverse=True)
    a, b = both[: len(a)], both[len(a) :]
    roots = np.arange(len(ids))
    while True:
        low = np.minimum(roots[a], roots[b])
        before = roots.copy()
        np.minimum.at(roots, roots[a], low)
        np.minimum.at(roots, roots[b], low)
        while (roots[roots] != roots).any():
            roots = roots[roots]
        if (roots == before).all():
            break
    far = roots != np.arange(len(ids))
    return ids[far], ids[roots[far]]


class Answers:
    """Rows of FOUND: links counted (a: node, b: number), links of a forest, and cells to visit (a: node, b: place to begin, cell)."""

    def __init__(self, dim: int) -> None:
        self.dim, self.rows = dim, []
        self.a, self.b = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, kind: int, a: np.ndarray, b: np.ndarray, cell: np.ndarray | int = 0) -> None:
        if len(a):
            self.rows.append((np.full(len(a), kind, np.int32), a, b, np.broadcast_to(np.asarray(cell, np.int64), len(a))))

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a, self.b = forest(np.r_[self.a, a], np.r_[self.b, b])

    def leave(self, cell: Cell, who: np.ndarray, reached: np.ndarray, home: np.ndarray) -> None:
        """Visits of the queries (nodes) that reached an edge which leads elsewhere, one for each cell; not to their own home."""
        for to in np.unique(cell.out[:, 2]) if len(cell.out) else ():
            edges = cell.out[cell.out[:, 2] == to]
            on = reached[:, edges[:, 0]]
            go = on.any(axis=1) & (home != to)
            self.add(VISIT, who[go], edges[on[go].argmax(axis=1), 1], to)

    def table(self) -> pa.Table:
        self.add(LINK, self.a, self.b)
        kind, a, b, cell = (np.concatenate(c) for c in zip(*self.rows, strict=True)) if self.rows else [np.empty(0, np.int64)] * 4
        made = {"kind": kind.astype(np.int32), "a": a, "b": b, "dim": np.full(len(a), self.dim, np.int32), "cell": cell.astype(np.int64)}
        return pa.table(made)


def at_home(least: float) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        cell = Cell(table)
        n, out = len(cell.node), Answers(cell.dim)
        hits = np.zeros((n, n), bool)
        for part in parts(n, n):
            hits[part] = cell.searched(cell.x[part], np.arange(n)[part, None], least)
        hits |= hits.T
        np.fill_diagonal(hits, False)
        links = np.concatenate([hits[part] @ cell.n for part in parts(n, n)])
        out.add(COUNT, cell.node[links > 0], links[links > 0])
        a, b = spanning(hits)
        out.link(cell.node[a], cell.node[b])
        np.fill_diagonal(hits, True)
        out.leave(cell, cell.node, hits, np.full(n, cell.cell))
        return out.table()

    return run


def parts(n: int, width: int) -> Iterator[slice]:
    """Rows of a matrix of n rows in pieces of about AT_ONCE numbers."""
    step = max(32, AT_ONCE // max(width, 1))
    return (slice(at, at + step) for at in range(0, n, step))


def on_visit(least: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(visits: pa.Table, table: pa.Table) -> pa.Table:
        if not visits.num_rows or not table.num_rows:
            return Answers(0).table()
        cell = Cell(table)
        out = Answers(cell.dim)
        who, home, x = visits["node"].to_numpy(), visits["home_cell"].to_numpy(), unit(vectors(visits["v"]))
        size, entry = flat(visits["entries"], np.int64)
        own = np.full((len(who), int(size.max())), -1, np.int64)
        own[np.repeat(np.arange(len(who)), size), np.arange(len(entry)) - np.repeat(np.cumsum(size) - size, size)] = np.searchsorted(cell.node, entry)
        for part in parts(len(who), len(cell.node)):
            q, h, hits = who[part], home[part], cell.searched(x[part], own[part], least)
            r, c = np.nonzero(hits)
            out.link(q[r], cell.node[c])
            links = hits @ cell.n
            out.add(COUNT, q[links > 0], links[links > 0])
            out.leave(cell, q, hits, h)
            for to in np.unique(h):  # who is found visits the finder's home
                on = hits[h == to]
                go = on.any(axis=0)
                out.add(VISIT, cell.node[go], q[h == to][on[:, go].argmax(axis=0)], to)
        return out.table()

    return run


def found_links(nodes: DataFrame, count: int, least: float, overlap: int) -> tuple[DataFrame, DataFrame]:
    """(node and number of its links to other nodes' rows, links of a forest over nodes)."""
    rows = placed(nodes, count, overlap)
    lists = common.written(adjacency(rows), "vector-graph")
    v = kind_of(nodes)
    homes = rows.where(F.col("cell") == F.col("home_cell"))
    empty = [F.lit(None).cast(k).alias(c) for c, k in (("near", "array<long>"), ("near_cell", "array<long>"), ("alike", "array<float>"))]
    members = homes.select("dim", "cell", "node", "n", "v", *empty)
    told = lists.select("dim", "cell", "node", F.lit(None).cast("long").alias("n"), F.lit(None).cast(v).alias("v"), "near", "near_cell", "alike")
    index = members.unionByName(told)
    steps = [common.written(index.groupBy("dim", "cell").applyInArrow(at_home(least), FOUND), "vector-links")]
    seen = None
    while True:
        new = steps[-1].where(F.col("kind") == VISIT).groupBy(F.col("a").alias("node"), "dim", "cell").agg(F.collect_set("b").alias("entries"))
        new = common.written(new if seen is None else new.join(seen, ["node", "dim", "cell"], "left_anti"), "vector-visits")
        if not (n := new.count()):
            break
        seen = new.drop("entries") if seen is None else seen.unionByName(new.drop("entries"))
        per = common.written(new.groupBy("dim", "cell").agg(F.ceil(F.count("*") / VISITS).cast("int").alias("chunks")), "vector-visited")
        per = common.small_side(per)
        asked = homes.select("node", "v", "home_cell").join(common.small_side(new, n), "node").join(per, ["dim", "cell"])
        chunk = F.pmod(F.xxhash64("node", F.lit(3)), F.col("chunks")).cast("int")
        asked = asked.select("dim", "cell", chunk, "node", "v", "home_cell", "entries").toDF("dim", "cell", "chunk", "node", "v", "home_cell", "entries")
        there = index.join(per, ["dim", "cell"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
        place = ["dim", "cell", "chunk"]
        steps.append(common.written(asked.groupBy(*place).cogroup(there.groupBy(*place)).applyInArrow(on_visit(least), FOUND), "vector-links"))
    every = steps[0]
    for step in steps[1:]:
        every = every.unionByName(step)
    found = every.where(F.col("kind") == COUNT).groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("found"))
    return common.written(found, "vector-counts"), every.where(F.col("kind") == LINK).select("a", "b")


def exact_links(nodes: DataFrame, count: int, least: float) -> tuple[DataFrame, DataFrame]:
    """The same by comparing blocks of all rows, each pair of blocks once; a round of pairs has at most about COPIES copies of each row."""
    blocks = max(1, -(-count // BLOCK))
    rounds = -(-blocks // COPIES)
    own = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(blocks)).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
    dealt = nodes.select("node", "n", "dim", "v", own.alias("own")).withColumn("pair", F.explode(pairs))

    def compare(table: pa.Table) -> pa.Table:
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        block, node, n, x = table["own"].to_numpy(), table["node"].to_numpy(), table["n"].to_numpy(), unit(vectors(table["v"]))
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        out, counts = Answers(table["dim"][0].as_py()), np.zeros(len(node), np.int64)
        for part in parts(len(left), len(right)):
            rows = left[part]
            sims = x[rows] @ x[right].T
            hits = sims >= least + NEAR
            a, b = np.nonzero((sims >= least - NEAR) & ~hits)
            hits[a, b] = (x[rows[a]] * x[right[b]]).sum(axis=1) >= least
            if i == j:
                hits &= rows[:, None] < right
            counts[rows] += hits @ n[right]
            counts[right] += n[rows] @ hits
            a, b = np.nonzero(hits)
            out.link(node[rows[a]], node[right[b]])
        out.add(COUNT, node[counts > 0], counts[counts > 0])
        return out.table()

    dealt = dealt.select("dim", "pair.i", "pair.j", "own", "node", "n", "v")
    of_round = lambda k: dealt.where((F.col("i") + F.col("j")) % rounds == k).groupBy("dim", "i", "j").applyInArrow(compare, FOUND)
    made = functools.reduce(DataFrame.unionByName, [common.written(of_round(k), "vector-links") for k in range(rounds)])
    found = made.where(F.col("kind") == COUNT).groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("found"))
    return common.written(found, "vector-counts"), made.where(F.col("kind") == LINK).select("a", "b")


def true_links(nodes: DataFrame, picked: DataFrame, least: float) -> DataFrame:
    """node, true_links (to other nodes' rows) of the picked nodes, a bounded number: brute force over all nodes in one pass, each task adds up what its rows have."""
    rows = picked.select("node", "dim", "v").toPandas()
    groups = {int(d): (g["node"].to_numpy(), unit(np.stack([np.asarray(v, np.float64) for v in g["v"]]))) for d, g in rows.groupby("dim")}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {dim: np.zeros(len(ids), np.int64) for dim, (ids, _) in groups.items()}
        for batch in batches:
            for dim, (ids, x) in groups.items():
                part = batch.filter(pa.array(batch["dim"].to_numpy() == dim))
                if len(part):
                    mine, n, node = unit(vectors(part["v"])), part["n"].to_numpy(), part["node"].to_numpy()
                    for at in range(0, len(ids), 2048):
                        hit = (mine @ x[at : at + 2048].T >= least) & (node[:, None] != ids[at : at + 2048])
                        sums[dim][at : at + 2048] += n @ hit
        for dim, (ids, _) in groups.items():
            some = sums[dim] > 0
            yield pa.RecordBatch.from_pydict({"node": ids[some], "true_links": sums[dim][some]})

    return nodes.select("node", "dim", "n", "v").mapInArrow(count, "node long, true_links long").groupBy("node").agg(F.sum("true_links").alias("true_links"))


def audit(nodes: DataFrame, found: DataFrame, least: float, steps: tuple[int, ...] = AUDIT) -> float:
    """Share of the links that were found, the mean over nodes that have one, of nodes with few and with many links apart: the lower of both. 1.0 if no drawn node has a link."""
    recall = 1.0
    for most in steps:
        drawn = nodes.select("node").orderBy(F.xxhash64("node", F.lit(9)), "node").limit(most)  # whatever was found for them
        true = true_links(nodes, nodes.join(F.broadcast(drawn), "node"), least)
        share = F.least(F.lit(1.0), F.coalesce("found", F.lit(0)) / F.col("true_links"))
        kinds = true.join(found, "node", "left").groupBy((F.col("true_links") > MANY).alias("many")).agg(F.avg(share).alias("share"), F.count("*").alias("n")).collect()
        linked = sum(k.n for k in kinds)
        if linked:
            recall = min([sum(k.share * k.n for k in kinds) / linked, *[k.share for k in kinds if k.n >= SEEN]])
        if linked >= LINKED:
            break
    return recall


def near_duplicates(table: DataFrame, least: float = 0.9, overlap: int = OVERLAP, goal: float = GOAL) -> tuple[DataFrame, float]:
    """(vec_id, n_links, component_id, kept of each row; audited recall, 1.0 if the links were found exactly)."""
    spark = table.sparkSession
    common.bounded_batches(spark)
    rows = keyed(table)
    nodes = common.written(nodes_of(rows), "vectors")
    count = nodes.count()
    for attempt in range(3):
        if attempt < 2:
            found, links = found_links(nodes, count, least, overlap << attempt)
            recall = audit(nodes, found, least)
            if recall >= goal:
                break
        else:
            (found, links), recall = exact_links(nodes, count, least), 1.0
    marks = nodes.drop("v", "dim").join(components(links).withColumnRenamed("id", "node"), "node", "left").join(found, "node", "left")
    marks = common.written(marks.withColumn("component", F.coalesce("component", "node")), "vector-components")
    reached = marks.groupBy("component").agg(F.min("id").alias("component_id"))
    links = (F.coalesce("found", F.lit(0)) + F.col("n") - 1).cast("long")
    marks = marks.join(common.small_side(reached, count), "component").select("k1", "k2", links.alias("n_links"), "component_id")
    rows = rows.select(F.col("id").alias("vec_id"), "k1", "k2")
    linked = rows.where(F.col("k1").isNotNull()).join(common.small_side(marks, count), ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(F.col("k1").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))), recall


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, recall = near_duplicates(common.table(spark, sf_dir, "embeddings"))
    return found.withColumn("recall", F.lit(recall))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM g GROUP BY a)
SELECT c.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, c.vec_id = component_id AS kept, 1.0::DOUBLE AS recall FROM c LEFT JOIN n USING (vec_id)
"""
