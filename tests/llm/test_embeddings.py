"""Linked vectors against brute force: planted pairs, chains and balls, over one and several levels of cells, and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import common, embeddings


def brute(x):
    u = embeddings.unit(np.asarray(x, float))
    s = u @ u.T >= 0.9
    np.fill_diagonal(s, False)
    return s


def roots(s):
    out = np.arange(len(s))
    while True:
        new = np.minimum(out, np.where(s, out, len(s)).min(axis=1, initial=len(s)))
        if (new == out).all():
            return out
        out = new


def planted(dims=32, seed=4):
    """Random vectors, near copies of many, a chain, a ball of a third of all, and exact copies."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(2400, dims))
    near = base[rng.choice(2400, 900)] + rng.normal(size=(900, dims)) * 0.2
    ball = base[:1] + rng.normal(size=(1800, dims)) * 0.06
    a, b = (v / np.linalg.norm(v) for v in rng.normal(size=(2, dims)))
    chain = [np.cos(t) * a + np.sin(t) * b for t in np.arange(0, 3, 0.35)]
    x = np.vstack([base, near, ball, chain, base[:50]]).astype(np.float32)
    return x[rng.permutation(len(x))]


def table(spark, x, kind="float"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>").repartition(4)


SIZES = {
    "one level": {"SHARD": 400, "LARGEST": 10_000},
    "three levels": {"SHARD": 150, "LARGEST": 400, "FAN": 6, "SAMPLE": 400, "GUESTS": 500, "VISITS": 300},
}


@pytest.mark.parametrize("sizes", SIZES)
def test_links(spark, monkeypatch, sizes):
    for name, value in SIZES[sizes].items():
        monkeypatch.setattr(embeddings, name, value)
    x = planted()
    made, recall = embeddings.near_duplicates(table(spark, x))
    r = made.toPandas().sort_values("vec_id")
    s = brute(x)
    links = r.n_links.to_numpy()
    assert len(r) == len(x) and recall >= 0.95 and (links <= s.sum(1)).all()
    some = s.sum(1) > 0
    assert (links[some] / s.sum(1)[some]).mean() >= 0.98 and links.sum() / s.sum() >= 0.97
    assert (r.component_id.to_numpy() == roots(s)).mean() >= 0.98
    assert (r.kept == (r.vec_id == r.component_id)).all()


def test_cells_are_bounded(spark, monkeypatch):
    for name, value in SIZES["three levels"].items():
        monkeypatch.setattr(embeddings, name, value)
    same = np.ones((1500, 8)) + np.arange(1500)[:, None] * 1e-12  # too alike for centroids
    nodes = common.written(embeddings.nodes_of(embeddings.keyed(table(spark, np.vstack([planted(8), same]), "double"))), "test-vectors")
    rows = embeddings.placed(nodes, nodes.count(), 3)
    home = F.col("cell") == F.col("home_cell")
    assert rows.where(home).count() == nodes.count() == rows.select("node").distinct().count()
    assert rows.where(home).groupBy("cell").count().agg(F.max("count")).head()[0] <= 2 * 400
    assert rows.groupBy("node", "cell").count().where("count > 1").count() == 0


def test_exact(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 1000)
    x = planted(16)[:2500]
    made, recall = embeddings.near_duplicates(table(spark, x), goal=1.01)
    r = made.toPandas().sort_values("vec_id")
    s = brute(x)
    assert recall == 1.0 and r.n_links.tolist() == s.sum(1).tolist() and r.component_id.tolist() == roots(s).tolist()
    monkeypatch.setattr(embeddings, "BLOCK", 300)
    monkeypatch.setattr(embeddings, "COPIES", 2)  # in rounds
    again = embeddings.near_duplicates(table(spark, x), goal=1.01)[0].toPandas().sort_values("vec_id")
    assert again.n_links.tolist() == r.n_links.tolist() and again.component_id.tolist() == r.component_id.tolist()


def test_audit_sees_lost_links(spark):
    x = planted()
    nodes = common.written(embeddings.nodes_of(embeddings.keyed(table(spark, x))), "test-vectors")
    v = np.array([r.v for r in nodes.orderBy("node").select("v").collect()])
    n = nodes.orderBy("node").select("node", "n").toPandas()
    true = brute(v) @ n.n.to_numpy()
    counts = lambda c: spark.createDataFrame([(int(a), int(b)) for a, b in zip(n.node, c, strict=True) if b], "node long, found long")
    assert embeddings.audit(nodes, counts(true), 0.9) == 1.0
    assert embeddings.audit(nodes, counts(np.where(true > 100, true, true // 2)), 0.9) < 0.8  # the small groups lose half, the ball nothing
    assert embeddings.audit(nodes, counts(true * 0), 0.9) == 0.0


def test_audit_of_rare_links(spark):
    """Pairs that are lost as a whole are seen: the audit of 200 pairs among 20,000 vectors reads about the share that was found."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(20_000, 32))
    x[1:400:2] = x[0:400:2] + 0.05 * rng.normal(size=(200, 32))
    nodes = common.written(embeddings.nodes_of(embeddings.keyed(table(spark, x))), "test-vectors")
    v = np.array([r.v for r in nodes.orderBy("node").select("v").collect()])
    ids = [r.node for r in nodes.orderBy("node").select("node").collect()]
    links = brute(v).sum(1)
    linked = np.flatnonzero(links)
    assert len(linked) == 400
    of_pair = {}
    for i in linked:
        of_pair[i] = min(i, int(np.argmax(np.where(np.arange(len(v)) == i, -1, v @ v[i] / np.linalg.norm(v, axis=1)))))
    for kept in (1.0, 0.5, 0.05):
        stay = set(sorted(set(of_pair.values()))[: int(200 * kept)])
        found = spark.createDataFrame([(ids[i], 1) for i in linked if of_pair[i] in stay] or [(-1, 1)], "node long, found long")
        assert abs(embeddings.audit(nodes, found, 0.9) - kept) < 0.12


def test_odd_rows(spark):
    """Repeated and missing ids, other lengths, unusable vectors."""
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]),
        (1, [0.0, 1.0]),
        (None, [2.0, 0.0]),
        (None, [5.0, 5.0]),
        (4, [1.0, 0.01]),
        (5, None),
        (6, []),
        (7, [0.0, 0.0]),
        (8, [nan, 1.0]),
        (9, [inf, 1.0]),
    ]
    rows += [(10, [None, 1.0]), (11, [1.0, 0.0, 0.0]), (12, [2.0, 0.0, 0.0]), (13, [0.0, 3.0]), (13, [0.0, 3.0]), (14, [-1.0, 0.0]), (15, [1e-300, 0.0])]
    made = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))[0]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in made.collect()), key=repr)
    first, second = 3, 2  # [1, 0], [2, 0], [1, 0.01] and [1e-300, 0]; [0, 1] and [0, 3] twice
    expected = [
        (1, first, 1, True),
        (None, first, 1, False),
        (4, first, 1, False),
        (15, first, 1, False),
        (1, second, 1, True),
        (13, second, 1, False),
        (13, second, 1, False),
        (None, 0, None, False),
    ]
    expected += [(i, 0, i, True) for i in (5, 6, 7, 8, 9, 10, 14)] + [(11, 1, 11, True), (12, 1, 11, False)]
    assert got == sorted(expected, key=repr)
