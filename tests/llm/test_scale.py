"""Ways that only large tables take, on small ones: many sources, many probes, hot lines; and the shared folder."""

import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import common, lines, mixing


def test_numbered_by_ranges(spark, monkeypatch):
    draw = random.Random(3)
    rows = [(i, draw.randrange(10), draw.randrange(1000)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, a long, b long").repartition(7)
    order = [F.col("a").desc(), F.col("id")]
    few = common.numbered(df, order, ("b",)).toPandas().sort_values("id").reset_index(drop=True)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 100)
    many = common.numbered(df, order, ("b",)).toPandas().sort_values("id").reset_index(drop=True)
    assert (few[["id", "nth", "b_before"]] == many[["id", "nth", "b_before"]]).all().all()
    told = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert [r[0] for r in told] == few.sort_values("nth").id.tolist()
    assert np.cumsum([0, *[r[2] for r in told]])[:-1].tolist() == few.sort_values("nth").b_before.tolist()


def water(sizes, weights=(5, 2, 1), cap=3):
    """Targets by filling until none is above its cap, one source at a time."""
    names = sorted(sizes)
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        share = {n: left * weight[n] / sum(weight[x] for x in open_) for n in open_}
        over = [n for n in open_ if share[n] >= cap * sizes[n]]
        if not over:
            return target | share
        for n in over:
            target[n] = float(cap * sizes[n])
            left -= target[n]
            open_.remove(n)
    return target


@pytest.mark.parametrize("rows", [10**6, 50])
def test_targets(spark, monkeypatch, rows):
    draw = random.Random(5)
    sizes = {f"s{i:04d}": int(10 ** draw.uniform(0, 5)) for i in range(400)}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
    got = mixing.source_targets(df).toPandas().set_index("source").target
    expected = water(sizes)
    assert all(abs(got[n] - expected[n]) <= 1e-6 * expected[n] for n in sizes) and abs(got.sum() - sum(sizes.values())) < 1


def test_lines_with_many_copies_of_shards(spark, monkeypatch):
    """Few repeated lines among many others, one of them in most documents; rows without an id."""
    draw = random.Random(9)
    hot, some = "this line stands in almost every document", [f"a line that some documents have, number {i}" for i in range(30)]
    docs = []
    for i in range(2000):
        own = [f"{draw.random()} only this document has this line" for _ in range(4)] + draw.sample(some, 2) * 2 + [hot] * (i % 5 > 0) + ["short"]
        draw.shuffle(own)
        docs.append((None if i % 3 == 0 else i, "\n".join(own)))
    held, seen = {}, {}
    for i, t in docs:
        for k in {x.strip().lower() for x in t.split("\n")}:
            seen[k] = seen.get(k, 0) + 1
            held[k] = max(held.get(k, -1), -1 if i is None else i)
    stays = lambda i, x: len(x) < 20 or seen[x.lower()] < 3 or held[x.lower()] == (-1 if i is None else i)
    expected = sorted((-1 if i is None else i, "\n".join(x for x in t.split("\n") if stays(i, x))) for i, t in docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    for probes in (lines.GROUP_PROBES, 100):
        monkeypatch.setattr(lines, "GROUP_PROBES", probes)
        got = lines.deduplicated(df).select(F.coalesce("doc_id", F.lit(-1)).alias("i"), "kept_text").collect()
        assert sorted((r.i, r.kept_text) for r in got) == expected


def test_shared_folder_is_asked_for():
    unset, cluster = SimpleNamespace(get=lambda *a: None), SimpleNamespace(master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(SimpleNamespace(conf=unset, sparkContext=cluster))


def test_free_names(spark):
    df = spark.createDataFrame([(1, 2)], "Gone long, gone_ long")
    assert common.free("gone", df) == "gone__" and common.free("other", df) == "other"
