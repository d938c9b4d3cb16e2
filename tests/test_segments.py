"""An index in segments against full builds of the same states."""

import random
from pathlib import Path

from lorekeep.operators import index, search


def table(spark, state):
    return spark.createDataFrame(sorted(state.items()), "path string, raw string")


def same(spark, a, b):
    for t in index.TABLES:
        x, y = index.read(a, t, spark), index.read(b, t, spark)
        assert sorted(map(str, x.select(*sorted(y.columns)).collect())) == sorted(map(str, y.select(*sorted(y.columns)).collect())), t


def test_segments_equal_full_builds(spark, tmp_path):
    """New, changed, deleted and restored notes over several builds, compacted on the way; searches use the statistics of what holds."""
    draw, root = random.Random(4), str(tmp_path)
    text = lambda: f"# {draw.choice('ABC')}\n[[y{draw.randrange(5)}]] {' '.join(draw.choices('alpha beta gamma'.split(), k=8))}\n- [ ] t{draw.randrange(9)}\n"
    state = {f"projects/p/memos/n{i:03d}.md": text() for i in range(60)}
    lost = {}
    version = index.full(table(spark, state), root)
    for step in range(4):
        for path in draw.sample(sorted(state), 4):
            lost[path] = state.pop(path)
        state |= {p: text() for p in draw.sample(sorted(state), 5)} | {f"projects/p/memos/m{step}{i}.md": text() for i in range(3)}
        if step == 2:
            state |= dict(list(lost.items())[:3])
        version = index.incremental(table(spark, state), version, root)
        if step == 2:
            version = index.compacted(version, root)
    fresh = index.full(table(spark, state), root)
    same(spark, version, fresh)
    same(spark, index.compacted(version, root, ratio=10**6), fresh)
    scores = lambda v: {r.path: round(r.score, 9) for r in search.bm25(index.searchable(v, spark), ["alpha", "gamma"]).collect()}
    assert scores(version) == scores(fresh) != {}
    assert 1 < len(index.segments(version, spark)) < 5


def size(path):
    return sum(f.stat().st_size for f in Path(path).rglob("*.parquet"))


def test_a_build_writes_what_changed(spark, tmp_path):
    draw, root = random.Random(6), str(tmp_path)
    words = [f"w{i}" for i in range(3000)]
    state = {f"projects/p/memos/n{i:04d}.md": " ".join(draw.choices(words, k=120)) for i in range(2000)}
    old = index.full(table(spark, state), root)
    for path in draw.sample(sorted(state), 20):
        state[path] += " changed"
    new = index.incremental(table(spark, state), old, root)
    first, second = index.segments(new, spark)
    assert (first.rows, second.rows) == (2000, 20)
    for t in ("documents", "postings"):
        rows = [spark.read.parquet(f"{x.path}/{t}").count() for x in (first, second)]
        assert rows[1] < 0.015 * rows[0]
        assert size(f"{second.path}/{t}") < 0.1 * size(f"{first.path}/{t}")  # with the files' footers
    assert index.compacted(new, root) == new  # small beside the first: nothing to merge yet


def test_stream_of_changes(spark, tmp_path):
    schema, root = "path string, raw string", str(tmp_path / "ix")
    batches = [[("a", "one"), ("b", "two")], [("a", "three"), ("c", "four")], [("b", None)]]
    for nth, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"), ignoreNullFields=False)
        index.followed(spark.readStream.schema(schema).json(str(tmp_path / "in")), root, str(tmp_path / "ck")).awaitTermination(120)
        assert len(index.segments(f"{root}/batch-{nth}", spark)) == nth + 1
    got = {r.path: r.content.strip() for r in index.read(f"{root}/batch-2", "documents", spark).collect()}
    assert got == {"a": "three", "c": "four"}
