"""Data sources of archives: pruned listings, bounded partitions, first lines only, queues by commits."""

import json

import pytest
from pyspark.sql import functions as F

from lorekeep.sources import archives, vault
from lorekeep.streaming import hooks

JOBS = "path string, enqueued_at timestamp"


@pytest.fixture
def notes(tmp_path):
    files = {
        "projects/a/_project.md": "overview",
        "projects/a/memos/x.md": "---\nstatus: archived\n---\nold",
        "projects/a/memos/y.md": "y",
        "projects/a/memos/_hidden.md": "no",
        "projects/a/_templates/t.md": "no",
        "projects/a/_views/v.md": "view",
        "projects/b/memos/deep/z.md": "z",
        "projects/b/transcripts/bad.md": None,
        "projects/b/transcripts/note.txt": "no",
        "topics/t.md": "t",
        "topics/sub/u.md": "no",
        "other/o.md": "no",
    }
    for path, text in files.items():
        at = tmp_path / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(b"a\xffb" if text is None else text.encode())
    (tmp_path / "projects/a/memos/empty.md").touch()
    return str(tmp_path)


def test_notes(spark, notes):
    got = {r.path: r.raw for r in vault.markdown(spark, notes).collect()}
    assert got == {
        "projects/a/_project.md": "overview", "projects/a/memos/y.md": "y",
        "projects/b/memos/deep/z.md": "z", "projects/b/transcripts/bad.md": "a�b", "topics/t.md": "t",
    }
    words = {r.path for r in vault.markdown(spark, notes, keyword_only=True).collect()}
    assert words == set(got) - {"projects/a/_project.md"} | {"projects/a/memos/x.md", "projects/a/_views/v.md"}
    assert vault.markdown(spark, f"{notes}/none").count() == 0


def test_folders_are_pushed(spark, notes):
    read = lambda: archives.registered(spark).read.format(archives.NOTES).load(notes)
    every = {(r.path, r.project, r.folder) for r in read().collect()}
    for test in ("project = 'b'", "folder = 'memos'", "folder IN ('memos', 'topics')", "project = 'a' AND folder = 'memos'", "project IS NULL", "folder = 'topics'", "project = 'a' AND project = 'b'"):
        want = spark.createDataFrame(sorted(every, key=str), "path string, project string, folder string").where(test)
        assert {tuple(r) for r in read().where(test).select("path", "project", "folder").collect()} == {tuple(r) for r in want.collect()}, test
    reader = archives.NoteReader({"path": notes})
    rest = list(reader.pushFilters([archives.EqualTo(("project",), "b"), archives.EqualTo(("path",), "x")]))
    assert [f.attribute for f in rest] == [("path",)]
    assert {f for p in reader.partitions() for f, _, _ in p.files} == {"projects/b/memos/deep/z.md", "projects/b/transcripts/bad.md"}


def test_partitions_are_bounded(monkeypatch):
    monkeypatch.setattr(archives, "PART_BYTES", 10)
    monkeypatch.setattr(archives, "PART_FILES", 3)
    sizes = [4, 5, 2, 30, 1, 1, 1, 1]
    made = [[n for _, _, n in p.files] for p in archives.packed(("x", 0, n) for n in sizes)]
    assert made == [[4, 5], [2], [30], [1, 1, 1], [1]]
    assert [p.files for p in archives.packed([])] == [[]]


def test_first_lines_only(spark, tmp_path, monkeypatch):
    (tmp_path / "p").mkdir()
    (tmp_path / "q").mkdir()
    cases = {"p/few": "a\n\n  \nb", "p/many": "line\n" * 500, "p/long": "x" * 200_000 + "\r\ny\n", "q/blank": "\n \n" * 9, "q/tiny": "z"}
    for name, text in cases.items():
        (tmp_path / f"{name}.jsonl").write_text(text, newline="")
    got = {(r.project, r.session): (r.bytes, r.lines) for r in vault.log_samples(spark, str(tmp_path), min_bytes=2).collect()}
    want = {tuple(k.split("/")): (len(t), min(11, sum(bool(x.strip(" \r")) for x in t.split("\n")))) for k, t in cases.items() if len(t) > 1}
    assert got == want
    assert {r.session for r in vault.log_samples(spark, str(tmp_path), min_bytes=2).where("project = 'q'").collect()} == {"blank"}
    reads = []

    class File:
        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

        def read(self, n):
            reads.append(n)
            return b"line\n" * 100

    class Endless:
        open_input_file = staticmethod(lambda path: File())

    assert archives.LogReader({"path": "x"}).lines(Endless, "x", 11) == 11 and len(reads) == 1


def jobs(spark, *rows):
    return spark.createDataFrame([(p, t) for p, t in rows], "path string, at long").select("path", F.timestamp_seconds("at").alias("enqueued_at"))


def test_queue(spark, tmp_path):
    root = str(tmp_path / "q")
    assert hooks.stored(spark, root, JOBS).count() == 0
    hooks.enqueued(jobs(spark, ("a", 5), ("b", 3), ("c", 9)), root)
    hooks.enqueued(jobs(spark, ("a", 1), ("d", 7)), root)
    assert hooks.stored(spark, root).count() == 5
    taken = hooks.taken(spark, root, jobs(spark, ("d", 0)), 2)
    assert [r.path for r in taken.collect()] == ["a", "b"]
    assert [(r.path, r.enqueued_at.timestamp()) for r in hooks.stored(spark, root).collect()] == [("c", 9.0)]
    hooks.enqueued(jobs(spark, ("e", 11)), root)
    assert archives.swept(root) > 0 and archives.swept(root) == 0
    assert {r.path for r in hooks.stored(spark, root).collect()} == {"c", "e"}


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    root = tmp_path / "q"
    hooks.enqueued(jobs(spark, ("a", 5)), str(root))
    before = {p.name for p in root.rglob("*")}
    bad = spark.range(0, 4000, 1, 4).select(F.when(F.col("id") == 3900, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("string").alias("path"))
    with pytest.raises(Exception, match="no"):
        hooks.enqueued(bad.withColumn("enqueued_at", F.timestamp_seconds(F.lit(1))), str(root))
    assert {p.name for p in root.rglob("*") if not p.name.endswith(".crc")} == before
    assert hooks.stored(spark, str(root)).count() == 1


def test_queue_as_stream(spark, tmp_path):
    """A stream into a queue, a stream out of it: each row once, a batch written again isn't added, a replacing commit brings nothing new."""
    root, schema = str(tmp_path / "q"), "session_id string, at long"
    for rows in ([("a", 1), ("b", 2), ("a", 5)], [("a", 3), ("c", 9)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        marks = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        assert hooks.appended(marks, root, str(tmp_path / "ck")).awaitTermination(120)
    state = {r.session_id: (r.attempts, r.last_attempt) for r in hooks.queue_state(hooks.stored(spark, root)).collect()}
    assert state == {"a": (3, 5), "b": (1, 2), "c": (1, 9)}
    commits = archives.Commits(root)
    assert [commits.read(n)["batch"] for n in commits.numbers()] == [0, 1]
    commits.add([], json.dumps({}), batch=1)
    assert len(commits.numbers()) == 2

    def out():
        read = archives.registered(spark).readStream.format(archives.QUEUE).load(root)
        query = read.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        return sorted(tuple(r) for r in spark.read.schema(schema).parquet(str(tmp_path / "out")).collect())

    first = out()
    assert first == [("a", 1), ("a", 3), ("a", 5), ("b", 2), ("c", 9)]
    hooks.stored(spark, root).where("session_id = 'c'").write.format(archives.QUEUE).mode("overwrite").save(root)
    hooks.enqueued(spark.createDataFrame([("d", 4)], schema), root)
    assert out() == sorted([*first, ("d", 4)])
    assert sorted(r.session_id for r in hooks.stored(spark, root).collect()) == ["c", "d"]
