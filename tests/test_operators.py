"""Edge rows of extraction, search, curation, transcripts, chunks, the index and the streams."""

import json

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import markdown as M
from lorekeep.operators import chunking, curation, extract, graph, index, search, transcripts
from lorekeep.sources import vault
from lorekeep.streaming import hooks


def notes(spark, **raw):
    return spark.createDataFrame([(p.replace("__", "/") + ".md", r) for p, r in raw.items()], "path string, raw string")


@pytest.mark.parametrize(
    ("raw", "key", "expected"),
    [
        ("no block", "a", None),
        ("---\na: 1\n", "a", None),
        ("---\na: x---y\n---\n", "a", "x"),
        ("---\na: 1\na: 2\n---", "a", "2"),
        ('---\na: "q"\n---', "a", "q"),
        ("---\na: b:c\n---", "a", "b:c"),
    ],
)
def test_frontmatter(spark, raw, key, expected):
    row = spark.createDataFrame([(raw,)], "raw string").select(M.value(M.frontmatter(F.col("raw")), key)).head()
    assert row[0] == expected


def test_lists(spark):
    for raw, expected in (("---\na: []\n---", []), ('---\na: [x, "y"]\n---', ["x", "y"]), ("---\na: z\n---", ["z"]), ("---\nb: z\n---", [])):
        assert spark.createDataFrame([(raw,)], "raw string").select(M.listed(M.frontmatter(F.col("raw")), "a")).head()[0] == expected


def test_links(spark):
    n = notes(
        spark,
        projects__a__memos__m="see [[t1]] and [[t1]] [[t1#s|x]] [[Al]] [[al]] [[#only]] [[b]] [[topics/t1.md]]",
        topics__t1="---\naliases: [Al]\n---\nx",
        projects__b___project="y",
    )
    docs = extract.documents(n)
    r = {x.link_text: x.target_path for x in extract.resolved(extract.links(n), docs).collect()}
    assert r == {
        "t1": "topics/t1.md",
        "t1#s": "topics/t1.md",
        "Al": "topics/t1.md",
        "al": None,
        "#only": None,
        "b": "projects/b/_project.md",
        "topics/t1.md": "topics/t1.md",
    }
    assert {x.path for x in graph.orphans(docs, extract.resolved(extract.links(n), docs)).collect()} == {"projects/a/memos/m.md"}


def test_tasks(spark):
    n = notes(spark, a="- [ ] early\n# One\n  - [X] done\n## Two\n- [x]\n- [ ] last")
    got = [(t.task_text, t.completed, t.section, t.line_number) for t in extract.tasks(n).orderBy("line_number").collect()]
    assert got == [("early", False, None, 1), ("done", True, "One", 3), ("last", False, "Two", 6)]


def test_keywords():
    assert search.keywords("why did we do it") == ["why", "did"]
    assert search.keywords("Alpha, beta & GAMMA a b c d e f") == ["alpha", "beta", "gamma"]
    assert len(search.keywords(" ".join(f"word{i}" for i in range(20)))) == 7
    assert search.keywords("a b") == ["a b"]


def test_normalized_and_fusion(spark):
    flat = spark.createDataFrame([("a", 1.0), ("b", 1.05)], "path string, score double")
    assert {r.score for r in search.normalized(flat).collect()} == {0.5}
    vec = spark.createDataFrame([("b", 0.2), ("c", 0.4)], "path string, distance double")
    got = {r.path: (round(r.score, 6), r.match_type) for r in search.rrf(flat, vec).collect()}
    assert got == {"b": (round(2 / 61, 6), "hybrid"), "a": (round(1 / 62, 6), "fts_only"), "c": (round(1 / 62, 6), "vector_only")}


def test_modes(spark, small):
    docs, chunks = search.indexed(vault.archive(spark, small)), vault.chunk_vectors(spark, small)
    for mode, kind in (("fts", "fts_only"), ("vector", "vector_only")):
        assert {r.match_type for r in search.hybrid(docs, chunks, "thing hand", [0.1] * 64, 5, mode=mode).collect()} == {kind}


def test_tiers_and_noise(spark):
    rows = [
        ("one", "f1", "p"),
        ("two", "f1", "p"),
        ("two", "f2", "p"),
        ("three", "f1", "p"),
        ("three", "f2", "p"),
        ("three", "f3", "p"),
        ("ready", "f1", "p"),
        ("ready", "f2", "q"),
        ("ready", "f3", "_topics"),
        *[("five", f"f{i}", "p") for i in range(5)],
        ("?x", "f", "p"),
        ("a/b", "f", "p"),
        ("20240101-x", "f", "p"),
        ("http://x", "f", "p"),
        ("12", "f", "p"),
        ("Topic", "f", "p"),
    ]
    r = curation.link_refs(spark.createDataFrame(rows, "link_text string, source_path string, project string"))
    assert {
        x.link: x.t for x in r.select("link", curation.tier(F.col("refs"), F.col("projects")).alias("t")).collect()
    } == {"one": "SEEDLING", "two": "MATURING", "three": "MATURING", "ready": "READY", "five": "OVERDUE"}


@pytest.mark.parametrize(
    ("args", "score"),
    [
        ((9, 9, 9, 20, 9, 1, 60, True, True, 0), 15 + 15 + 5 + 10 + 9 + 4 + 8 + 4),
        ((0, 0, 0, 0, 0, 0, 4, False, False, 9), 0),
        ((1, 0, 0, 1, 0, 0, 5, False, False, 1), 4),
    ],
)
def test_triage(spark, args, score):
    row = spark.range(1).select(curation.triage_score(*map(F.lit, args)).alias("s")).select("s", curation.grade(F.col("s")).alias("g")).head()
    assert row.s == score and row.g == ("high" if score >= 16 else "moderate" if score >= 9 else "low" if score >= 4 else "skip")


def test_messages(spark, tmp_path):
    lines = [
        {"type": "user", "timestamp": "2024-01-01T00:00:00Z", "message": {"content": "hi"}},
        {
            "type": "assistant",
            "timestamp": 1704067200000,
            "message": {
                "content": [{"type": "thinking", "thinking": "hm"}, {"type": "tool_use", "id": "t1", "name": "Bash"}, {"type": "text", "text": "yes"}]
            },
        },
        {
            "type": "user",
            "message": {
                "content": [
                    {"type": "tool_result", "tool_use_id": "t1", "content": "out", "is_error": True},
                    {"type": "tool_result", "tool_use_id": "t9", "content": "lost"},
                ]
            },
        },
    ]
    (tmp_path / "s.jsonl").write_text("\n".join([*map(json.dumps, lines), "", "{bad"]))
    m = vault.jsonl(spark, str(tmp_path / "s.jsonl"))
    assert vault.parse_errors(m).head()[1:] == (4, 1)
    b = transcripts.blocks(m.withColumn("seq", F.monotonically_increasing_id()))
    assert {(r.block, r.text) for r in b.collect()} >= {("text", "hi"), ("thinking", "hm"), ("text", "yes")}
    assert {
        r.id: (r.name, r.result, r.is_error) for r in transcripts.tool_calls(b).collect()
    } == {"t1": ("Bash", "out", True), "t9": ("unknown", "lost", False)}
    at = spark.createDataFrame(
        [("2024-01-01T00:00:00Z",), ("1704067200000",), ("x",)],
        "t string",
    ).select(transcripts.timestamp(F.col("t")).alias("t")).collect()
    assert at[0].t == at[1].t and at[2].t is None


def test_system_tags(spark):
    df = spark.createDataFrame([("a<system-reminder>x\ny</system-reminder>b\n\n\n\nc",)], "t string")
    assert df.select(transcripts.cleaned(F.col("t"))).head()[0] == "ab\n\nc"


def test_chunks():
    raw = "---\na: 1\n---\n" + "intro words here\n\n## One\n" + "\n\n".join("w " * 30 for _ in range(5)) + "\n### Two\nshort"
    made = chunking.markdown_chunks(raw, 50, 5)
    assert made[0] == ("frontmatter", "---\na: 1\n---") and all(len(t.split()) <= 50 + 5 for _, t in made[1:])
    assert sum(t.count("w") for _, t in made) >= 150
    assert chunking.markdown_chunks("") == [] and len(chunking.markdown_chunks("x " * 900)) == 1
    turns = chunking.turn_chunks("head\n## Turn 1\na\n## Turn 2\nb\n## Turn 3\nc", "[p]")
    assert [t.split("\n")[-1] for _, t in turns] == ["head", "a", "b", "c"]


def test_embedding_cache(spark):
    made = chunking.chunks(notes(spark, a="one", b="two", c="one"))
    cache = spark.createDataFrame(
        [("p", "m", made.where("content = 'one'").head().content_hash, [1.0])],
        "provider string, model string, content_hash string, embedding array<float>",
    )
    known, new = chunking.to_embed(made, cache, "p", "m")
    assert known.count() == 2 and [r.content for r in new.collect()] == ["two"]
    vectors = chunking.embedded(new, chunking.hash_embedder(8)).head().embedding
    assert abs(sum(x * x for x in vectors) - 1) < 1e-6


def test_incremental_equals_full(spark, tmp_path):
    before = notes(spark, projects__a__memos__x="# X\n[[y]]", projects__a__memos__y="- [ ] t", projects__a__memos__z="gone")
    after = notes(spark, projects__a__memos__x="# X2\n[[y]]", projects__a__memos__y="- [ ] t", projects__a__memos__w="new")
    old = index.full(before, str(tmp_path))
    a, b = index.incremental(after, old, str(tmp_path)), index.full(after, str(tmp_path))
    for t in index.TABLES:
        x, y = (sorted(map(str, index.read(v, t, spark).select(*sorted(index.read(b, t, spark).columns)).collect())) for v in (a, b))
        assert x == y, t
    plan = {r.path[-4]: r.action for r in spark.read.parquet(f"{a}/plan").collect()}
    assert plan == {"x": "updated", "y": "unchanged", "z": "deleted", "w": "new"}
    assert index.status(a, spark).where("table_name = 'documents'").head().row_count == 3


def test_vault(spark, tmp_path):
    for p, raw in {
        "projects/a/memos/m.md": "x",
        "projects/a/_project.md": "p",
        "projects/a/_x.md": "n",
        "projects/_templates/t.md": "n",
        "topics/t.md": "t",
        "topics/deep/t.md": "n",
        "projects/a/old.md": "---\nstatus: archived\n---",
    }.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(raw)
    assert {r.path for r in vault.markdown(spark, str(tmp_path)).collect()} == {"projects/a/memos/m.md", "projects/a/_project.md", "topics/t.md"}
    assert {r.path for r in vault.markdown(spark, str(tmp_path), keyword_only=True).collect()} >= {"projects/a/memos/m.md", "projects/a/old.md"}


def test_nudge_stream(spark, tmp_path):
    rows = [(f"s{i % 2}", i, i == 30 and i % 2 == 0) for i in range(80)]
    df = spark.createDataFrame(rows, "session_id string, n long, memo_saved boolean")
    df.coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("session_id string, n long, memo_saved boolean").json(str(tmp_path / "in"))
    q = hooks.nudges(stream.select("session_id", "memo_saved")).writeStream.format("memory").queryName("nudged").option(
        "checkpointLocation",
        str(tmp_path / "ck"),
    ).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("nudged").collect()}
    assert got == {tuple(r) for r in hooks.nudges_batch(df, 20, 15, "n").collect()} == {("s1", 20), ("s1", 35)}


def test_phases_stream(spark, tmp_path):
    df = spark.createDataFrame(
        [("s", "end", "2024-01-01 00:00:00"), ("s", "end", "2024-01-01 00:01:00"), ("s", "memo", "2024-01-01 00:02:00")],
        "session_id string, phase string, t string",
    )
    df.coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("session_id string, phase string, t string").json(str(tmp_path / "in")).withColumn("ts", F.to_timestamp("t"))
    q = hooks.phases_once(stream).writeStream.format("memory").queryName("phases").option(
        "checkpointLocation",
        str(tmp_path / "ck"),
    ).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("phases").count() == 2
