"""The stored index, the query language, nearest vectors, chunk routes, names, files, memo extracts and streams of whole sessions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.functions import markdown as M
from lorekeep.operators import chunking, index, search, transcripts
from lorekeep.sources import store, vault
from lorekeep.streaming import hooks


def value(spark, c):
    return spark.range(1).select(c.alias("x")).head().x


TEXTS = {
    "a": "The quick brown fox jumps over the lazy dog",
    "b": "quick thinking, brown bears",
    "c": "a lazy afternoon with foxes",
    "d": "nothing of note",
    "e": "",
}


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ("quick brown", "ab"), ("quick AND brown", "ab"), ("quick OR lazy", "abc"), ("lazy NOT fox", "c"), ("fox*", "ac"), ('"quick brown"', "a"), ('"brown bears"', "b"),
        (
            "(quick OR lazy) NOT (bears OR dog)",
            "c",
        ), ("quick OR lazy NOT fox", "abc"), ("NEAR(quick jumps, 2)", "a"), ("NEAR(quick dog, 2)", ""), ("NEAR(dog quick, 10)", "a"),
        ('NEAR("quick brown" jumps, 1)', "a"), ("title:one fox", "a"), ("title:o*", "ac"), ('title:"no such"', ""), ("one", "ac"), ("content:one", ""), ("lazy (fox OR with)", "ac"),
    ],
)
def test_condition(spark, query, expected):
    docs = spark.createDataFrame([(k, v, "one" if k in "ac" else "two") for k, v in TEXTS.items()], "path string, content string, title string")
    got = "".join(sorted(r.path for r in search.matches(docs, query, "content", "title").collect()))
    assert got == expected


def test_stored_index(spark, tmp_path):
    """Scores from the stored index are those of a scan, narrowed or not, and a search reads its terms only."""
    draw = random.Random(2)
    docs = spark.createDataFrame(
        [
            (
                f"d{i}",
                " ".join(draw.choices("alpha beta gamma delta eps the".split(), k=draw.randrange(1, 30))),
                "x" if i % 3 else "y",
            ) for i in range(300)
        ],
        "path string, content string, type string",
    )
    search.write_postings(search.postings(docs), str(tmp_path / "p"))
    search.catalog(docs).write.parquet(str(tmp_path / "c"))
    ix = search.Index(spark.read.parquet(str(tmp_path / "c")), spark.read.parquet(str(tmp_path / "p")))
    scores = lambda df: {r.path: round(r.score, 9) for r in df.collect()}
    for terms in (["alpha"], ["alpha", "eps", "missing"], ["the", "the"]):
        assert scores(search.bm25(ix, terms)) == scores(search.bm25_scan(docs, terms)) != {}
        assert scores(search.bm25(ix, terms, F.col("type") == "y")) == scores(search.bm25_scan(docs.where("type = 'y'"), terms))
    plan = search.bm25(ix, ["alpha", "eps"])._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "In(term, [alpha,eps])" in plan


def test_postings_of_hot_terms(spark, tmp_path):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    docs = spark.createDataFrame([(f"d{i:05d}", f"the w{i}") for i in range(4000)], "path string, content string")
    search.write_postings(search.postings(docs), str(tmp_path / "p"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    files = spark.read.parquet(str(tmp_path / "p")).where("term = 'the'").groupBy(F.input_file_name()).count().count()
    assert files > 1


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 12)).round(1)
    x[100:140] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    asked = [0, 7, 450, 899]
    d = np.sqrt(((x[asked][:, None] - x) ** 2).sum(2)).round(9)
    expected = {(q, i): d[k, i] for k, q in enumerate(asked) for i in np.lexsort((np.arange(900), d[k]))[:9]}
    queries = spark.createDataFrame([(q, x[q].tolist()) for q in asked], "query long, v array<double>")
    for made in (search.nearest_many(df, [(q, x[q].tolist()) for q in asked], 9), search.nearest_of_all(df, queries, 9, block=2, part=200)):
        got = {(r["query"], r.vec_id): r.distance for r in made.collect()}
        assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-8 for k in got)
    one = [r.vec_id for r in search.nearest(df, x[7].tolist(), 5).collect()]
    assert set(one) == {i for q, i in list(expected) if q == 7} & set(one) and len(one) == 5
    cosine = search.nearest(df, x[7].tolist(), 3, "cosine").collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert np.allclose([r.distance for r in cosine], np.sort(1 - u @ u[7])[:3])
    odd = spark.createDataFrame([(1, None), (2, [1.0]), (3, x[7].tolist())], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in search.nearest(odd, x[7].tolist(), 5).collect()] == [3]


def test_windows(spark):
    words = [f"w{i}" for i in range(200)]
    words[120], words[125], words[10] = "Alpha,", "beta", "alpha"
    docs = spark.createDataFrame([("a", " ".join(words)), ("b", "no such words"), ("c", "")], "path string, content string")
    got = {r.path: r.snippet for r in search.best_windows(docs, ["alpha", "beta"], 20).collect()}
    assert got["a"].startswith("...w106 ") and ">>>Alpha,<<<" in got["a"] and ">>>beta<<<..." in got["a"] and len(got["a"].split()) == 20
    assert got["b"] == "no such words" and got["c"] == ""


def test_results(spark):
    found = spark.createDataFrame([("p", 0.123456, "hybrid", "T"), ("q", 0.5, "fts_only", "U")], "path string, score double, match_type string, title string")
    assert {r.json for r in search.as_json(found, "path", "score").collect()} == {'{"path":"p","score":0.1235}', '{"path":"q","score":0.5}'}
    assert {r.line for r in search.as_text(found).collect()} == {"0.1235  hybrid       T (p)", "0.5000  fts_only     U (q)"}
    assert {(r.vector_score, r.keyword_score) for r in search.displayed(found).collect()} == {(0.5, 0.5), (0.0, 0.5)}


def test_routes_and_chunks(spark):
    raws = {
        "projects/a/transcripts/t": "---\ntype: memo\n---\nx",
        "projects/a/auto-memory/m": "y",
        "m": "---\ntype: memo\nproject: p\n---\nbody",
        "n": "---\ntype: odd\n---\nz",
        "o": "",
        "c": "---\ntype: concept\ntitle: T\n---\n" + "w " * 2000,
    }
    notes = spark.createDataFrame(list(raws.items()), "path string, raw string")
    routes = {r.path: r.x for r in notes.select("path", chunking.route(F.col("path"), F.col("raw")).alias("x")).collect()}
    assert routes == {p: chunking.content_type(p, r) for p, r in raws.items()} == dict(
        zip(raws, ["transcript", "auto-memory", "memo", "markdown", "markdown", "concept"], strict=True)
    )
    made = chunking.chunks(notes).toPandas()
    assert made[made.doc_path == "m"].content.tolist() == [
        "[Project: p | Title: untitled]\n\n" + raws["m"]
    ] and made[made.doc_path == "m"].chunk_type.tolist() == ["memo"]
    assert len(made[made.doc_path == "c"]) == 2 and set(made[made.doc_path == "c"].chunk_type) == {"frontmatter", "content"}
    long = "**Result:**\n```" + "x" * 300 + "y" * 300 + "```\n**Result:**\n```short```"
    cut = value(spark, chunking.results_shortened(F.lit(long)))
    assert cut == "**Result:**\n```" + "x" * 300 + "y" * 50 + "\n\n[...truncated 150 chars...]\n\n" + "y" * 100 + "```\n**Result:**\n```short```"
    turn = spark.createDataFrame([("projects/a/transcripts/u", "## Turn 1\n" + long), ("m", long)], "path string, raw string")
    assert {r.doc_path: "[...truncated" in r.content for r in chunking.chunks(turn).collect()} == {"projects/a/transcripts/u": True, "m": False}
    plain = "a ```" + "z" * 900 + "``` b **Result:**\n```" + "w" * 900
    assert value(spark, chunking.results_shortened(F.lit(plain))) == plain  # no mark before it, no fence behind it
    assert value(spark, chunking.first_words(F.lit(" a  b c d"), 3)) == " a  b c" and value(spark, chunking.last_words(F.lit("a b\n c d "), 3)) == "b\n c d "


def test_vectors_and_cache(spark, tmp_path):
    calls = []

    def embed(texts):
        return [[float(len(t)), 1.0] for t in texts]

    notes = lambda *rows: spark.createDataFrame(list(rows), "path string, raw string")
    old = index.full(notes(("a", "one"), ("b", "two")), str(tmp_path), (embed, "p", "m"))
    assert {r.table_name: r.row_count for r in index.status(old, spark).collect()}["documents"] == 2

    def refuse(texts):
        assert set(texts) == {"three"}, texts
        return embed(texts)

    new = index.incremental(notes(("a", "one"), ("c", "three")), old, str(tmp_path), (refuse, "p", "m"))
    assert {r.doc_path: r.embedding for r in index.read(new, "vectors", spark).collect()} == {"a": [3.0, 1.0], "c": [5.0, 1.0]}
    assert index.read(new, "cache", spark).count() == 3 and calls == []
    found = search.bm25(index.searchable(new, spark), ["three"]).collect()
    assert [r.path for r in found] == ["c"]


def test_names(spark):
    names = {
        "-Users-alice-Documents-my-app": "my-app",
        "-home-bob-project": "project",
        "-Users-alice-Desktop": "~Desktop",
        "-Users-alice": "~home",
        "-home-bob": "~home",
        "-srv-data": "srv-data",
        "-": "unknown",
        "-Users-alice-code-x": "code-x",
    }
    for name, expected in names.items():
        assert value(spark, M.folder_project(F.lit(name))) == expected, name
    remotes = {"git@host.io:user/repo.git": "repo", "https://host.io/user/my.repo": "my.repo", "https://host.io/user/r.git": "r", "ftp://x/y/z": None, "": None}
    for url, expected in remotes.items():
        assert value(spark, M.remote_project(F.lit(url))) == expected, url
    safe = {"a b/c": "a_b_c", "__x__": "x", "Tmp": "_uncategorized", "": "_uncategorized", "é-1": "é-1", "z" * 60: "z" * 50}
    for name, expected in safe.items():
        assert value(spark, M.project_name(F.lit(name))) == expected, name
    assert value(spark, M.unique_name(F.lit("a b"), F.lit("/x"), F.lit(True))) == "a_b-" + __import__("hashlib").md5(b"/x").hexdigest()[:6]


def test_stamped(spark):
    fields = {"input_tokens": F.lit(5), "output_tokens": F.lit(0), "cached": F.lit(None).cast("int")}
    for raw, expected in {
        "---\na: 1\n---\nx --- y": "---\na: 1\ninput_tokens: 5\n---\nx --- y",
        "no": "no",
        "---\ninput_tokens: 1\n---\n": "---\ninput_tokens: 1\n---\n",
    }.items():
        assert value(spark, M.stamped(F.lit(raw), fields)) == expected


def test_files(spark, tmp_path):
    files = spark.createDataFrame([("projects/a/memos/x.md", "text é"), ("topics/t.md", ""), ("topics/u.md", None)], "path string, raw string")
    assert {r.path: r.bytes for r in store.write_files(files, str(tmp_path)).collect()} == {"projects/a/memos/x.md": 7, "topics/t.md": 0, "topics/u.md": 0}
    assert {
        r.path: r.raw for r in vault.markdown(spark, str(tmp_path)).collect()
    } == {"projects/a/memos/x.md": "text é"}  # Spark's reader leaves empty files out
    of = str(tmp_path / "topics")
    kept = [store.kept(spark, f"{tmp_path}:n", spark.range(3).write.parquet, of) for _ in range(2)]
    assert [df.count() for df in kept] == [3, 3] and kept[0].inputFiles() == kept[1].inputFiles()
    (tmp_path / "topics/new.md").write_text("x")  # the table below has changed
    assert store.kept(spark, f"{tmp_path}:n", spark.range(4).write.parquet, of).count() == 4
    with pytest.raises(ValueError, match="archive"):
        vault.read_note(files, "../secret")


def test_memo_extract(spark):
    parts = [
        ("s", 1, 0, 0, "user", "u" * 900),
        ("s", 1, 0, 1, "user", "v" * 900),
        ("s", 1, 1, 0, "thinking", "t" * 600),
        ("s", 1, 1, 1, "thinking", "other"),
        ("s", 1, 2, 0, "response", "ok"),
        ("s", 1, 2, 1, "tool", "Bash: `x`"),
        ("s", 1, 2, 2, "tool", "Glob (ERROR)"),
        ("s", 2, 3, 0, "user", "again"),
        ("s", 3, 4, 0, "response", "r" * 3000),
        ("r", 1, 0, 0, "tool", "Read: /f"),
    ]
    df = spark.createDataFrame(parts, "session string, turn int, seq int, nth int, kind string, text string")
    whole = {(r.session, r.turn): r.text for r in transcripts.memo_extract(df).collect()}
    user = "**User:** " + ("u" * 900 + "\n" + "v" * 900)[:1000] + "..."
    assert whole["s", 1] == "\n".join([user, "**Thinking:** " + "t" * 500 + "...", "**Response:** ok", "**Tools:** Bash: `x`, Glob (ERROR)"])
    assert whole["s", 2] == "**User:** again" and whole["s", 3] == "**Response:** " + "r" * 1500 + "..." and whole["r", 1] == "**Tools:** Read: /f"
    short = {(r.session, r.turn): r.text for r in transcripts.memo_extract(df, 1700).collect()}
    assert short["s", 3] == "\n[...1 more turns truncated...]" and len(short) == 4
    none = {(r.session, r.turn): r.text for r in transcripts.memo_extract(df, 100).collect()}
    assert none["s", 1] == "\n[...3 more turns truncated...]" and ("s", 2) not in none


def test_sessions_stream(spark, tmp_path):
    rows = [("s1", i, ("user", "assistant")[i % 2], f"t{i}", i * 60) for i in range(8)] + [("s2", 0, "user", "short", 0)]
    schema = "session string, seq long, role string, text string, at long"
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in")).withColumn("ts", F.timestamp_seconds("at"))
    hooks.archived(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    notes = spark.read.parquet(str(tmp_path / "out")).orderBy("session", "part").collect()
    assert {r.session for r in notes} == {"s1"} and len(notes) == 9
    text = "".join(r.raw for r in notes)
    assert text.startswith("---\ntype: transcript\nsession_id: s1\ndate: 1970-01-01\nturns: 4\n") and "## Turn 2\n\n**User:** t2\n\n**Assistant:** t3\n" in text


def test_nudges_by_counting():
    """The state's closed form against one event at a time."""
    draw = random.Random(8)
    for _ in range(200):
        saved = [draw.random() < 0.02 for _ in range(60)]
        count, last, seen, fired = 0, 0, False, []
        for s in saved:
            count += 1
            seen = seen or s
            if not seen and (count >= 20 if not last else count - last >= 15):
                last = count
                fired.append(count)
        counts = np.arange(1, 61)
        unsaved = ~np.logical_or.accumulate(np.array(saved))
        assert fired == counts[unsaved & (counts >= 20) & ((counts - 20) % 15 == 0)].tolist()


def test_queue_stream(spark, tmp_path):
    schema = "session_id string, at long"
    first, second = [("a", 1), ("b", 2), ("a", 5)], [("a", 3), ("c", 9)]
    for n, rows in enumerate((first, second)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        hooks.upserted(stream, str(tmp_path / "q"), str(tmp_path / "ck")).awaitTermination(120)
        got = {r.session_id: (r.attempts, r.last_attempt) for r in spark.read.parquet(str(tmp_path / f"q/v={n}")).collect()}
        assert got == ({"a": (2, 5), "b": (1, 2)} if n == 0 else {"a": (3, 5), "b": (1, 2), "c": (1, 9)})


def test_parts(spark, tmp_path):
    rows = [("a/x.md", n, f"part {n}\n") for n in range(300)] + [("b.md", 0, None), ("b.md", 2, "z"), ("b.md", 1, "é")]
    made = store.write_parts(spark.createDataFrame(rows, "path string, part long, raw string").repartition(6), str(tmp_path))
    assert {r.path: r.bytes for r in made.collect()}["b.md"] == 3
    assert (tmp_path / "a/x.md").read_text() == "".join(f"part {n}\n" for n in range(300)) and (tmp_path / "b.md").read_text() == "éz"
