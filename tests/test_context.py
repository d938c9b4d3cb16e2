"""Session context, kept copies, rendering, triage signals and curation reports on small fixtures."""

import json
import math

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import formats
from lorekeep.functions import markdown as M
from lorekeep.functions.words import folded, stem
from lorekeep.operators import context, curation, extract, search, sync, transcripts


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t"))).head()[0]


def notes(spark, **raw):
    return spark.createDataFrame([(p.replace("__", "/") + ".md", r) for p, r in raw.items()], "path string, raw string")


def test_overview(spark):
    assert one(spark, "# P\n## Overview\na\n\n### b\n## Next\nc", M.overview) == "## Overview\na\n\n### b"
    assert one(spark, "no", M.overview) is None and one(spark, None, M.overview) is None


def test_query_sections(spark):
    block = "```dataview\nTASK FROM x\n```\n"
    assert one(spark, f"a\n## Connected Topics\n\n{block}\n## B\nb", M.without_query_sections) == "a\n## B\nb"
    assert "Connected" in one(spark, f"a\n## Connected Topics\ntext\n{block}## B", M.without_query_sections)
    assert one(spark, f"a\n## Open Threads\n{block}", M.without_query_sections) == "a\n"
    kept = f"a\n## Open Threads\n- [ ] x\n{block}"
    assert one(spark, kept, M.without_query_sections) == kept
    assert "Open" in one(spark, "## Open Threads\n```dataview\nLIST\n```\n", M.without_query_sections)
    assert one(spark, "a\n## Recent Transcripts (Last 7 Days)\nx\n## B", M.without_query_sections) == "a\n## B"


def test_topics(spark):
    raw = '---\ntype: memo\ntopics:\n  - "[[?new]]"\n  - "[[old]]"\n  - plain\nstatus: x\n---\n[[?stays]]'
    assert one(spark, raw, M.plain_topics) == "---\ntype: memo\ntopics:\n  - new\n  - old\n  - plain\nstatus: x\n---\n[[?stays]]"
    assert one(spark, raw, M.topics) == ["new", "old", "plain"]
    assert one(spark, "---\ntopics: [a, b]\n---", M.topics) == ["a", "b"]
    assert one(spark, "none", M.topics) == [] and one(spark, "none", M.plain_topics) == "none"


def test_highlighted(spark):
    assert one(spark, "one two Three, four", lambda c: M.highlighted(c, ["three"], 2)) == "...>>>Three,<<< four"
    assert one(spark, "one two three", lambda c: M.highlighted(c, ["x"], 2)) == "one two..."
    assert one(spark, "", lambda c: M.highlighted(c, ["x"])) == ""


def test_formatted(spark):
    fields = {"a": F.lit("x"), "b": F.lit(True), "c": M.list_text(F.array(F.lit("p"), F.lit("q"))), "d": F.lit(None)}
    assert one(spark, "", lambda _: M.formatted(fields)) == "---\na: x\nb: true\nc: [p, q]\n---"


def test_context(spark):
    memo = "---\ntitle: T{0}\ndate: 2024-01-0{0}\n---\n## Key Decisions\nkeep {0}\n## Open Threads\n" + "- [ ] t\n" * 6
    raw = {f"projects__p__memos__m{i}": memo.format(i) for i in range(1, 8)}
    docs = extract.documents(notes(spark, **raw, projects__p___project="---\ntype: project\n---\n## Overview\nabout\n## X\n", projects__q__memos__n="empty"))
    assert {r.project: r.open_threads for r in context.open_counts(docs).collect()} == {"p": 30, "q": 0}
    threads = context.open_threads(docs).orderBy("nth").collect()
    assert [(r.title, len(r["items"])) for r in threads] == [("T7", 4), ("T6", 4), ("T5", 4)]
    std = {r.project: r.memos for r in context.standard(docs).collect()}
    assert std == {"p": "- T7\n- T6\n- T5", "q": "- n"}
    whole = {r.project: r.context for r in context.full(docs).collect()}
    assert whole["p"].startswith("## Overview\nabout\n\n---\n\nFrom T7:\n- [ ] t") and "**T7** (2024-01-07)\nkeep 7" in whole["p"]
    assert whole["q"] == "**n**"
    assert {len(r.context.split()) for r in context.full(docs, 5).collect()} == {5, 1}


def test_sync(spark):
    n = notes(spark, a="# Title\nx", b_c="no heading", d=" \n")
    got = {r.path: (r.title, r.line_count) for r in sync.sources(n).collect()}
    assert got == {"a.md": ("Title", 2), "b_c.md": ("B C", 1)}
    rows = lambda *x: spark.createDataFrame(list(x), "path string, content_hash string")
    now, before = rows(("a", "1"), ("b", "2"), ("c", "3")), rows(("b", "2"), ("c", "x"), ("d", "4"))
    assert {r.path: r.action for r in sync.plan(now, before).collect()} == {"a": "new", "b": "unchanged", "c": "updated", "d": "deleted"}
    assert sync.plan(now, before, narrowed=True).count() == 3
    assert one(spark, f"x\n{sync.MARKER}\n\n", sync.annotations) is None and one(spark, "x", sync.annotations) is None
    assert one(spark, f"{sync.MARKER}\nold\n{sync.MARKER}\nmine\n", sync.annotations) == f"{sync.MARKER}\nmine"
    made = lambda kept: one(spark, "---\na: b\n---\n\nbody\n", lambda c: sync.note(c, {"type": F.lit("x")}, F.lit(kept)))
    assert made(None) == f"---\ntype: x\n---\n\nbody\n\n\n{sync.MARKER}\n"
    assert made(f"{sync.MARKER}\nmine") == f"---\ntype: x\n---\n\nbody\n\n\n{sync.MARKER}\nmine"


def test_prompt_summary(spark):
    assert one(spark, "# Save Memo Command\nlong\nARGUMENTS: now", transcripts.prompt_summary) == "[Skill invoked: Save Memo — now]"
    assert one(spark, "# Own Workflow\n\n## Instructions\nx", transcripts.prompt_summary) == "[Skill invoked: Own]"
    for plain in ("# Own Workflow\nno mark", "# Deployment Guide\n## Instructions", "text", ""):
        assert one(spark, plain, transcripts.prompt_summary) == plain
    assert one(spark, "x", lambda c: transcripts.prompt_summary(c, F.lit(True))) == "[Skill invoked: Unknown]"


def test_collapsed(spark):
    listing = "a\ntotal 9\n" + "f\n" * 25 + "end"
    assert transcripts.shortened(listing) == "a\n[...26 lines of file listing...]end"
    assert transcripts.shortened("total 9\nf\n") == "total 9\nf\n"
    assert transcripts.shortened("s\n" + ("y" * 60 + "\n") * 12 + "t") == "s\n[...12 similar lines...]t"
    assert transcripts.shortened("x[" + '\n {"a": 1},\n' * 11 + "]") == "x[...large JSON array...]"
    assert one(spark, listing, transcripts.collapsed).endswith("listing...]end") and one(spark, None, transcripts.collapsed) is None


def message(spark, *rows):
    return spark.createDataFrame([("f", i, json.dumps(r) if r is not None else "{broken") for i, r in enumerate(rows)], "file string, seq long, value string")


def test_tools_and_stats(spark):
    use = lambda i, name, **given: {"type": "tool_use", "id": i, "name": name, "input": given}
    out = lambda i, text: {"type": "tool_result", "tool_use_id": i, "content": text}
    rows = message(
        spark,
        {"type": "user", "message": {"content": "hi"}},
        {
            "type": "assistant",
            "message": {
                "content": [
                    {"type": "thinking", "thinking": "h"},
                    use("1", "Bash", command="ls", description="list"),
                    use("2", "Edit", file_path="a", old_string="x", new_string="y"),
                    use("3", "Own", k=1),
                    use("4", "Bash", command="b"),
                ]
            },
        },
        {"type": "user", "message": {"content": [out("1", "[main abc1234] done\n[main abc1234] again"), out("2", "[dev 1234567] x")]}},
    )
    b = transcripts.blocks(rows.withColumn("message", F.try_parse_json("value")))
    got = {r.id: r.text for r in transcripts.tool_text(transcripts.tool_calls(b)).collect()}
    assert got["1"] == "#### Tool: Bash\n\n*list*\n\n```bash\nls\n```\n\n**Result:**\n\n```\n[main abc1234] done\n[main abc1234] again\n```"
    assert got["2"].startswith("#### Tool: Edit\n\nEditing: `a`\n\n```diff\n- x\n+ y\n```")
    assert got["3"] == '#### Tool: Own\n\n```json\n{"k":1}\n```'
    s = transcripts.block_stats(b).head()
    assert (s.users, s.tools, s.thoughts, s.errors) == (1, 4, 1, 0)
    assert [(t.name, t.n) for t in s.top_tools] == [("Bash", 2), ("Edit", 1), ("Own", 1)] and s.commits == ["abc1234", "1234567"]


def test_signals(spark):
    rows = message(
        spark,
        {"type": "user", "timestamp": "2024-01-01T00:00:00Z", "message": {"content": "<system-reminder>x</system-reminder>first\nline"}},
        {"type": "assistant", "timestamp": "2024-01-01T00:09:59Z", "message": {"model": "claude-opus-x", "content": [{"type": "tool_use", "name": "Write"}]}},
        None,
        {"type": "user", "isCompactSummary": True, "message": {"content": [{"type": "tool_result", "is_error": True, "content": "[main abcdef0] ok"}]}},
    )
    s = transcripts.signals(rows).head()
    assert (
        s.users,
        s.assistants,
        s.tools,
        s.writes,
        s.commits,
        s.errors,
        s.compactions,
        s.model,
        s.minutes,
        s.first_message,
    ) == (2, 1, 1, 1, 1, 1, 1, "opus", 9, "first line")
    e = transcripts.signals(message(spark, {"type": "x"})).head()
    assert (e.users, e.model, e.minutes, e.first_message) == (0, None, 0, "")


def test_marked(spark):
    rows = [
        ("s", 0, "assistant", "early", None, None),
        ("s", 1, "user", "q", "a", None),
        ("s", 2, "assistant", "r", "a", None),
        ("s", 3, "assistant", "r", "b", None),
        ("s", 4, "user", transcripts.CONTINUED + " x", "b", None),
        ("s", 5, "assistant", "z", None, True),
    ]
    m = spark.createDataFrame(rows, "session string, seq long, role string, text string, agent string, compact boolean")
    got = [(r.turn, r.marker) for r in transcripts.marked(m).orderBy("seq").collect()]
    assert got == [(1, None), (1, None), (1, None), (2, "agent"), (3, "compaction"), (4, "compaction")]


def test_related(spark):
    docs = spark.createDataFrame(
        [
            ("a", "memo", "alpha beta"),
            ("b", "memo", "alpha beta gamma"),
            ("c", "transcript", "alpha alpha"),
            ("d", "concept", "delta"),
            ("e", "memo", "beta"),
            *[(f"x{i}", "memo", "filler words") for i in range(9)],
        ],
        "path string, type string, content string",
    )
    asking = docs.where("path = 'a'").select("path", F.lit("Alpha OR beta").alias("title"))
    got = [(r.rank, r.related) for r in search.related(search.indexed(docs), asking).orderBy("rank").collect()]
    assert [x for x, _ in got] == [1, 2] and {x for _, x in got} == {"b", "e"}
    assert search.related(search.indexed(docs), asking.withColumn("title", F.lit("of"))).count() == 0


@pytest.mark.parametrize(
    ("word", "expected"),
    [
        ("caresses", "caress"),
        ("ponies", "poni"),
        ("feed", "feed"),
        ("agreed", "agre"),
        ("motoring", "motor"),
        ("sing", "sing"),
        ("conflated", "conflat"),
        ("hopping", "hop"),
        ("falling", "fall"),
        ("filing", "file"),
        ("happy", "happi"),
        ("sky", "sky"),
        ("relational", "relat"),
        ("rational", "ration"),
        ("digitizer", "digit"),
        ("vietnamization", "vietnam"),
        ("decisiveness", "decis"),
        ("sensibiliti", "sensibl"),
        ("electrical", "electr"),
        ("goodness", "good"),
        ("adoption", "adopt"),
        ("replacement", "replac"),
        ("probate", "probat"),
        ("rate", "rate"),
        ("cease", "ceas"),
        ("controll", "control"),
        ("is", "is"),
        ("", ""),
        ("2024s", "2024"),
    ],
)
def test_stem(word, expected):
    assert stem(word) == expected


def test_stemmed_search(spark):
    texts = {"a": "Connected connections, café", "b": "connecting the cafes", "c": "other words", "d": ""}
    docs = spark.createDataFrame(list(texts.items()), "path string, content string")
    asked = spark.createDataFrame([(1, ["connection", "cafés"])], "item_id long, terms array<string>")
    got = {r.path: r.score for r in search.bm25_batch(search.indexed(docs, stemmed=True), asked, 9, stemmed=True).collect()}
    words = {k: [stem(w) for w in v.replace("é", "e").replace(",", "").lower().split()] for k, v in texts.items()}
    mean = sum(map(len, words.values())) / len(words)
    score = lambda ws: sum(
        max(math.log((4 - 2 + 0.5) / (2 + 0.5)), 1e-6) * ws.count(t) * 2.2 / (
            ws.count(t) + 1.2 * (0.25 + 0.75 * len(ws) / mean)
        ) for t in ("connect", "cafe")
    )
    assert set(got) == {"a", "b"} and all(abs(got[k] - score(words[k])) < 1e-12 for k in got)
    assert one(spark, "Ünïcode šč ø 漢", folded) == "Unicode sc ø 漢"


def test_curation_reports(spark):
    links = spark.createDataFrame([("a", "?x"), ("a", "? x"), ("b", "?x"), ("b", "y")], "source_path string, link_text string")
    assert [tuple(r) for r in curation.suggested(links).collect()] == [("x", 3, 2)]
    t = spark.createDataFrame([("p", "k"), ("q", "k"), ("q", "k"), ("q", "l"), ("", "l"), ("p", "m"), ("q", "m")], "project string, topic string")
    assert [tuple(r) for r in curation.adjacency(t).collect()] == [("p", "q", 2)]
    assert [tuple(r) for r in curation.themes_without_topic(t, t.where("topic = 'm'").select("topic")).collect()] == [("k", 2)]
    sizes = spark.createDataFrame([(1,), (999,), (1000,), (10_000_000,)], "bytes long")
    assert {r.size_class: (r.files, r.mean_bytes) for r in curation.by_size(sizes).collect()} == {"tiny": (2, 500.0), "small": (1, 1000.0), "huge": (1, 1e7)}
    assert curation.by_size(sizes.limit(0)).count() == 0


def test_formats(spark):
    """Sizes, durations and a tool's heading; ties to the even digit."""
    sizes = {0: "0B", 1023: "1023B", 1024: "1.0KB", 1280: "1.2KB", 1300: "1.3KB", 1 << 20: "1.0MB", 5_900_000: "5.6MB"}
    df = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", formats.size(F.col("n")).alias("x"))
    assert {r.n: r.x for r in df.collect()} == sizes
    times = {0: None, 250: "0.2s", 59_900: "59.9s", 60_000: "1.0m", 90_000: "1.5m"}
    df = spark.createDataFrame([(n,) for n in times], "n long").select("n", formats.duration(F.col("n")).alias("x"))
    assert {r.n: r.x for r in df.collect()} == times
    calls = spark.createDataFrame([("Glob", '{"pattern":"p"}', None, None, 61_000)], "name string, input string, result string, is_error boolean, duration_ms long")
    assert transcripts.tool_text(calls).head().text.startswith("#### Tool: Glob (1.0m)\n\nFinding files")


def test_texts_of_messages(spark):
    """User texts are joined before tags go; isMeta makes a prompt a command's; results carry their durations."""
    use = {"type": "assistant", "message": {"content": [{"type": "tool_use", "id": "t1", "name": "Bash", "input": {}}, "plain", {"type": "text", "text": " "}, {"type": "text", "text": "<command-name>x</command-name>"}]}}
    lines = [
        {"type": "user", "message": {"content": [{"type": "text", "text": "a <command-name>x"}, {"type": "tool_result", "tool_use_id": "t", "content": "no"}, "y</command-name> b", {"type": "text", "text": "c"}]}},
        {"type": "human", "content": "one <system-reminder>z</system-reminder>"},
        {"type": "user", "isMeta": True, "message": {"content": "no heading"}},
        {"type": "user", "message": {"content": [{"type": "text", "text": "# Save Memo Command"}, {"type": "text", "text": "ARGUMENTS: now"}]}},
        {"type": "user", "message": {"content": "<system-reminder>all</system-reminder>"}},
        {"type": "user", "message": {"content": []}},
        {"type": "user", "content": {"type": "text", "text": "dict"}},
        use,
        {"type": "user", "toolUseResult": {"durationMs": 0, "totalDurationMs": 90000}, "message": {"content": [{"type": "tool_result", "tool_use_id": "t1", "content": "ok"}]}},
        {"type": "user", "toolUseResult": "text", "message": {"content": [{"type": "tool_result", "tool_use_id": "t2", "content": "ok"}]}},
    ]
    df = spark.createDataFrame([("f", i, json.dumps(x)) for i, x in enumerate(lines)] + [("f", 99, None)], "file string, seq long, value string")
    df = df.select("file", "seq", F.parse_json("value").alias("message"))
    got = [(r.seq, r.nth, r.role, r.text) for r in transcripts.texts(df).orderBy("seq", "nth").collect()]
    assert got == [
        (0, 0, "user", "a  b\nc"), (1, 0, "user", "one"), (2, 0, "user", "[Skill invoked: Unknown]"), (3, 0, "user", "[Skill invoked: Save Memo — now]"),
        (6, 0, "user", "dict"), (7, 0, "assistant", "plain"), (7, 1, "assistant", "<command-name>x</command-name>"),
    ]
    assert "Exchange" not in transcripts.texts(df)._jdf.queryExecution().executedPlan().toString()
    calls = {r.id: r for r in transcripts.tool_text(transcripts.tool_calls(transcripts.blocks(df))).collect()}
    assert calls["t1"].text.startswith("#### Tool: Bash (1.5m)") and calls["t2"].duration_ms is None and calls["t2"].text.startswith("#### Tool: unknown\n")
