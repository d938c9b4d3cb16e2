"""Conversation logs: normalising, deduplicating, turns, statistics, memo extracts.

Messages have session, seq, type (or role), ts and text; polymorphic JSON messages are flattened by blocks().
"""

from __future__ import annotations

import re
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lorekeep.functions import formats
from lorekeep.functions import markdown as M
from lorekeep.operators import scans
from lorekeep.sources import store

#: Message types that are left out, tags that are stripped, and limits of characters.
SKIPPED = ("file-history-snapshot", "progress", "summary", "queue-operation", "system")
TAGS = ("local-command-caveat", "local-command-stdout", "command-name", "command-message", "command-args", "system-reminder")
TOOL_RESULT, THINKING, USER = 1500, 3000, 5000
COMMIT = r"\[[\w\-/]+ [a-f0-9]{7,}\]"

#: How a prompt begins that a command expanded, what such a prompt holds near its top, and how a continued session begins.
EXPANDED = r"^#\s+(?:Save Memo|Search|Synthesize|Load|Status|Open|Retry)\s+Command\b"
EXPANDED_LIKE, EXPANDED_MARK = r"(?m)\A#[ \t]+.+[ \t](?:Command|Workflow|Skill)[ \t]*$", r"(?m)^(?:##\s+Instructions|ARGUMENTS:|##\s+Path Resolution|##\s+When to)"
CONTINUED = "This session is being continued from a previous conversation"
#: What counts as verbose output.
LISTING, LISTING_LINES = re.compile(r"total \d+\n"), 20
LONG_LINE, LONG_LINES = 50, 10
JSON_ARRAY = re.compile(r"(\[(?:\n\s*\{[^\n]*\n){10,}[^\]]*\])")


def timestamp(c: Column) -> Column:
    """From ISO text or epoch milliseconds, in UTC; null if neither."""
    return F.coalesce(F.try_to_timestamp(c), F.timestamp_millis(c.try_cast("bigint")))


def role_of(message: Column) -> Column:
    """The role of a message (variant), else what its type stands for, else unknown."""
    kind = F.try_variant_get(message, "$.type", "string")
    return F.coalesce(F.try_variant_get(message, "$.role", "string"), F.when(kind == "human", "user").otherwise(kind), F.lit("unknown"))


def content_of(message: Column) -> Column:
    return F.coalesce(*[F.try_variant_get(message, path, "variant") for path in ("$.message.content", "$.content", "$.message")])


def listed(content: str) -> Column:
    """Content (variant) as an array of blocks."""
    return F.coalesce(F.try_variant_get(content, "$", "array<variant>"), F.array(content))


def blocks(messages: DataFrame) -> DataFrame:
    """file, seq, type, ts, nth, block type, text, id, name, is_error, input (JSON) and, of results, meta (what the message tells of the tool's run, JSON) of each content block; content
    may be text, one block or a list of blocks (message: variant)."""
    get = lambda v, path, kind="string": F.try_variant_get(v, path, kind)
    m = F.col("message")
    meta = F.to_json(get(m, "$.toolUseResult", "variant"))
    head = messages.where(m.isNotNull()).select("file", "seq", get(m, "$.type").alias("type"), get(m, "$.timestamp").alias("ts"), content_of(m).alias("content"), meta.alias("meta"))
    b = head.select("file", "seq", "type", "ts", "meta", F.posexplode(listed("content")).alias("nth", "b"))
    v = F.col("b")
    return b.select(
        "file", "seq", "type", "ts", "nth",
        F.coalesce(get(v, "$.type"), F.lit("text")).alias("block"),
        F.coalesce(*[get(v, path) for path in ("$.text", "$.thinking", "$.content")], F.when(F.schema_of_variant(v) == "STRING", get(v, "$"))).alias("text"),
        F.coalesce(get(v, "$.id"), get(v, "$.tool_use_id")).alias("id"),
        get(v, "$.name").alias("name"),
        F.coalesce(get(v, "$.is_error", "boolean"), F.lit(False)).alias("is_error"),
        F.to_json(get(v, "$.input", "variant")).alias("input"),
        F.when(get(v, "$.type") == "tool_result", F.col("meta")).alias("meta"),
    )


def texts(messages: DataFrame) -> DataFrame:
    """file, seq, nth, role, ts, text of what each message (variant) says, in one narrow stage: a user's text blocks are joined by lines before tags, which
    may span blocks, go and a prompt that a command expanded (told by isMeta too) becomes one line; of other roles each text that isn't blank is a row."""
    get = lambda v, path, kind="string": F.try_variant_get(v, path, kind)
    m = F.col("message")

    def text(v: Column) -> Column:
        own = F.when(F.coalesce(get(v, "$.type"), F.lit("text")) == "text", get(v, "$.text"))
        return F.when(F.schema_of_variant(v) == "STRING", get(v, "$")).otherwise(own)

    some = F.filter(F.transform(listed("content"), text), lambda t: t.isNotNull() & (t != ""))
    head = messages.where(m.isNotNull()).select("file", "seq", role_of(m).alias("role"), get(m, "$.timestamp").alias("ts"), F.coalesce(get(m, "$.isMeta", "boolean"), F.lit(False)).alias("meta"), content_of(m).alias("content"))
    t = head.select("file", "seq", "role", "ts", "meta", some.alias("texts")).where(F.size("texts") > 0)
    t = t.withColumn("joined", M.without_system_tags(F.array_join("texts", "\n"), TAGS))
    own = F.when(F.col("role").isin("user", "human"), F.array(prompt_summary(F.col("joined"), F.col("meta")))).otherwise(F.col("texts"))
    return t.select("file", "seq", "role", "ts", F.posexplode(F.filter(own, lambda x: x.rlike(r"\S"))).alias("nth", "text"))


def metadata(messages: DataFrame) -> DataFrame:
    """Of each file (message: variant): messages, first and last time and whole minutes (at least 1; null below two times), its models in order, how many other agents, and tokens."""
    get = lambda path, kind="string": F.try_variant_get("message", path, kind)
    reply = get("$.type") == "assistant"
    m = messages.select(
        "file",
        timestamp(get("$.timestamp")).alias("ts"),
        F.when(reply, get("$.message.model")).alias("model"),
        get("$.agentId").alias("agent"),
        *[
            F.when(
                reply,
                F.coalesce(get(f"$.message.usage.{k}", "long"), F.lit(0)),
            ).alias(k) for k in ("input_tokens", "output_tokens", "cache_read_input_tokens")
        ],
    )
    minutes = F.greatest(F.lit(1), F.floor((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 60_000_000)).cast("long")
    several = F.count("ts") >= 2
    used, made, cached = (F.coalesce(F.sum(k), F.lit(0)) for k in ("input_tokens", "output_tokens", "cache_read_input_tokens"))
    some = (used != 0) | (made != 0)
    return m.groupBy("file").agg(
        F.count("*").alias("messages"),
        F.when(several, F.min("ts")).alias("first"),
        F.when(several, F.max("ts")).alias("last"),
        F.when(several, minutes).alias("minutes"),
        F.array_join(F.array_sort(F.collect_set(F.nullif("model", F.lit("")))), ", ").alias("models"),
        F.countDistinct(F.nullif("agent", F.lit(""))).alias("subagents"),
        F.when(some, used + cached).alias("input_tokens"),
        F.when(some, made).alias("output_tokens"),
        F.when(some, cached).alias("cache_read_tokens"),
    )


def cleaned(text: Column) -> Column:
    return M.truncated(M.without_system_tags(text, TAGS), USER)


def deduplicated(messages: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """One row of each key, at the first one's place, with the longest text; rows without a time all stay."""
    columns = messages.columns
    rest = F.struct(*[c for c in columns if c not in key])
    known = messages.where("ts is not null").groupBy(*key).agg(F.min_by(rest, "seq").alias("_row"), F.max_by(text, F.struct(F.length(text), -F.col("seq"))).alias("_text"))
    own = lambda c: F.col("_text") if c == text else F.col(c) if c in key else F.col("_row")[c]
    return known.select(*[own(c).alias(c) for c in columns]).unionByName(messages.where("ts is null"))


def turns(messages: DataFrame, session: str = "session", order: str = "seq") -> DataFrame:
    """messages with turn: a user text begins one; what comes before the first belongs to turn 1."""
    m = messages.where(~F.col("role").isin(*SKIPPED) & (F.coalesce("text", F.lit("")) != ""))
    m = scans.running(m, [session], [order], {"turn": F.when(F.col("role") == "user", 1).otherwise(0)})
    return m.withColumn("turn", F.greatest(F.lit(1), "turn").cast("int"))


def turn_table(turned: DataFrame, session: str = "session") -> DataFrame:
    """One row of each turn: number of messages, characters by role, and the first user text, cleaned."""
    user, reply = F.col("role") == "user", F.col("role") == "assistant"
    return turned.groupBy(session, "turn").agg(
        F.count("*").alias("messages"),
        F.count_if(reply).alias("responses"),
        F.sum(F.when(user, F.length("text")).otherwise(0)).alias("user_chars"),
        F.sum(F.when(reply, F.length("text")).otherwise(0)).alias("reply_chars"),
        F.min_by(F.when(user, F.col("text")), "seq").alias("prompt"),
    )


def tool_calls(found: DataFrame) -> DataFrame:
    """Tool uses beside their results, matched by id within a session; the first result counts, one without a use is named unknown. duration_ms: what the result's message tells, else null."""
    use = found.where("block = 'tool_use'").select("file", "id", "name", "input")
    took = lambda key: F.nullif(F.get_json_object("meta", f"$.{key}").try_cast("double"), F.lit(0.0))
    found = found.withColumn("duration_ms", F.coalesce(took("durationMs"), took("totalDurationMs")))
    result = found.where("block = 'tool_result'").groupBy("file", "id").agg(
        F.min_by("text", F.struct("seq", "nth")).alias("result"),
        F.min_by("is_error", F.struct("seq", "nth")).alias("is_error"),
        F.min_by("duration_ms", F.struct("seq", "nth")).alias("duration_ms"),
    )
    return use.join(result, ["file", "id"], "full_outer").withColumn("name", F.coalesce("name", F.lit("unknown"))).withColumn(
        "result",
        M.truncated(F.col("result"), TOOL_RESULT),
    )


def prompt_summary(text: Column, meta: Column | None = None) -> Column:
    """A prompt that a command expanded (known by the meta flag, its heading, or a heading and a mark within 500 characters) as one line; other texts stay."""
    alike = text.rlike(EXPANDED) | (text.rlike(EXPANDED_LIKE) & F.left(text, F.lit(500)).rlike(EXPANDED_MARK))
    name = F.coalesce(F.nullif(F.trim(F.regexp_extract(text, r"(?m)\A#\s+(.+?)(?:\s+Command|\s+Workflow|\s+Skill)?\s*$", 1)), F.lit("")), F.lit("Unknown"))
    given = F.trim(F.regexp_extract(text, r"(?m)^ARGUMENTS:[ \t]*(.+)$", 1))
    short = F.concat(F.lit("[Skill invoked: "), name, F.when(given != "", F.concat(F.lit(" — "), given)).otherwise(""), F.lit("]"))
    return F.when(F.coalesce(meta, F.lit(False)) | alike if meta is not None else alike, short).otherwise(text)


def shortened(text: str) -> str:
    """Long listings, arrays of objects and runs of long lines as one line each."""
    found, end = LISTING.search(text), text.rfind("\n") + 1
    while found and text.count("\n", found.end(), end) < LISTING_LINES:
        found = LISTING.search(text, found.end())
    if found:
        n = text.count("\n", found.start(), end)
        text = f"{text[: found.start()]}[...{n} lines of file listing...]{text[end:]}"
    text = JSON_ARRAY.sub("[...large JSON array...]", text)
    whole, rest = text.split("\n")[:-1], text.split("\n")[-1]
    out = ""
    for long, run in groupby(whole, lambda line: len(line) >= LONG_LINE):
        lines = list(run)
        out += f"[...{len(lines)} similar lines...]" if long and len(lines) >= LONG_LINES else "".join(f"{line}\n" for line in lines)
    return out + rest


#: Tool results that a task has as Python objects at a time.
HELD = 64


@F.arrow_udf(StringType())
def collapsed(texts: pa.Array) -> pa.Array:
    """shortened() of each tool result: the number of lines that a match had can't be put in by a built-in replacement."""
    held = (texts.slice(at, HELD).to_pylist() for at in range(0, len(texts), HELD))
    made = [pa.array([x if x is None else shortened(x) for x in part], pa.string()) for part in held]
    return pa.concat_arrays(made) if made else pa.array([], pa.string())


def marked(messages: DataFrame, session: str = "session", order: str = "seq") -> DataFrame:
    """messages (with agent and compact) with turn and marker: a user text, a compaction and another agent each begin a turn; marker names the latter two."""
    said = ~F.col("role").isin(*SKIPPED) & (F.coalesce("text", F.lit("")) != "")
    m = scans.running(messages.where(said), [session], [order], lasts={"agent_before": F.col("agent")})
    compact = F.coalesce("compact", F.lit(False)) | F.coalesce(F.col("text").startswith(CONTINUED), F.lit(False))
    other = F.col("agent").isNotNull() & F.col("agent_before").isNotNull() & (F.col("agent") != F.col("agent_before"))
    m = m.withColumn("marker", F.when(compact, "compaction").when(other, "agent")).drop("agent_before")
    begins = F.when(F.col("marker").isNotNull() | (F.col("role") == "user"), 1).otherwise(0)
    return scans.running(m, [session], [order], {"turn": begins}).withColumn("turn", F.greatest(F.lit(1), "turn").cast("int"))


def block_stats(found: DataFrame) -> DataFrame:
    """Of each file: texts by role, tool uses, thoughts and errors, the five tools used most (ties by name), and commits in order of appearance."""
    is_ = lambda b: F.col("block") == b
    totals = found.groupBy("file").agg(
        F.count_if(is_("text") & (F.col("type") == "user")).alias("users"),
        F.count_if(is_("text") & (F.col("type") == "assistant")).alias("responses"),
        F.count_if(is_("tool_use")).alias("tools"),
        F.count_if(is_("thinking")).alias("thoughts"),
        F.count_if("is_error").alias("errors"),
    )
    uses = found.where(is_("tool_use")).groupBy("file", "name").agg(F.count("*").alias("n"))
    w = Window.partitionBy("file").orderBy(F.col("n").desc(), "name")
    best = uses.withColumn("nth", F.row_number().over(w)).where("nth <= 5").groupBy("file").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("nth", "name", "n"))),
            lambda x: F.struct(x["name"].alias("name"), x["n"].alias("n")),
        ).alias("top_tools")
    )
    commit = found.where(is_("tool_result")).select(
        "file",
        F.struct("seq", "nth").alias("at"),
        F.explode(F.regexp_extract_all("text", F.lit(r"\[[\w\-/]+ ([a-f0-9]{7,})\]"), F.lit(1))).alias("hash"),
    )
    commits = commit.groupBy("file", "hash").agg(F.min("at").alias("at")).groupBy("file").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "hash"))), lambda x: x["hash"]).alias("commits")
    )
    return totals.join(best, "file", "left").join(commits, "file", "left")


def signals(lines: DataFrame, session: str = "file") -> DataFrame:
    """What triage counts in each session's raw lines (session, seq, value): one aggregate, no parsing."""
    v = F.col("value")
    has = lambda p: F.count_if(v.rlike(p))
    named = lambda n: has(rf'"name"\s*:\s*"(?:{n})"')
    kind = F.when(v.rlike(r'"type"\s*:\s*"user"'), "user").when(v.rlike(r'"type"\s*:\s*"assistant"'), "assistant")
    ts = F.try_to_timestamp(F.nullif(F.regexp_extract(v, r'"timestamp"\s*:\s*"([^"]+)"', 1), F.lit("")))
    opus = F.regexp_extract(v, r'"model"\s*:\s*"claude-(opus|sonnet)', 1)
    at = F.struct("seq")
    g = lines.where(F.trim("value") != "").withColumn("_kind", kind).withColumn("_ts", ts).withColumn("_model", F.nullif(opus, F.lit("")))
    out = g.groupBy(session).agg(
        F.count_if(F.col("_kind") == "user").alias("users"), F.count_if(F.col("_kind") == "assistant").alias("assistants"), has(r'"type"\s*:\s*"tool_use"').alias("tools"),
        named("Write|Edit").alias("writes"), named("Bash").alias("bash"), named("Read").alias("reads"), named("Task").alias("subagents"), has(COMMIT).alias("commits"),
        has(r'"is_error"\s*:\s*true').alias("errors"), has(r'"isCompactSummary"\s*:\s*true').alias("compactions"), F.min_by(
            "_model",
            F.when(F.col("_model").isNotNull(), at),
        ).alias("model"),
        F.min_by(
            "value",
            F.when(F.col("_kind") == "user", at),
        ).alias("_first"), F.min_by("_ts", F.when(F.col("_ts").isNotNull(), at)).alias("_from"), F.max_by("_ts", F.when(F.col("_ts").isNotNull(), at)).alias("_to"),
    )
    minutes = F.greatest(F.lit(0), F.floor(F.coalesce((F.unix_micros("_to") - F.unix_micros("_from")) / 60_000_000, F.lit(0)))).cast("long")
    first = F.try_parse_json("_first")
    content = F.coalesce(*[F.try_variant_get(first, p, "string") for p in ("$.message.content", "$.message", "$.content")], F.lit(""))
    return out.select(
        "*",
        minutes.alias("minutes"),
        F.translate(F.left(M.without_system_tags(content, ("system-reminder",)), F.lit(150)), "\n", " ").alias("first_message"),
    ).drop("_first", "_from", "_to")


def fenced(text: Column, kind: str = "") -> Column:
    return F.concat(F.lit(f"```{kind}\n"), text, F.lit("\n```"))


def tool_text(calls: DataFrame) -> DataFrame:
    """calls (name, input as JSON, result, is_error and, if known, duration_ms) with text: each tool use as markdown by the tool's own form."""
    got = lambda key, other="": F.coalesce(F.get_json_object("input", f"$.{key}"), F.lit(other))
    cut = lambda c, n: F.concat(F.left(c, F.lit(n)), F.when(F.length(c) > n, "...").otherwise(""))
    code = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    path, about = got("file_path"), got("description")
    forms = {
        "Bash": F.concat(F.when(about != "", F.concat(F.lit("*"), about, F.lit("*\n\n"))).otherwise(""), fenced(got("command"), "bash")),
        "Read": F.concat(F.lit("Reading: "), code(path)),
        "Write": F.concat(
            F.lit("Writing to: "),
            code(path),
            F.when(got("content") != "", F.concat(F.lit("\n\n"), fenced(cut(got("content"), 500)))).otherwise(""),
        ),
        "Edit": F.concat(
            F.lit("Editing: "),
            code(path),
            F.lit("\n\n"),
            fenced(F.concat(F.lit("- "), cut(got("old_string"), 200), F.lit("\n+ "), cut(got("new_string"), 200)), "diff"),
        ),
        "Grep": F.concat(F.lit("Searching for "), code(got("pattern")), F.lit(" in "), code(got("path", "."))),
        "Glob": F.concat(F.lit("Finding files: "), code(got("pattern")), F.lit(" in "), code(got("path", "."))),
        "Task": F.concat(F.lit("Launching "), got("subagent_type"), F.lit(" agent: "), about),
    }
    body = F.when(F.coalesce("input", F.lit("{}")) == "{}", "").otherwise(fenced(F.left("input", F.lit(500)), "json"))
    for name, form in forms.items():
        body = F.when(F.col("name") == name, form).otherwise(body)
    result = F.when(
        F.col("result").isNotNull(),
        F.concat(
            F.when(F.col("is_error"), "\n\n**Error:**\n\n").otherwise("\n\n**Result:**\n\n"),
            fenced(M.truncated(collapsed("result"), TOOL_RESULT)),
        ),
    )
    took = F.col("duration_ms") if "duration_ms" in calls.columns else F.lit(None).cast("long")
    return calls.withColumn("text", F.concat(formats.titled(F.col("name"), took), F.lit("\n\n"), body, F.coalesce(result, F.lit(""))))


def notes(turned: DataFrame, session: str = "session") -> DataFrame:
    """session, part, raw: each session as a note in parts, part 0 its frontmatter (dated by the first message), then one of each message; the note is its parts in order."""
    s = sessions(turned, session).join(turned.groupBy(session).agg(F.max("turn").alias("turns")), session)
    day = F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("first").cast("timestamp_ntz")), "yyyy-MM-dd")
    fields = {
        "type": F.lit("transcript"),
        "session_id": F.col(session),
        "date": day,
        "turns": F.col("turns"),
        "total_messages": F.col("messages"),
        "duration_minutes": F.col("minutes"),
    }
    head = s.select(session, F.lit(0).alias("part"), F.concat(M.formatted(fields), F.lit("\n")).alias("raw"))
    w = Window.partitionBy(session).orderBy("seq")
    return head.unionByName(
        rendered(turned, session).select(session, F.row_number().over(w).alias("part"), F.concat(F.lit("\n"), "markdown", F.lit("\n")).alias("raw"))
    )


def sessions(messages: DataFrame, session: str = "session") -> DataFrame:
    """Messages, first and last time, whole minutes (at least 1, null below two times) of each session."""
    minutes = F.greatest(F.lit(1), F.floor((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 60_000_000))
    return messages.groupBy(session).agg(
        F.count("*").alias("messages"),
        F.min("ts").alias("first"),
        F.max("ts").alias("last"),
        F.when(F.count("ts") > 1, minutes).cast("long").alias("minutes"),
    )


#: Characters of a prompt, a thought, a reply and a command in a memo extract, and of the extract.
MEMO_USER, MEMO_THOUGHT, MEMO_REPLY, MEMO_COMMAND, MEMO_ALL = 1000, 500, 1500, 100, 50_000


def memo_parts(found: DataFrame) -> DataFrame:
    """session, turn, seq, nth, kind (user, thinking, response, tool), text of what blocks() found, and of tool uses what a memo says of them; failed ones are marked."""
    took = lambda key: F.nullif(F.get_json_object("meta", f"$.{key}").try_cast("double"), F.lit(0.0))
    found = found.withColumn("duration_ms", F.coalesce(took("durationMs"), took("totalDurationMs")))
    result = found.where("block = 'tool_result'").groupBy("file", "id").agg(F.min_by("is_error", F.struct("seq", "nth")).alias("failed"))
    b = found.drop("is_error").join(result, ["file", "id"], "left")
    text, use = F.col("block") == "text", F.col("block") == "tool_use"
    kind = F.when(text & (F.col("type") == "user"), "user").when(
        text & (F.col("type") == "assistant"),
        "response",
    ).when(F.col("block") == "thinking", "thinking").when(use, "tool")
    got = lambda key: F.coalesce(F.get_json_object("input", f"$.{key}"), F.lit(""))
    name = F.coalesce("name", F.lit("unknown"))
    said = F.when(name == "Bash", F.concat(F.lit("Bash: `"), F.left(got("command"), F.lit(MEMO_COMMAND)), F.lit("`")))
    said = said.when(name.isin("Read", "Write", "Edit"), F.concat(name, F.lit(": "), got("file_path"))).otherwise(name)
    said = F.concat(said, F.when(F.coalesce("failed", F.lit(False)), " (ERROR)").otherwise(""))
    begins = F.when(text & (F.col("type") == "user") & (F.coalesce("text", F.lit("")) != ""), 1).otherwise(0)
    b = scans.running(b, ["file"], ["seq", "nth"], {"turn": begins})
    b = b.withColumn("turn", F.greatest(F.lit(1), "turn").cast("int")).withColumn("kind", kind)
    said = F.when(use, said).otherwise(F.col("text"))
    return b.select(
        F.col("file").alias("session"),
        "turn",
        "seq",
        "nth",
        "kind",
        said.alias("text"),
    ).where(F.col("kind").isNotNull() & (F.coalesce("text", F.lit("")) != ""))


def memo_extract(parts: DataFrame, budget: int = MEMO_ALL) -> DataFrame:
    """session, turn, text: what a memo is made of, turn by turn (prompt, first thought, reply, tools, each cut), up to the first turn that passes the budget of characters;
    that turn's row tells how many are left out. Of each kind only as much of a turn is gathered as its limit shows."""
    limits = {
        "user": (MEMO_USER, "\n", "User"),
        "thinking": (MEMO_THOUGHT, "", "Thinking"),
        "response": (MEMO_REPLY, "\n", "Response"),
        "tool": (budget, ", ", "Tools"),
    }
    w = Window.partitionBy("session", "turn", "kind").orderBy("seq", "nth")
    before = F.coalesce(F.sum(F.length("text") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = parts.withColumn("before", before).withColumn("first", F.row_number().over(w) == 1)
    test = F.lit(False)
    for kind, (most, _, _) in limits.items():
        test |= (F.col("kind") == kind) & (F.col("first") if kind == "thinking" else F.col("before") <= most)
    at = F.struct("seq", "nth", F.left("text", F.lit(budget + 1)).alias("text"))
    gathered = kept.where(test).groupBy("session", "turn").agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == k, at))).alias(k) for k in limits])

    def part(kind: str) -> Column:
        most, between, label = limits[kind]
        text = F.array_join(F.transform(kind, lambda x: x["text"]), between)
        cut = F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text) if kind != "tool" else text
        return F.when(F.size(kind) > 0, F.concat(F.lit(f"**{label}:** "), cut))

    t = gathered.select("session", "turn", F.concat_ws("\n", *[part(k) for k in limits]).alias("text"))
    t = scans.running(t, ["session"], ["turn"], {"total": F.length("text"), "nth": F.lit(1)})
    turns = t.groupBy("session").agg(F.count("*").alias("turns")).withColumnRenamed("session", "_of")
    t = t.join(store.small_side(turns), F.col("session").eqNullSafe(F.col("_of"))).where(F.col("total") - F.length("text") <= budget)
    left_out = F.concat(F.lit("\n[..."), (F.col("turns") - F.col("nth") + 1).cast("string"), F.lit(" more turns truncated...]"))
    return t.select("session", "turn", F.when(F.col("total") > budget, left_out).otherwise(F.col("text")).alias("text"))


def rendered(turned: DataFrame, session: str = "session") -> DataFrame:
    """session, turn, seq (and nth, if there are several texts of a message), markdown of each text, the first one of a turn under its heading: a session is its parts in order, and none is held whole."""
    order = [c for c in ("seq", "nth") if c in turned.columns]
    w = Window.partitionBy(session, "turn").orderBy(*order)
    head = F.when(F.row_number().over(w) == 1, F.concat(F.lit("## Turn "), F.col("turn").cast("string"), F.lit("\n\n"))).otherwise("")
    who = F.when(F.col("role") == "user", "**User:** ").otherwise("**Assistant:** ")
    return turned.select(session, "turn", *order, F.concat(head, who, cleaned(F.col("text"))).alias("markdown"))


def quality(notes: DataFrame, path: str = "path", text: str = "raw") -> DataFrame:
    """Checks of converted notes: leaked tags, uncompressed prompts, no frontmatter, no turns in a text that isn't short, overlong lines, and sessions (compacted: boolean, if there) without their mark."""
    leak = F.col(text).rlike("<(" + "|".join(TAGS) + ")>")
    prompt = F.col(text).rlike(r"(?m)^## Instructions\n|^## Path Resolution|^ARGUMENTS:\s")
    no_turns = (F.length(text) > 200) & ~F.col(text).rlike(r"(?m)^## Turn \d+")
    long = F.exists(F.split(text, "\n"), lambda x: F.length(x) > 5000)
    marks = F.col("compacted") & ~F.col(text).contains("[Session compacted") if "compacted" in notes.columns else F.lit(False)
    tests = {"leaks": leak, "prompts": prompt, "no_frontmatter": ~F.col(text).startswith("---"), "no_turns": no_turns, "overlong": long, "unmarked": marks}
    return notes.agg(F.count("*").alias("notes"), *[F.count_if(t).alias(n) for n, t in tests.items()])
