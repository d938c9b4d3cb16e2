"""Queries over conversation logs in JSON, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import formats
from lorekeep.operators import transcripts
from lorekeep.plans.registry import query
from lorekeep.sources import vault


def parsed(s: SparkSession, d: str) -> DataFrame:
    """file, seq, message (variant)."""
    return vault.logs(s, d).select("file", "seq", F.parse_json("value").alias("message"))


def blocks(s: SparkSession, d: str) -> DataFrame:
    return transcripts.blocks(parsed(s, d))


#: The lines of vault.logs, and their blocks, straight from conversations.
LINES = (
    """WITH c AS (SELECT 's' || conv_id AS file, conv_id, turn AS seq, role, coalesce(text, '') AS text, make_timestamp((1704067200
  + conv_id * 3600 + turn * 100) * 1000000) AS ts,
  role = 'assistant' AS reply, role = 'user' AND turn % 4 IN (2, 3) AS answer,
  ['Bash', 'Read', 'Write', 'Edit', 'Grep', 'Glob', 'Task', 'Other'][(conv_id + turn) % 8 + 1] AS tool,
  '[main ' || left(md5(coalesce(text, '')), 8) || '] ' || coalesce(text, '') AS output FROM conversations),
b AS (SELECT file, seq, role AS type, 0 AS nth, 'thinking' AS block, text, NULL AS id, NULL AS
  name, FALSE AS is_error FROM c WHERE reply
  UNION ALL SELECT file, seq, role, 1, 'text', text, NULL, NULL, FALSE FROM c WHERE reply
  UNION ALL SELECT file, seq, role, 2, 'tool_use', NULL, conv_id || '-' || seq, tool, FALSE FROM c WHERE reply
  UNION ALL SELECT file, seq, role, 0, 'tool_result', output, conv_id || '-' || (seq - 1), NULL, seq % 8 = 2 FROM
  c WHERE answer
  UNION ALL SELECT file, seq, role, 1, 'text', text, NULL, NULL, FALSE FROM c WHERE answer
  UNION ALL SELECT file, seq, role, 0, 'text', text, NULL, NULL, FALSE FROM c WHERE NOT reply AND NOT answer)"""
)
CALLS = """, u AS (SELECT file, id, name FROM b WHERE block = 'tool_use'), r AS (SELECT file, id, CASE WHEN length(text) > 1500 THEN left(text, 1050) ||
  chr(10) || '... [truncated] ...' || chr(10) || right(text, 375) ELSE text END AS result, is_error FROM b WHERE block = 'tool_result'),
k AS (SELECT coalesce(u.file, r.file) AS file, coalesce(u.id, r.id) AS id, coalesce(name, 'unknown') AS name, result, is_error
  FROM u FULL OUTER JOIN r ON u.file = r.file AND u.id = r.id)"""


@query(
    "message_blocks",
    LINES + " SELECT file, seq, CAST(nth AS BIGINT) AS nth, type, block, sha256(coalesce(text, '')) AS text_hash, id, name, is_error FROM b",
)
def message_blocks(s: SparkSession, d: str) -> DataFrame:
    return blocks(s, d).select("file", "seq", "nth", "type", "block", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"), "id", "name", "is_error")


@query("tool_calls", LINES + CALLS + " SELECT file, id, name, sha256(coalesce(result, '')) AS result_hash, is_error FROM k")
def tool_calls(s: SparkSession, d: str) -> DataFrame:
    return transcripts.tool_calls(blocks(s, d)).select("file", "id", "name", F.sha2(F.coalesce("result", F.lit("")), 256).alias("result_hash"), "is_error")


TOOL_MARKDOWN = (
    r""", m AS (SELECT k.*, c.text, c.conv_id FROM k LEFT JOIN c ON c.file = k.file AND k.id = c.conv_id || '-' || c.seq
  AND c.reply),
f AS (SELECT file, id, name, CASE name
  WHEN 'Bash' THEN '*about assistant*' || chr(10) || chr(10) || '```bash' || chr(10) || text || chr(10) || '```'
  WHEN 'Read' THEN 'Reading: `/src/' || conv_id || '`'
  WHEN 'Write' THEN 'Writing to: `/src/' || conv_id || '`' || CASE WHEN text <> '' THEN chr(10) || chr(10) || '```'
  || chr(10) || left(text, 500) || CASE WHEN length(text) > 500 THEN '...' ELSE '' END || chr(10) || '```' ELSE '' END
  WHEN 'Edit' THEN 'Editing: `/src/' || conv_id || '`' || chr(10) || chr(10) || '```diff' || chr(10) || '- ' ||
  left(array_to_string(list_reverse(string_split(text, '')), ''), 200) || CASE WHEN length(text) > 200 THEN '...' ELSE '' END
  || chr(10) || '+ ' || left(text, 200) || CASE WHEN length(text) > 200 THEN '...' ELSE '' END || chr(10) || '```'
  WHEN 'Grep' THEN 'Searching for `' || md5(text) || '` in `/src`' WHEN 'Glob' THEN 'Finding files: `' || md5(text) || '` in `/src`'
  WHEN 'Task' THEN 'Launching general agent: about assistant' WHEN 'Other' THEN '```json' || chr(10) || left(CAST(to_json(struct_pack(
    command := text, content := text, description := 'about assistant', file_path := '/src/' || conv_id, new_string := text,
    old_string := array_to_string(list_reverse(string_split(text, '')), ''), path := '/src', pattern := md5(text), subagent_type := 'general')) AS VARCHAR), 500)
    || chr(10) || '```' WHEN 'unknown' THEN '' END AS body,
  CASE WHEN result IS NOT NULL THEN CASE WHEN is_error THEN chr(10) || chr(10) || '**Error:**' ELSE chr(10) ||
  chr(10) || '**Result:**' END || chr(10) || chr(10) || '```' || chr(10)
    || result || chr(10) || '```' ELSE '' END AS outcome FROM m)
SELECT file, id, '#### Tool: ' || name || chr(10) || chr(10) || body || outcome AS markdown FROM f"""
)


@query("tool_markdown", LINES + CALLS + TOOL_MARKDOWN)
def tool_markdown(s: SparkSession, d: str) -> DataFrame:
    """Tools in a form of their own, others as JSON."""
    return transcripts.tool_text(transcripts.tool_calls(blocks(s, d))).select("file", "id", F.col("text").alias("markdown"))


@query("block_stats", LINES + r""", h AS (SELECT file, regexp_extract(text, '\[[\w\-/]+ ([a-f0-9]{7,})\]', 1) AS hash, min(seq) AS pos FROM b
  WHERE block = 'tool_result' AND regexp_matches(text, '\[[\w\-/]+ ([a-f0-9]{7,})\]') GROUP BY 1, 2),
n AS (SELECT file, name, count(*) AS n FROM b WHERE block = 'tool_use' GROUP BY 1, 2), o AS (SELECT *, row_number()
  OVER (PARTITION BY file ORDER BY n DESC, name) AS nth FROM n),
t AS (SELECT file, string_agg(name || ' ' || n, ', ' ORDER BY nth) AS top_tools FROM o WHERE nth <= 5 GROUP BY
  file),
s AS (SELECT file, string_agg(hash, ' ' ORDER BY pos, hash) AS commits FROM h GROUP BY file),
a AS (SELECT file, count(*) FILTER (block = 'text' AND type = 'user') AS users, count(*) FILTER (block = 'text'
  AND type = 'assistant') AS responses,
  count(*) FILTER (block = 'tool_use') AS tools, count(*) FILTER (block = 'thinking') AS thoughts, count(*) FILTER
  (is_error) AS errors FROM b GROUP BY file)
SELECT a.*, coalesce(top_tools, '') AS top_tools, coalesce(commits, '') AS commits FROM a LEFT JOIN t USING (file)
  LEFT JOIN s USING (file)""")
def block_stats(s: SparkSession, d: str) -> DataFrame:
    made = transcripts.block_stats(blocks(s, d))
    tools = F.array_join(F.transform("top_tools", lambda x: F.concat_ws(" ", x["name"], x["n"].cast("string"))), ", ")
    return made.select(
        "file",
        "users",
        "responses",
        "tools",
        "thoughts",
        "errors",
        F.coalesce(tools, F.lit("")).alias("top_tools"),
        F.coalesce(F.array_join("commits", " "), F.lit("")).alias("commits"),
    )


@query("session_metadata", LINES + """ SELECT file, count(*) AS messages, CASE WHEN count(*) > 1 THEN strftime(min(ts), '%Y-%m-%d %H:%M:%S') END AS first,
  CASE WHEN count(*) > 1 THEN strftime(max(ts), '%Y-%m-%d %H:%M:%S') END AS last,
  CASE WHEN count(*) > 1 THEN greatest(1, CAST(floor(epoch(max(ts) - min(ts)) / 60) AS BIGINT)) END AS minutes,
  coalesce(string_agg(DISTINCT CASE WHEN reply THEN CASE WHEN seq % 4 = 1 THEN 'claude-sonnet' ELSE 'claude-opus'
  END END, ', '
    ORDER BY CASE WHEN reply THEN CASE WHEN seq % 4 = 1 THEN 'claude-sonnet' ELSE 'claude-opus' END END), '') AS
  models,
  count(DISTINCT CASE WHEN conv_id % 5 = 0 AND seq > 3 THEN conv_id END) AS subagents,
  CAST(CASE WHEN used THEN sum(CASE WHEN reply THEN length(text) + 3 END) END AS BIGINT) AS input_tokens, CAST(CASE
  WHEN used THEN sum(CASE WHEN reply THEN seq END) END AS BIGINT) AS output_tokens,
  CAST(CASE WHEN used THEN sum(CASE WHEN reply THEN 3 END) END AS BIGINT) AS cache_read_tokens
FROM (SELECT *, sum(CASE WHEN reply THEN length(text) + seq ELSE 0 END) OVER (PARTITION BY file) > 0 AS used FROM
  c) GROUP BY file, used""")
def session_metadata(s: SparkSession, d: str) -> DataFrame:
    at = lambda c: F.date_format(
        F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col(c).cast("timestamp_ntz")),
        "yyyy-MM-dd HH:mm:ss",
    ).alias(c)
    made = transcripts.metadata(parsed(s, d))
    return made.select(*[at(c) if c in ("first", "last") else F.col(c) for c in made.columns])


@query("log_signals", LINES + r""", l AS (SELECT c.*, reply AND tool IN ('Write', 'Edit') AS w FROM c)
SELECT file, count(*) FILTER (role = 'user') AS users, count(*) FILTER (reply) AS assistants, count(*) FILTER (reply)
  AS tools, count(*) FILTER (w) AS writes,
  count(*) FILTER (reply AND tool = 'Bash') AS bash, count(*) FILTER (reply AND tool = 'Read') AS reads, count(*)
  FILTER (reply AND tool = 'Task') AS subagents,
  count(*) FILTER (answer) AS commits, count(*) FILTER (answer AND seq % 8 = 2) AS errors, count(*) FILTER (seq
  = 6) AS compactions,
  arg_min(CASE WHEN seq % 4 = 1 THEN 'sonnet' ELSE 'opus' END, seq) FILTER (reply) AS model, CAST(floor(epoch(max(ts)
  - min(ts)) / 60) AS BIGINT) AS minutes FROM l GROUP BY file""")
def log_signals(s: SparkSession, d: str) -> DataFrame:
    return transcripts.signals(vault.logs(s, d)).drop("first_message")


@query("marked_turns", LINES + """, x AS (SELECT file, seq, role, text, CASE WHEN seq = 6 THEN TRUE ELSE FALSE END AS compact, CASE WHEN conv_id %
  3 = 0 THEN 'a' || (seq // 5) END AS agent
  FROM c WHERE role <> 'system' AND text <> ''),
y AS (SELECT *, CASE WHEN compact THEN 'compaction' WHEN agent <> lag(agent) OVER (PARTITION BY file ORDER BY seq)
  THEN 'agent' END AS marker FROM x),
z AS (SELECT *, greatest(1, sum(CASE WHEN marker IS NOT NULL OR role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION
  BY file ORDER BY seq)) AS turn FROM y)
SELECT file, seq, CAST(turn AS BIGINT) AS turn, marker FROM z""")
def marked_turns(s: SparkSession, d: str) -> DataFrame:
    m = vault.messages(s, d).withColumn("file", F.concat(F.lit("s"), F.col("session").cast("string")))
    agent = F.when(F.col("session") % 3 == 0, F.concat(F.lit("a"), F.floor(F.col("seq") / 5).cast("string")))
    m = m.where("role <> 'system' and coalesce(text, '') <> ''").withColumn("agent", agent).withColumn("compact", F.col("seq") == 6)
    return transcripts.marked(m, "file").select("file", "seq", "turn", "marker")


EXTRACT = (
    """, e AS (SELECT file, seq, nth, CASE WHEN block = 'tool_use' THEN 'tool' WHEN block = 'thinking' THEN 'thinking'
  WHEN block = 'text' AND type = 'user' THEN 'user'
  WHEN block = 'text' AND type = 'assistant' THEN 'response' END AS kind, b.text, id, name FROM b),
p AS (SELECT e.*, greatest(1, sum(CASE WHEN kind = 'user' AND e.text <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY
  file ORDER BY seq, nth)) AS turn FROM e),
g AS (SELECT p.file, p.seq, p.nth, p.turn, p.kind, CASE WHEN kind <> 'tool' THEN p.text ELSE CASE WHEN p.name =
  'Bash' THEN 'Bash: `' || left(c.text, 100) || '`'
  WHEN p.name IN ('Read', 'Write', 'Edit') THEN p.name || ': /src/' || c.conv_id ELSE p.name END || CASE WHEN k.is_error
  THEN ' (ERROR)' ELSE '' END END AS text
  FROM p LEFT JOIN c ON c.file = p.file AND c.seq = p.seq LEFT JOIN k ON k.file = p.file AND k.id = p.id AND p.kind
  = 'tool' WHERE kind IS NOT NULL),
h AS (SELECT * FROM g WHERE text <> ''),
t AS (SELECT file, turn, string_agg(text, chr(10) ORDER BY seq, nth) FILTER (kind = 'user') AS u, arg_min(text,
  seq * 10 + nth) FILTER (kind = 'thinking') AS i,
  string_agg(text, chr(10) ORDER BY seq, nth) FILTER (kind = 'response') AS r, string_agg(text, ', ' ORDER BY seq,
  nth) FILTER (kind = 'tool') AS l FROM h GROUP BY file, turn),
q AS (SELECT file, turn, concat_ws(chr(10), '**User:** ' || CASE WHEN length(u) > 1000 THEN left(u, 1000) || '...'
  ELSE u END, '**Thinking:** ' || CASE WHEN length(i) > 500
  THEN left(i, 500) || '...' ELSE i END, '**Response:** ' || CASE WHEN length(r) > 1500 THEN left(r, 1500) || '...'
  ELSE r END, '**Tools:** ' || l) AS text FROM t),
v AS (SELECT *, sum(length(text)) OVER w AS total, row_number() OVER w AS nth, count(*) OVER (PARTITION BY file)
  AS turns FROM q WINDOW w AS (PARTITION BY file ORDER BY turn)),
o AS (SELECT *, sum(CASE WHEN total > 3000 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY turn) AS passed
  FROM v)
SELECT file AS session, CAST(turn AS BIGINT) AS turn, CASE WHEN total > 3000 THEN chr(10) || '[...' || (turns -
  nth + 1) || ' more turns truncated...]' ELSE text END AS text
FROM o WHERE passed <= 1"""
)


@query("memo_extract", LINES + CALLS + EXTRACT)
def memo_extract(s: SparkSession, d: str) -> DataFrame:
    return transcripts.memo_extract(transcripts.memo_parts(blocks(s, d)), 3000)


@query("session_sizes", """WITH b AS (SELECT conv_id, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS bytes, (max(turn) - min(turn)) * 9700 AS ms FROM conversations GROUP BY conv_id)
SELECT conv_id AS session, CASE WHEN bytes < 1024 THEN bytes || 'B' WHEN bytes < 1048576 THEN printf('%.1fKB', bytes / 1024::DOUBLE) ELSE printf('%.1fMB', bytes / 1048576::DOUBLE) END AS size,
  '#### Tool: session' || CASE WHEN ms >= 60000 THEN printf(' (%.1fm)', ms / 60000::DOUBLE) WHEN ms > 0 THEN printf(' (%.1fs)', ms / 1000::DOUBLE) ELSE '' END AS heading FROM b""")
def session_sizes(s: SparkSession, d: str) -> DataFrame:
    """How large each session is, and a heading with the time that it took."""
    m = vault.messages(s, d)
    per = m.groupBy("session").agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes"), ((F.max("seq") - F.min("seq")) * 9700).alias("ms"))
    return per.select("session", formats.size(F.col("bytes")).alias("size"), formats.titled(F.lit("session"), F.col("ms")).alias("heading"))


@query("message_roles", """SELECT conv_id AS session, turn AS seq, CASE WHEN turn % 3 = 0 THEN role WHEN turn % 3 = 2 THEN 'unknown' WHEN role
  = 'user' THEN 'user' ELSE role END AS role
FROM conversations""")
def message_roles(s: SparkSession, d: str) -> DataFrame:
    """Messages that name their role, that name a type only, and that name neither."""
    m, n = vault.messages(s, d), F.col("seq") % 3
    kind = F.when(n == 1, F.when(F.col("role") == "user", "human").otherwise(F.col("role")))
    line = F.to_json(F.struct(F.when(n == 0, F.col("role")).alias("role"), kind.alias("type")))
    return m.select("session", "seq", transcripts.role_of(F.parse_json(line)).alias("role"))


@query("message_times", """SELECT conv_id AS session, turn AS seq, CASE WHEN turn % 3 < 2 THEN strftime(make_timestamp((1704067200 + conv_id
  * 3600 + turn * 100) * 1000000), '%Y-%m-%d %H:%M:%S') END AS at
FROM conversations""")
def message_times(s: SparkSession, d: str) -> DataFrame:
    """ISO texts, milliseconds and texts that are neither."""
    m, n = vault.messages(s, d), F.col("seq") % 3
    iso = F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("ts").cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    text = F.when(n == 0, iso).when(n == 1, F.unix_millis("ts").cast("string")).otherwise("yesterday")
    at = F.convert_timezone(F.current_timezone(), F.lit("UTC"), transcripts.timestamp(text).cast("timestamp_ntz"))
    return m.select("session", "seq", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("prompt_summaries", """SELECT conv_id AS session, turn AS seq, CASE turn % 4 WHEN 0 THEN '[Skill invoked: Search — ' || conv_id || ']' WHEN 1 THEN text
  WHEN 2 THEN '[Skill invoked: My Own]' ELSE '# Notes' || chr(10) || text END AS text FROM conversations WHERE coalesce(text, '') <> ''""")
def prompt_summaries(s: SparkSession, d: str) -> DataFrame:
    """Prompts that a command expanded, known by their heading or by one like it and a mark, beside plain ones."""
    m, n, text = vault.messages(s, d).where("coalesce(text, '') <> ''"), F.col("seq") % 4, F.col("text")
    whole = F.when(n == 0, F.concat(F.lit("# Search Command\n\nARGUMENTS: "), F.col("session").cast("string"), F.lit("\n"), text)).when(n == 1, text)
    whole = whole.when(n == 2, F.concat(F.lit("# My Own Workflow\n\n## Instructions\n"), text)).otherwise(F.concat(F.lit("# Notes\n"), text))
    return m.select("session", "seq", transcripts.prompt_summary(whole).alias("text"))


#: What session_lines() says, straight from conversations.
SAID = r"""WITH c AS (SELECT 's' || conv_id AS file, conv_id, turn AS seq, role, coalesce(text, '') AS text FROM conversations),
x AS (SELECT file, seq, 0 AS nth, role, CASE turn_kind WHEN 0 THEN 'Before after ' || conv_id WHEN 2 THEN '[Skill invoked: Own — ' || conv_id || ']'
    ELSE trim(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) END AS text
  FROM (SELECT *, seq % 6 AS turn_kind FROM c WHERE role = 'user')
  UNION ALL SELECT file, seq, 0, role, text FROM c WHERE role <> 'user'
  UNION ALL SELECT file, seq, CASE WHEN regexp_matches(text, '\S') THEN 1 ELSE 0 END, role, 'and ' || seq FROM c WHERE role <> 'user'),
said AS (SELECT * FROM x WHERE regexp_matches(text, '\S'))"""


def session_lines(s: SparkSession, d: str) -> DataFrame:
    """file, seq, message (variant): prompts with a tag that begins in one block and ends in the next, prompts marked as a command's, plain ones beside a result; replies of three texts, one blank."""
    m = vault.messages(s, d).withColumn("text", F.coalesce("text", F.lit("")))
    n, own = F.col("seq") % 6, F.col("session").cast("string")
    block = lambda text, kind="text": F.struct(F.lit(kind).alias("type"), F.when(F.lit(kind == "text"), text).alias("text"), F.when(F.lit(kind != "text"), text).alias("content"))
    tagged = F.array(block(F.concat(F.lit("Before <system-reminder>"), "text")), block(F.concat(F.lit("hidden</system-reminder>after "), own)))
    command = F.array(block(F.lit("# Own Skill")), block(F.concat(F.lit("ARGUMENTS: "), own, F.lit("\n"), "text")))
    plain = F.array(block(F.lit("done"), "tool_result"), block(F.col("text")))
    reply = F.array(block(F.col("text")), block(F.lit("  ")), block(F.concat(F.lit("and "), F.col("seq").cast("string"))))
    content = F.when(F.col("role") != "user", reply).when(n == 0, tagged).when(n == 2, command).otherwise(plain)
    meta = F.when((F.col("role") == "user") & (n == 2), True)
    line = F.to_json(F.struct(F.col("role").alias("type"), meta.alias("isMeta"), F.struct("role", content.alias("content")).alias("message")))
    return m.select(F.concat(F.lit("s"), own).alias("file"), F.col("seq").cast("long").alias("seq"), F.parse_json(line).alias("message"))


@query("message_texts", SAID + " SELECT file, seq, CAST(nth AS BIGINT) AS nth, role, text FROM said")
def message_texts(s: SparkSession, d: str) -> DataFrame:
    return transcripts.texts(session_lines(s, d)).select("file", "seq", "nth", "role", "text")


@query("rendered_logs", SAID + r""", t AS (SELECT *, greatest(1, count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY file ORDER BY seq)) AS turn FROM said WHERE role <> 'system'),
u AS (SELECT *, trim(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS v, row_number() OVER (PARTITION BY file, turn ORDER BY seq, nth) AS place FROM t)
SELECT file AS session, CAST(turn AS BIGINT) AS turn, seq, CAST(nth AS BIGINT) AS nth, CASE WHEN place = 1 THEN '## Turn ' || turn || chr(10) || chr(10) ELSE '' END ||
  CASE WHEN role = 'user' THEN '**User:** ' ELSE '**Assistant:** ' END ||
  CASE WHEN length(v) > 5000 THEN left(v, 3500) || chr(10) || '... [truncated] ...' || chr(10) || right(v, 1250) ELSE v END AS markdown FROM u""")
def rendered_logs(s: SparkSession, d: str) -> DataFrame:
    """Logs turned and rendered from their messages: joined user texts, commands as one line."""
    return transcripts.rendered(transcripts.turns(transcripts.texts(session_lines(s, d)).withColumnRenamed("file", "session")))


@query("verbose_output", """WITH t AS (SELECT doc_id, string_split('total 9' || chr(10) || coalesce(text, ''), chr(10)) AS l FROM documents),
u AS (SELECT doc_id, unnest(l[1:len(l) - 1]) AS line, generate_subscripts(l[1:len(l) - 1], 1) AS i FROM t WHERE len(l) < 22),
g AS (SELECT *, length(line) >= 50 AS long, i - row_number() OVER (PARTITION BY doc_id, length(line) >= 50 ORDER BY i) AS run FROM u),
r AS (SELECT doc_id, long, min(i) AS i, count(*) AS n, string_agg(line || chr(10), '' ORDER BY i) AS body FROM g GROUP BY doc_id, long, run),
s AS (SELECT doc_id, string_agg(CASE WHEN long AND n >= 10 THEN '[...' || n || ' similar lines...]' ELSE body END, '' ORDER BY i) AS body FROM r GROUP BY doc_id)
SELECT doc_id, CASE WHEN len(l) >= 22 THEN '[...' || (len(l) - 1) || ' lines of file listing...]' ELSE body END || l[len(l)] AS text
FROM t LEFT JOIN s USING (doc_id)""")
def verbose_output(s: SparkSession, d: str) -> DataFrame:
    """Documents as listings, whole: long ones, and runs of long lines, are one line."""
    docs = vault.table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.select("doc_id", transcripts.collapsed(F.concat(F.lit("total 9\n"), "text")).alias("text"))


@query("note_checks", """WITH m AS (SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS t, max(turn) AS last FROM conversations
  GROUP BY conv_id),
n AS (SELECT CASE WHEN conv_id % 4 = 0 THEN '' ELSE '---' || chr(10) END || CASE WHEN conv_id % 3 = 0 THEN '<system-reminder>'
  ELSE '## Turn 1' || chr(10) END || t AS raw, last >= 6 AS compacted FROM m)
SELECT count(*) AS notes, count(*) FILTER (contains(raw, '<system-reminder>')) AS leaks, CAST(0 AS BIGINT) AS prompts,
  count(*) FILTER (NOT starts_with(raw, '---')) AS no_frontmatter,
  count(*) FILTER (length(raw) > 200 AND NOT regexp_matches(raw, '(?m)^## Turn \\d+')) AS no_turns,
  count(*) FILTER (list_max(list_transform(string_split(raw, chr(10)), lambda x: length(x))) > 5000) AS overlong,
  count(*) FILTER (compacted) AS unmarked FROM n""")
def note_checks(s: SparkSession, d: str) -> DataFrame:
    """Sessions' texts as notes, some with a leaked tag, without frontmatter or without turns."""
    m = vault.messages(s, d).groupBy("session").agg(
        F.array_sort(F.collect_list(F.struct("seq", F.coalesce("text", F.lit("")).alias("text")))).alias("x"),
        F.max("seq").alias("last"),
    )
    head = F.concat(F.when(F.col("session") % 4 == 0, "").otherwise("---\n"), F.when(F.col("session") % 3 == 0, "<system-reminder>").otherwise("## Turn 1\n"))
    raw = F.concat(head, F.array_join(F.transform("x", lambda y: y["text"]), "\n"))
    return transcripts.quality(m.select(F.col("session").alias("path"), raw.alias("raw"), (F.col("last") >= 6).alias("compacted")))
