"""Sources: markdown folders, conversation logs, JSON state, and notes made from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.sources import archives


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def markdown(spark: SparkSession, root: str, keyword_only: bool = False) -> DataFrame:
    """path (relative to root), raw, modified and bytes of each note below projects/ and directly in topics/.

    Names that begin with an underscore are left out, but for _project.md unless keyword_only; so are templates and, unless
    keyword_only, views and archived notes. Undecodable bytes become replacement characters; empty files are left out.
    """
    f = archives.registered(spark).read.format(archives.NOTES).option("keyword_only", str(keyword_only).lower()).load(root)
    archived = F.col("raw").rlike(r"(?s)^---(?:(?!---).)*?\nstatus:\s*[\"']?archived")
    return (f if keyword_only else f.where(~archived)).select("path", "raw", "modified", "bytes")


def read_note(notes: DataFrame, path: str) -> DataFrame:
    """The note with this path (relative to the archive); a path that leads out of it is refused."""
    if path.startswith(("/", "\\")) or ".." in path.replace("\\", "/").split("/"):
        raise ValueError(f"not a path below the archive: {path}")
    return notes.where(F.col("path") == path)


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """file, message (variant, null for a malformed line) of each line that isn't blank."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where(F.trim("value") != "")
    return lines.select("file", F.try_parse_json("value").alias("message"))


def parse_errors(messages: DataFrame) -> DataFrame:
    return messages.groupBy("file").agg(F.count("*").alias("lines"), F.count_if(F.col("message").isNull()).alias("errors"))


def state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON state or queue rows; corrupt ones are skipped."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path).where("_corrupt is null").drop("_corrupt")


def log_files(spark: SparkSession, root: str, min_bytes: int = 1024) -> DataFrame:
    """project, count, bytes, first and last change of the conversation logs."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").load(root).drop("content")
    return f.where(F.col("length") >= min_bytes).groupBy(F.element_at(F.split("path", "/"), -2).alias("project")).agg(
        F.count("*").alias("sessions"),
        F.sum("length").alias("bytes"),
        F.min("modificationTime").alias("first"),
        F.max("modificationTime").alias("last"),
    )


def log_samples(spark: SparkSession, root: str, min_bytes: int = 1024, most: int = 11) -> DataFrame:
    """project, session, bytes, lines (those that aren't blank, counted up to `most`; no more are read) of each log file of at least min_bytes."""
    return archives.registered(spark).read.format(archives.LOGS).option("min_bytes", min_bytes).option("most", most).load(root)


def memory_files(spark: SparkSession, root: str) -> DataFrame:
    """folder, path, raw, modified, bytes of the notes that a tool keeps by itself, <folder>/memory/*.md below root; undecodable files are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(root)
    found = files.where(F.col("path").rlike(r"/[^/]+/memory/[^/]+\.md$") & F.is_valid_utf8(F.col("content").cast("string")))
    path = F.regexp_extract("path", r"([^/]+/memory/[^/]+)$", 1)
    return found.select(F.split_part(path, F.lit("/"), F.lit(1)).alias("folder"), path.alias("path"), F.col("content").cast("string").alias("raw"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, title, content, type, project, date: an archive made from documents by arithmetic."""
    i, s = F.col("doc_id"), F.col("doc_id").cast("string")
    folder = F.when(i % 10 < 6, "memos").when(i % 10 < 8, "transcripts").otherwise("auto-memory")
    path = F.when(i % 10 == 8, F.concat(F.lit("topics/d"), s, F.lit(".md"))).otherwise(
        F.concat(F.lit("projects/"), "source", F.lit("/"), folder, F.lit("/d"), s, F.lit(".md"))
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        path.alias("path"),
        F.concat(F.lit("doc-"), s).alias("title"),
        F.coalesce("text", F.lit("")).alias("content"),
        F.when(i % 10 < 6, "memo").when(i % 10 < 8, "transcript").when(i % 10 == 8, "concept").otherwise("auto-memory").alias("type"),
        F.col("source").alias("project"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (i % 60).cast("int")), "yyyy-MM-dd").alias("date"),
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, raw: the archive as markdown with frontmatter, links and tasks."""
    d = archive(spark, sf_dir)
    d = d.crossJoin(F.broadcast(d.agg(F.count("*").alias("n"))))  # one row
    i, s, n = F.col("doc_id"), F.col("doc_id").cast("string"), F.col("n")
    raw = F.concat(
        F.lit("---\ntype: "), "type", F.lit('\ntitle: "'), "title", F.lit('"\nproject: '), "project", F.lit("\ndate: "), "date",
        F.lit("\nstatus: "), F.when(i % 17 == 0, "archived").otherwise("active"), F.lit("\ntags: [t"), (i % 7).cast("string"), F.lit(", u"), (i % 11).cast("string"),
        F.lit("]\naliases: [doc-"), s, F.lit("]\n---\n## Summary\n"), "content", F.lit("\nSee [[doc-"), ((i * 7 + 3) % F.floor(n * 12 / 10)).cast("string"),
        F.lit("]] and [[projects/"), "project", F.lit("/memos/d"), ((i * 3) % n).cast("string"), F.lit("|other]].\n"),
        F.when(i % 4 == 0, F.concat(F.lit("About [[topic-"), (i % 37).cast("string"), F.lit("]].\n"))).otherwise(""),
        F.when(i % 5 == 0, F.concat(F.lit("- [ ] early "), s, F.lit("\n"))).otherwise(""), F.lit("## Open Threads\n- [ ] follow up "), s, F.lit("\n"),
        F.when(i % 3 == 0, F.concat(F.lit("- [x] closed "), s, F.lit("\n"))).otherwise(""),
    )
    return d.select("doc_id", "path", raw.alias("raw"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, doc_id, embedding: three chunk vectors for a document, dealt over all documents."""
    n = F.broadcast(table(spark, sf_dir, "documents").agg(F.count("*").alias("n")))  # one row
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").crossJoin(n)
    return v.select("vec_id", (F.floor(F.col("vec_id") / 3) * 31 % F.col("n")).alias("doc_id"), "embedding")


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, path, embedding of each vector that has a document."""
    return vectors(spark, sf_dir).join(archive(spark, sf_dir).select("doc_id", "path"), "doc_id").select("vec_id", "path", "embedding")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, seq, role, text, ts (one minute and 40 seconds apart) from conversations."""
    c = table(spark, sf_dir, "conversations")
    ts = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("conv_id") * 3600 + F.col("turn") * 100)
    return c.select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), "role", "text", ts.alias("ts"))


#: Tools of the logs below.
TOOLS = ("Bash", "Read", "Write", "Edit", "Grep", "Glob", "Task", "Other")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, seq, value: conversations as lines of a log in its polymorphic JSON: replies are a thought, a text and a tool use, some prompts have the tool's result before their text, others are plain text."""
    m = messages(spark, sf_dir).withColumn("text", F.coalesce("text", F.lit("")))
    text, seq, session, role = F.col("text"), F.col("seq"), F.col("session"), F.col("role")
    of = lambda n: F.concat(session.cast("string"), F.lit("-"), n.cast("string"))
    at = F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("ts").cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    tool = F.get(F.array(*map(F.lit, TOOLS)), ((session + seq) % len(TOOLS)).cast("int"))
    given = F.struct(
        text.alias("command"), text.alias("content"), F.concat(F.lit("about "), role).alias("description"), F.concat(F.lit("/src/"), session.cast("string")).alias("file_path"),
        text.alias("new_string"), F.reverse(text).alias("old_string"), F.lit("/src").alias("path"), F.md5(text.cast("binary")).alias("pattern"), F.lit("general").alias("subagent_type"),
    )
    block = "struct<type: string, thinking: string, text: string, id: string, tool_use_id: string, name: string, content: string, is_error: boolean, input: struct<command: string, "
    block += "content: string, description: string, file_path: string, new_string: string, old_string: string, path: string, pattern: string, subagent_type: string>>"

    def made(kind: str, **fields: Column) -> Column:
        names = ("type", "thinking", "text", "id", "tool_use_id", "name", "content", "is_error", "input")
        return F.struct(*[(F.lit(kind) if n == "type" else fields.get(n, F.lit(None))).alias(n) for n in names]).cast(block)

    reply = F.array(made("thinking", thinking=text), made("text", text=text), made("tool_use", id=of(seq), name=tool, input=given))
    output = F.concat(F.lit("[main "), F.left(F.md5(text.cast("binary")), F.lit(8)), F.lit("] "), text)
    answer = F.array(made("tool_result", tool_use_id=of(seq - 1), content=output, is_error=seq % 8 == 2), made("text", text=text))
    is_reply, is_answer = F.col("role") == "assistant", (F.col("role") == "user") & (seq % 4).isin(2, 3)
    usage = F.struct(F.length(text).alias("input_tokens"), seq.cast("int").alias("output_tokens"), F.lit(3).alias("cache_read_input_tokens"))
    model = F.when(is_reply, F.when(seq % 4 == 1, "claude-sonnet").otherwise("claude-opus"))
    head = [
        F.col("role").alias("type"),
        at.alias("timestamp"),
        F.when((session % 5 == 0) & (seq > 3), F.concat(F.lit("a"), session.cast("string"))).alias("agentId"),
        F.when(seq == 6, True).alias("isCompactSummary"),
    ]
    line = lambda content: F.to_json(
        F.struct(
            *head,
            F.struct(F.col("role"), model.alias("model"), F.when(is_reply, usage).alias("usage"), content.alias("content")).alias("message"),
        )
    )
    value = F.when(is_reply, line(reply)).when(is_answer, line(answer)).otherwise(line(text))
    return m.select(F.concat(F.lit("s"), session.cast("string")).alias("file"), seq.cast("long").alias("seq"), value.alias("value"))


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, ts, memo_saved, kind from events."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"),
        "ts",
        "event_id",
        (F.col("event_type") == "purchase").alias("memo_saved"),
        F.col("event_type").alias("kind"),
    )


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_path, link_text, project of each anchor of the pages: links that no page answers."""
    anchor = r'<a\s[^>]*href="([^"]*)"[^>]*>([^<]*)</a>'
    p = table(spark, sf_dir, "pages").select("url", F.explode(F.regexp_extract_all("html", F.lit(anchor), F.lit(2))).alias("link_text"))
    return p.select(
        F.col("url").alias("source_path"),
        F.trim("link_text").alias("link_text"),
        F.coalesce(F.nullif(F.regexp_extract("url", r"^https?://[^/]+/([^/]+)", 1), F.lit("")), F.lit("_vault")).alias("project"),
    )
