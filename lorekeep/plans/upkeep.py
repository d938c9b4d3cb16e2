"""Queries over search results, chunks, names, files and the index's upkeep, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import markdown as M
from lorekeep.operators import chunking, curation, fulltext, graph, index, search, sync, transcripts
from lorekeep.plans import sql as S
from lorekeep.plans.queries import FUSION, JOBS_SQL, NOTE, PAGES, QUESTION, RENDERED, RRF_FUSED, SINCE, TERMS, TIER, index_plan, queue_jobs
from lorekeep.plans.registry import CTE, derived, graph_tables, keyword_index, query, question_vector
from lorekeep.sources import store, vault
from lorekeep.streaming import hooks

LISTED = ", ".join(f"'{t}'" for t in TERMS)


# Search results


@query("search_json", FUSION + RRF_FUSED + """ SELECT path, '{"path":"' || path || '","score":' || round(score, 4) || ',"match_type":"' || match_type || '"}' AS json,
  CASE WHEN match_type IN ('hybrid', 'vector_only') THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS vector_score,
  CASE WHEN match_type IN ('hybrid', 'fts_only') THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS keyword_score FROM f""")
def search_json(s: SparkSession, d: str) -> DataFrame:
    found = search.hybrid(keyword_index(s, d), vault.chunk_vectors(s, d), QUESTION, question_vector(s, d)).select("path", "score", "match_type")
    return search.as_json(found, "path", "score", "match_type").join(search.displayed(found).select("path", "vector_score", "keyword_score"), "path")


@query("search_lines", CTE + S.words(TERMS) + r""", w AS (SELECT path, score FROM sc ORDER BY round(score, 6) DESC, path LIMIT 20)
SELECT path, printf('%.4f  %-11s  %s (%s)', score, 'fts_only', title, path) AS line FROM w JOIN archive USING (path)""")
def search_lines(s: SparkSession, d: str) -> DataFrame:
    found = search.bm25(keyword_index(s, d), TERMS).orderBy(F.round("score", 6).desc(), "path").limit(20)
    titles = derived(s, d, "catalog").select("path", "title")
    return search.as_text(found.withColumn("match_type", F.lit("fts_only")).join(titles, "path"))


@query("highlights", CTE + S.words(TERMS) + rf""", w AS (SELECT path FROM sc ORDER BY round(score, 6) DESC, path LIMIT 10),
t AS (SELECT path, unnest(list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '')) AS word, generate_subscripts(list_filter(regexp_split_to_array(content,
  '\s+'), lambda x: x <> ''), 1) - 1 AS pos
  FROM archive JOIN w USING (path)),
h AS (SELECT *, lower(regexp_replace(word, '[^\p{{L}}\p{{N}}]+', '', 'g')) IN ({LISTED}) AS hit, count(*) OVER
  (PARTITION BY path) AS words FROM t),
c AS (SELECT *, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY pos ROWS BETWEEN CURRENT
  ROW AND 49 FOLLOWING) AS hits FROM h),
m AS (SELECT path, max(hits) AS most FROM c GROUP BY path), b AS (SELECT path, min(pos) AS start FROM c JOIN m
  USING (path) WHERE hits = most GROUP BY path)
SELECT path, CASE WHEN start > 0 THEN '...' ELSE '' END || string_agg(CASE WHEN hit THEN '>>>' || word || '<<<'
  ELSE word END, ' ' ORDER BY pos)
  || CASE WHEN start + 50 < any_value(words) THEN '...' ELSE '' END AS snippet FROM h JOIN b USING (path) WHERE
  pos >= start AND pos < start + 50 GROUP BY path, start""")
def highlights(s: SparkSession, d: str) -> DataFrame:
    """The best window of each of the ten best documents."""
    best = search.bm25(keyword_index(s, d), TERMS).orderBy(F.round("score", 6).desc(), "path").limit(10).select("path")
    return search.best_windows(vault.archive(s, d).join(F.broadcast(best), "path", "left_semi"), TERMS)


@query("fts_grammar", CTE + S.ARCHIVE + r""", t AS (SELECT path, type, ' ' || trim(lower(regexp_replace(content, '[^\p{L}\p{N}]+', ' ', 'g'))) || ' ' AS w,
  ' ' || lower(regexp_replace(title, '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS n FROM archive)
SELECT path, type FROM t WHERE (contains(w, ' of the ') AND (contains(w, ' han') OR contains(n, ' han')) AND NOT
  (contains(w, ' thing ') OR contains(n, ' thing ')))
  OR (contains(n, ' doc ') AND contains(n, ' 1')) OR regexp_matches(w, ' la (?:[^ ]+ ){0,3}que | que (?:[^ ]+ ){0,3}la ')""")
def fts_grammar(s: SparkSession, d: str) -> DataFrame:
    """Words, phrases, NOT, a prefix, a column and NEAR."""
    asked = '(content:"of the" han* NOT thing) OR (title:doc title:1*) OR content:NEAR(la que, 3)'
    found = fulltext.matching(derived(s, d, "positions"), asked, ("content", "title"))
    return derived(s, d, "catalog").join(found, "path", "left_semi").select("path", "type")


@query("knn_batch", """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT q.vec_id AS query, v.vec_id,
  list_distance(v.e, q.e) AS distance
  FROM v q, v WHERE q.vec_id % 50 = 0)
SELECT query, vec_id, round(distance, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query
  ORDER BY round(distance, 9), vec_id) AS rank FROM p) WHERE rank <= 5""")
def knn_batch(s: SparkSession, d: str) -> DataFrame:
    """The nearest vectors of every fiftieth one, the query set, in blocks of queries."""
    e = vault.table(s, d, "embeddings").select("vec_id", "embedding")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"))
    return search.nearest_of_all(e, asked, 5).select("query", "vec_id", "distance", "rank")


# Chunks and texts


@query(
    "content_routes",
    CTE + S.NOTES + """ SELECT path, CASE WHEN contains(path, '/transcripts/') THEN 'transcript' WHEN contains(path, '/auto-memory/') THEN
  'auto-memory' ELSE type END AS route FROM docs""",
)
def content_routes(s: SparkSession, d: str) -> DataFrame:
    return vault.notes(s, d).select("path", chunking.route(F.col("path"), F.col("raw")).alias("route"))


@query("whole_chunks", CTE + S.NOTES + r""" SELECT path AS doc_path, type AS chunk_type, sha256('[Project: ' || project || ' | Title: ' || title || ']' ||
  chr(10) || chr(10) || raw) AS content_hash
FROM docs JOIN notes USING (path) WHERE type IN ('memo', 'concept') AND len(regexp_extract_all(raw, '\S+')) <=
  1800""")
def whole_chunks(s: SparkSession, d: str) -> DataFrame:
    made = chunking.chunks(vault.notes(s, d))
    return made.where(F.col("chunk_type").isin(*chunking.WHOLE_TYPES)).select("doc_path", "chunk_type", "content_hash")


@query("shortened_results", CTE + S.ARCHIVE + r""", r AS (SELECT path, replace(content, '`', '') || chr(10) AS t FROM archive)
SELECT path, '**Result:**' || chr(10) || '```' || CASE WHEN length(t) <= 500 THEN t ELSE left(t, 350) || chr(10)
  || chr(10) || '[...truncated ' || (length(t) - 450) || ' chars...]' || chr(10) || chr(10)
  || right(t, 100) END || '```' || chr(10) || 'after' AS text FROM r""")
def shortened_results(s: SparkSession, d: str) -> DataFrame:
    """Documents as tool results."""
    text = F.concat(F.lit("**Result:**\n```"), F.replace("content", F.lit("`"), F.lit("")), F.lit("\n```\nafter"))
    return vault.archive(s, d).select("path", chunking.results_shortened(text).alias("text"))


@query("text_ends", CTE + S.ARCHIVE + r""", w AS (SELECT path, list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '') AS w FROM archive)
SELECT path, array_to_string(w[1:40], ' ') AS head, array_to_string(w[-30:], ' ') AS tail FROM w""")
def text_ends(s: SparkSession, d: str) -> DataFrame:
    one = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    c = F.col("content")
    return vault.archive(s, d).select("path", one(chunking.first_words(c, 40)).alias("head"), one(chunking.last_words(c, 30)).alias("tail"))


@query(
    "note_overviews",
    CTE + S.NOTES + r""" SELECT path, nullif(trim(regexp_extract(replace(raw, '## Summary', '## Overview'), '(?s)(## Overview.*?)\n## Open Threads',
  1), chr(10)), '') AS overview FROM notes""",
)
def note_overviews(s: SparkSession, d: str) -> DataFrame:
    raw = F.replace("raw", F.lit("## Summary"), F.lit("## Overview"))
    return vault.notes(s, d).select("path", F.trim(M.overview(raw), F.lit("\n")).alias("overview"))


@query(
    "plain_topics",
    CTE + S.NOTES + r""" SELECT path, sha256('topics:' || chr(10) || '  - x' || (doc_id % 7) || chr(10) || '  - y' || chr(10) || content)
  AS kept FROM notes JOIN docs USING (path)""",
)
def plain_topics(s: SparkSession, d: str) -> DataFrame:
    """Notes whose topics are listed as quoted links."""
    n = vault.notes(s, d).select("path", "doc_id", M.body(F.col("raw")).alias("content"))
    raw = F.concat(F.lit('topics:\n  - "[[x'), (F.col("doc_id") % 7).cast("string"), F.lit("]]\"\n  - '[[?y|why]]'\n"), "content")
    return n.select("path", F.sha2(M.plain_topics(raw), 256).alias("kept"))


@query("stamped_notes", CTE + S.NOTES + r""" SELECT path, sha256(CASE WHEN length(content) = 0 THEN raw ELSE '---' || chr(10) || trim(b, chr(10)) || chr(10)
  || 'input_tokens: ' || length(content)
  || CASE WHEN doc_id % 7 > 0 THEN chr(10) || 'output_tokens: ' || (doc_id % 7) ELSE '' END || chr(10) || substr(raw,
  4 + length(b)) END) AS stamped FROM notes JOIN fm USING (path, raw) JOIN docs USING (path)""")
def stamped_notes(s: SparkSession, d: str) -> DataFrame:
    raw = F.col("raw")
    fields = {"input_tokens": F.length(M.body(raw)), "output_tokens": F.col("doc_id") % 7}
    return vault.notes(s, d).select("path", F.sha2(M.stamped(raw, fields), 256).alias("stamped"))


# Names


@query("project_names", r"""WITH p AS (SELECT DISTINCT url FROM pages), q AS (SELECT url, regexp_replace(regexp_replace(regexp_replace(url,
  '[^\p{L}\p{N}_-]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS n FROM p)
SELECT url, left(n, 50) AS safe, left(n, 50) || '-' || left(md5(url), 6) AS other, regexp_extract(url, '^https?://([^/]+)',
  1) AS folder, 'repo' AS remote FROM q""")
def project_names(s: SparkSession, d: str) -> DataFrame:
    """Names made of addresses: safe, apart from another folder's, from a log folder and from a repository's address."""
    url = F.col("url")
    host = F.regexp_extract(url, "^https?://([^/]+)", 1)
    p = vault.table(s, d, "pages").select("url").distinct()
    folder = M.folder_project(F.concat(F.lit("-Users-alice-Documents-"), host))
    remote = M.remote_project(F.concat(F.lit("https://"), host, F.lit("/user/repo.git")))
    return p.select(
        "url",
        M.project_name(url).alias("safe"),
        M.unique_name(url, url, F.lit(True)).alias("other"),
        folder.alias("folder"),
        remote.alias("remote"),
    )


@query(
    "session_suffixes",
    """SELECT conv_id AS session, CASE WHEN conv_id % 2 = 0 THEN left(md5(CAST(conv_id AS VARCHAR)), 8) END AS suffix FROM
  (SELECT DISTINCT conv_id FROM conversations)""",
)
def session_suffixes(s: SparkSession, d: str) -> DataFrame:
    """Of file names that end in a suffix, and of others."""
    i = F.col("session")
    name = F.concat(F.when(i % 2 == 0, "20240101-120000-").otherwise("note-"), F.left(F.md5(i.cast("string").cast("binary")), F.lit(8)), F.lit(".md"))
    return vault.messages(s, d).select("session").distinct().select("session", M.session_suffix(name).alias("suffix"))


# Files, state and queues


@query("vault_files", CTE + S.NOTES + r""" SELECT path, sha256(raw) AS content_hash, CAST(strlen(raw) AS BIGINT) AS bytes FROM notes WHERE doc_id % 17 <> 0""")
def vault_files(s: SparkSession, d: str) -> DataFrame:
    """Notes written as files, one each, and read again; archived ones (every 17th has that status) are left out by the reader."""
    root = store.fresh(s, "vault")
    store.write_files(vault.notes(s, d).select("path", "raw"), root).write.format("noop").mode("overwrite").save()
    return vault.markdown(s, root).select("path", F.sha2("raw", 256).alias("content_hash"), "bytes")


def written_logs(s: SparkSession, d: str) -> str:
    """Sessions as files in project folders, each written message by message, so none is held whole; their root."""
    path = F.concat(F.lit("p"), (F.col("session") % 7).cast("string"), F.lit("/s"), F.col("session").cast("string"), F.lit(".jsonl"))
    line = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"))
    root = store.fresh(s, "logs")
    parts = vault.messages(s, d).select(path.alias("path"), F.col("seq").alias("part"), line.alias("raw"))
    store.write_parts(parts, root).write.format("noop").mode("overwrite").save()
    return root


@query("project_logs", """WITH l AS (SELECT conv_id % 7 AS p, conv_id, sum(strlen(coalesce(text, '')) + 1) AS bytes FROM conversations GROUP BY 1, 2)
SELECT 'p' || p AS project, count(*) AS sessions, CAST(sum(bytes) AS BIGINT) AS bytes FROM l WHERE bytes >= 1024 GROUP BY p""")
def project_logs(s: SparkSession, d: str) -> DataFrame:
    """Logs written as files in project folders; small ones don't count."""
    return vault.log_files(s, written_logs(s, d)).select("project", "sessions", "bytes")


@query("log_samples", """WITH l AS (SELECT conv_id, sum(strlen(coalesce(text, '')) + 1) AS bytes,
  sum(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> ''))) AS lines FROM conversations
  GROUP BY 1)
SELECT 'p' || (conv_id % 7) AS project, 's' || conv_id AS session, CAST(bytes AS BIGINT) AS bytes, CAST(least(lines,
  11) AS BIGINT) AS lines FROM l WHERE bytes >= 1024""")
def log_samples(s: SparkSession, d: str) -> DataFrame:
    return vault.log_samples(s, written_logs(s, d))


@query("memory_scan", CTE + S.NOTES + """, f AS (SELECT doc_id, project, raw FROM notes JOIN docs USING (path) WHERE contains(path, '/auto-memory/'))
SELECT '-Users-alice-Documents-' || project || '/memory/' || CASE WHEN doc_id % 20 = 9 THEN 'm' ELSE 'd' END ||
  doc_id || '.md' AS path, project AS display, project, FALSE AS volatile,
  sha256(raw) AS content_hash FROM f WHERE project <> 'src3'""")
def memory_scan(s: SparkSession, d: str) -> DataFrame:
    """Notes of a tool's memory written as its files and scanned, one project left out."""
    n = vault.notes(s, d).where(F.col("path").contains("/auto-memory/"))
    i = F.col("doc_id")
    name = F.concat(F.when(i % 20 == 9, "m").otherwise("d"), i.cast("string"), F.lit(".md"))
    path = F.concat(F.lit("-Users-alice-Documents-"), F.split_part("path", F.lit("/"), F.lit(2)), F.lit("/memory/"), name)
    root = store.fresh(s, "memory")
    store.write_files(n.select(path.alias("path"), "raw"), root).write.format("noop").mode("overwrite").save()
    found = sync.scanned(vault.memory_files(s, root), exclude=("-Users-alice-Documents-src3",))
    return found.select("path", "display", "project", "volatile", F.sha2("raw", 256).alias("content_hash"))


@query("sync_states", CTE + S.NOTES + """ SELECT path, sha256(raw) AS source_hash, date AS synced, 'p:' || path AS source, doc_id % 20 = 9 AS volatile
FROM notes JOIN docs USING (path) WHERE contains(path, '/auto-memory/')""")
def sync_states(s: SparkSession, d: str) -> DataFrame:
    """What the copies say of their sources."""
    n = vault.notes(s, d).withColumn("date", M.value(M.frontmatter(F.col("raw")), "date"))
    volatile = F.when(F.col("doc_id") % 20 == 9, "true")
    fields = {"source_hash": F.sha2("raw", 256), "synced": F.col("date"), "source": F.concat(F.lit('"p:'), "path", F.lit('"')), "volatile": volatile}
    return sync.states(n.select("path", M.formatted(fields).alias("raw")))


@query("archived_ids", """WITH t AS (SELECT DISTINCT conv_id, CASE WHEN conv_id % 3 > 0 THEN '20240101-120000-' ELSE '' END || left(md5(CAST(conv_id
  AS VARCHAR)), 12) AS stem FROM conversations)
SELECT DISTINCT session_id FROM (SELECT stem AS session_id FROM t UNION ALL SELECT CASE WHEN conv_id % 3 > 0 THEN
  substr(stem, 17) ELSE left(stem, 8) END FROM t)""")
def archived_ids(s: SparkSession, d: str) -> DataFrame:
    """Of transcripts whose names begin with a time, and of others."""
    i = F.col("session")
    stem = F.concat(F.when(i % 3 > 0, "20240101-120000-").otherwise(""), F.left(F.md5(i.cast("string").cast("binary")), F.lit(12)))
    paths = vault.messages(s, d).select("session").distinct().select(F.concat(F.lit("projects/p/transcripts/"), stem, F.lit(".jsonl")).alias("path"))
    return curation.archived_ids(paths)


@query("state_rows", "SELECT 's' || user_id AS session_id, event_type AS phase, event_id FROM events WHERE event_id % 10 > 0")
def state_rows(s: SparkSession, d: str) -> DataFrame:
    """State written as JSON lines, one in ten of them broken off; corrupt ones are skipped."""
    e = vault.session_events(s, d).select("session_id", F.col("kind").alias("phase"), "event_id")
    line = F.to_json(F.struct("session_id", "phase", "event_id"))
    root = store.fresh(s, "state")
    e.select(F.when(F.col("event_id") % 10 > 0, line).otherwise(F.left(line, F.lit(12))).alias("value")).write.text(root)
    return vault.state(s, root, "session_id string, phase string, event_id long")


@query("log_errors", """SELECT CAST(count(*) AS BIGINT) AS lines, count(*) FILTER (turn % 5 = 0) AS errors FROM conversations""")
def log_errors(s: SparkSession, d: str) -> DataFrame:
    """Logs written as JSON lines, one in five of them broken off: each line is read, malformed ones are counted."""
    lines = vault.logs(s, d)
    root = store.fresh(s, "lines")
    lines.select(F.when(F.col("seq") % 5 == 0, F.left("value", F.lit(9))).otherwise(F.col("value")).alias("value")).write.text(root)
    return vault.parse_errors(vault.jsonl(s, root)).agg(F.sum("lines").alias("lines"), F.sum("errors").alias("errors"))


@query("queue_remaining", JOBS_SQL + " SELECT path FROM (SELECT path, row_number() OVER (ORDER BY since, path) AS nth FROM q) WHERE nth > 5")
def queue_remaining(s: SparkSession, d: str) -> DataFrame:
    """What the stored queue holds after its oldest five jobs were taken."""
    root, done = queue_jobs(s, d)
    hooks.taken(s, root, done, 5)
    return hooks.stored(s, root).select("path")


@query("memo_queue", "SELECT 's' || user_id AS session_id, count(*) AS attempts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') "
    "AS last_attempt FROM events WHERE event_type = 'error' GROUP BY user_id")
def memo_queue(s: SparkSession, d: str) -> DataFrame:
    """Attempts of each pending session; errors count as attempts."""
    e = vault.session_events(s, d).where("kind = 'error'").select("session_id", F.col("ts").alias("at"))
    return hooks.queue_state(e).select("session_id", "attempts", F.date_format("last_attempt", "yyyy-MM-dd HH:mm:ss").alias("last_attempt"))


IMPORTED = (
    (
    CTE + RENDERED + NOTE.replace("SELECT session, CAST(0 AS BIGINT) AS part", ", parts AS (SELECT session, CAST(0 AS BIGINT) AS part")
    + """), w AS (SELECT conv_id AS session, count(*) >= 6 OR count(*) FILTER (contains(text, 'tool_use')) > 0 AS viable
  FROM conversations GROUP BY 1),
f AS (SELECT session, sha256(string_agg(raw, '' ORDER BY part)) AS content_hash FROM parts GROUP BY session)
SELECT w.session, CASE WHEN viable THEN 'imported' ELSE 'skipped' END AS action, CASE WHEN viable THEN content_hash
  END AS content_hash FROM w LEFT JOIN f USING (session)"""
)
)


@query("imported_sessions", IMPORTED)
def imported_sessions(s: SparkSession, d: str) -> DataFrame:
    """Sessions worth archiving are written as files from their parts, and read again; others are skipped."""
    m = vault.messages(s, d)
    viable = hooks.viable(m.select(F.col("session").alias("session_id"), "text")).select(F.col("session_id").alias("session"))
    parts = transcripts.notes(transcripts.turns(m.join(viable, "session", "left_semi")))
    path = F.concat(F.lit("projects/p/transcripts/"), F.col("session").cast("string"), F.lit(".md"))
    root = store.fresh(s, "imported")
    store.write_parts(parts.select(path.alias("path"), "part", "raw"), root).write.format("noop").mode("overwrite").save()
    made = vault.markdown(s, root)
    stem = F.regexp_extract("path", r"([^/]+)\.md$", 1).cast("long")
    files = made.select(stem.alias("session"), F.sha2("raw", 256).alias("content_hash"))
    action = F.when(F.col("content_hash").isNotNull(), "imported").otherwise("skipped")
    return m.select("session").distinct().join(files, "session", "left").select("session", action.alias("action"), "content_hash")


@query("memory_read", CTE + S.NOTES + " SELECT path, sha256(raw) AS content_hash FROM notes WHERE path = 'topics/d8.md'")
def memory_read(s: SparkSession, d: str) -> DataFrame:
    return vault.read_note(vault.notes(s, d), "topics/d8.md").select("path", F.sha2("raw", 256).alias("content_hash"))


# Index, sync and reports


@query("index_status", CTE + S.GRAPH + """, vec AS (SELECT path FROM embeddings JOIN archive ON archive.doc_id = vec_id // 3 * 31 % (SELECT count(*) FROM
  documents))
SELECT 'documents' AS what, type AS name, count(*) AS count FROM docs GROUP BY type UNION ALL SELECT 'links', 'all',
  count(*) FROM resolved UNION ALL SELECT 'links', 'open', count(*) FILTER (is_broken) FROM resolved
  UNION ALL SELECT 'tasks', 'all', count(*) FROM tasks UNION ALL SELECT 'tasks', 'open', count(*) FILTER (NOT completed)
  FROM tasks UNION ALL SELECT 'vectors', 'documents', count(DISTINCT path) FROM vec""")
def index_status(s: SparkSession, d: str) -> DataFrame:
    _, docs, resolved, tasks = graph_tables(s, d)
    return index.described(docs, resolved, tasks, vault.chunk_vectors(s, d))


@query("index_changes", CTE + S.NOTES + """, h AS (SELECT doc_id, CASE WHEN doc_id % 13 = 1 THEN 'new' WHEN doc_id % 13 = 0 THEN 'deleted' WHEN doc_id % 5
  = 0 THEN 'updated' ELSE 'unchanged' END AS action FROM notes)
SELECT action, count(*) AS notes FROM h GROUP BY action""")
def index_changes(s: SparkSession, d: str) -> DataFrame:
    return index.changes(index_plan(s, d))


BUILT = (
    CTE + S.GRAPH + r""", t AS (SELECT path, unnest(string_split(lower(regexp_replace(content, '[^\p{L}\p{N}]+', ' ', 'g')), ' ')) AS term
  FROM docs)
SELECT 'documents' AS table_name, count(*) AS row_count FROM docs UNION ALL SELECT 'links', count(*) FROM links
  UNION ALL SELECT 'tasks', count(*) FROM tasks UNION ALL SELECT 'headings', count(*) FROM heads
  UNION ALL SELECT 'tags', count(*) FROM tags UNION ALL SELECT 'aliases', count(*) FROM aliases UNION ALL SELECT
  'hashes', count(*) FROM notes UNION ALL SELECT 'catalog', count(*) FROM docs
  UNION ALL SELECT 'postings', count(DISTINCT (path, term)) FROM t WHERE term <> ''"""
)


@query("index_build", BUILT)
def index_build(s: SparkSession, d: str) -> DataFrame:
    """Rows of each table of a full build, but for the chunks."""
    version = index.full(vault.notes(s, d).select("path", "raw"), store.fresh(s, "index"))
    return index.status(version, s).where("table_name <> 'chunks'")


@query("index_segments", BUILT)
def index_segments(s: SparkSession, d: str) -> DataFrame:
    """The same after a first build of an earlier state, two builds with changes and a compaction: notes are new, changed and deleted on the way."""
    last = vault.notes(s, d)
    i, root = F.col("doc_id"), store.fresh(s, "index")
    changed = F.when(i % 10 == 1, F.concat("raw", F.lit("\n- [ ] an old task\n"))).otherwise(F.col("raw"))
    extra = last.where(i % 50 == 7).withColumn("path", F.concat("path", F.lit(".old.md")))  # deleted later
    first = last.where(i % 10 != 3).withColumn("raw", changed).unionByName(extra)
    second = last.where(i % 20 != 3).withColumn("raw", F.when(i % 20 == 1, changed).otherwise(F.col("raw"))).unionByName(extra)
    version = index.full(first.select("path", "raw"), root)
    for state in (second, last):
        version = index.incremental(state.select("path", "raw"), version, root)
    return index.status(index.compacted(version, root), s).where("table_name <> 'chunks'")


@query("open_tasks_top", CTE + S.GRAPH + f""" SELECT doc_path, task_text, line_number, title, date FROM tasks LEFT JOIN docs ON path = doc_path WHERE NOT completed
  AND NOT contains(doc_path, '/transcripts/')
  AND section = 'Open Threads' AND (date >= '{SINCE}' OR date IS NULL) ORDER BY date DESC NULLS LAST, doc_path,
  line_number LIMIT 50""")
def open_tasks_top(s: SparkSession, d: str) -> DataFrame:
    _, docs, _, tasks = graph_tables(s, d)
    return graph.newest_tasks(graph.open_tasks(tasks, docs, SINCE), 50).select("doc_path", "task_text", "line_number", "title", "date")


@query(
    "project_broken_links",
    CTE + S.LINKS + " SELECT source_path, link_text, line_number FROM resolved WHERE is_broken AND starts_with(source_path, 'projects/src1/')",
)
def project_broken_links(s: SparkSession, d: str) -> DataFrame:
    return graph.broken(derived(s, d, "links"), "src1").select("source_path", "link_text", "line_number")


@query("outlinks", CTE + S.LINKS + " SELECT source_path, link_text, target_path, line_number FROM resolved")
def outlinks(s: SparkSession, d: str) -> DataFrame:
    return graph.outlinks(derived(s, d, "links"))


@query(
    "crystallization_top",
    CTE + PAGES + f", t AS (SELECT link, refs, projects, {TIER} AS tier FROM refs) SELECT * FROM t ORDER BY CASE "
    f"tier WHEN 'OVERDUE' THEN 1 WHEN 'READY' THEN 2 WHEN 'MATURING' THEN 3 ELSE 4 END, refs DESC, link LIMIT 30",
)
def crystallization_top(s: SparkSession, d: str) -> DataFrame:
    r = curation.link_refs(vault.page_links(s, d))
    return curation.ranked(r.withColumn("tier", curation.tier(F.col("refs"), F.col("projects"))), 30)


@query("unaliased_links", CTE + PAGES + " SELECT link, refs, projects FROM refs WHERE lower(link) NOT IN (SELECT lower(link) FROM refs WHERE refs % 2 = 1)")
def unaliased_links(s: SparkSession, d: str) -> DataFrame:
    """Links that no alias answers; those with an odd number of references are made aliases."""
    r = curation.link_refs(vault.page_links(s, d))
    return curation.without_aliases(r, r.where("refs % 2 = 1").select(F.upper("link").alias("alias")))


@query("memo_suffixes", CTE + S.ARCHIVE + """ SELECT DISTINCT suffix FROM (SELECT left(md5(CAST(doc_id // 10 AS VARCHAR)), 8) AS suffix FROM archive WHERE type = 'memo'
  UNION ALL SELECT left(md5(CAST(user_id AS VARCHAR)), 8) FROM events)""")
def memo_suffixes(s: SparkSession, d: str) -> DataFrame:
    """Suffixes that memos or the state know."""
    suffix = lambda c: F.left(F.md5(c.cast("string").cast("binary")), F.lit(8)).alias("suffix")
    memos = vault.archive(s, d).where("type = 'memo'").select(suffix(F.floor(F.col("doc_id") / 10)))
    return curation.known_suffixes(memos, vault.table(s, d, "events").select(suffix(F.col("user_id"))))


@query("sync_plan", CTE + S.NOTES + """, m AS (SELECT doc_id, path FROM notes WHERE contains(path, '/auto-memory/'))
SELECT path, CASE WHEN doc_id // 10 % 4 = 0 THEN 'new' WHEN doc_id // 10 % 4 = 1 THEN 'updated' ELSE 'unchanged' END AS action FROM m""")
def sync_plan(s: SparkSession, d: str) -> DataFrame:
    """Notes of the tool's memory against the copies kept of three in four, a third of them of older texts."""
    n = vault.notes(s, d).where(F.col("path").contains("/auto-memory/"))
    part = F.floor(F.col("doc_id") / 10) % 4
    old = n.where(part != 0).select("path", F.when(part == 1, "older").otherwise(F.sha2("raw", 256)).alias("content_hash"))
    return sync.plan(sync.sources(n), old)


@query("synced_notes", CTE + S.NOTES + r""" SELECT path, sha256('---' || chr(10) || 'type: auto-memory' || chr(10) || 'source: ' || path || chr(10) || '---'
  || chr(10) || chr(10)
  || rtrim(regexp_replace(raw, '(?s)^---.*?---\n*', ''), ' ' || chr(9) || chr(10) || chr(13)) || chr(10) || chr(10)
  || chr(10) || '## Vault Annotations' || chr(10)
  || CASE WHEN doc_id % 20 = 9 THEN 'mine ' || doc_id ELSE '' END) AS written FROM notes WHERE contains(path, '/auto-memory/')""")
def synced_notes(s: SparkSession, d: str) -> DataFrame:
    """The copy that is written of each; the annotations of the copies that have some stay."""
    n = vault.notes(s, d).where(F.col("path").contains("/auto-memory/"))
    i = F.col("doc_id")
    kept = F.concat(F.lit("old text\n\n## Vault Annotations\n"), F.when(i % 20 == 9, F.concat(F.lit("mine "), i.cast("string"), F.lit("\n"))).otherwise(" \n"))
    made = sync.note(F.col("raw"), {"type": F.lit("auto-memory"), "source": F.col("path")}, kept)
    return n.select("path", F.sha2(made, 256).alias("written"))
