"""Registered queries over the given tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import markdown as M
from lorekeep.operators import chunking, context, curation, extract, fulltext, graph, index, search, sync, transcripts
from lorekeep.plans import sql as S
from lorekeep.plans.registry import CTE, ORACLE_SQL, QUERIES, derived, graph_tables, keyword_index, query, question_vector, ranked_index
from lorekeep.sources import store, vault
from lorekeep.streaming import hooks

__all__ = ["ORACLE_SQL", "QUERIES"]

QUESTION = "what is the thing and hand that thion erent"
TERMS = search.keywords(QUESTION)
SINCE, WEEK = "2024-02-01", "2024-02-23"


# Search

top = lambda df, k: df.orderBy(F.round("score", 6).desc(), "path").limit(k)


@query("bm25_topk", CTE + S.words(TERMS) + "SELECT path, round(score, 6) AS score FROM sc ORDER BY round(score, 6) DESC, path LIMIT 10")
def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    return top(search.bm25(keyword_index(s, d), TERMS), 10)


@query("fts_boolean", CTE + S.ARCHIVE + r", t AS (SELECT path, type, ' ' || trim(lower(regexp_replace(content, '[^\p{L}\p{N}]+', ' ', "
    r"'g'))) || ' ' AS w FROM archive) SELECT path, type FROM t WHERE (contains(w, ' of the ') AND contains(w, ' hand ')) OR contains(w, ' la que "
    r"')")
def fts_boolean(s: SparkSession, d: str) -> DataFrame:
    found = fulltext.matching(derived(s, d, "positions"), '"of the" hand OR "la que"')
    return derived(s, d, "catalog").join(found, "path", "left_semi").select("path", "type")


@query("like_fallback", CTE + S.ARCHIVE + " SELECT path, -1.0::DOUBLE AS score, substr(content, 1, 200) AS snippet FROM archive WHERE "
    "contains(lower(content), 'thing,')")
def like_fallback(s: SparkSession, d: str) -> DataFrame:
    """The comma is no part of the grammar, so the query is looked for as it is."""
    return search.text_search(lambda: keyword_index(s, d), lambda: derived(s, d, "positions"), vault.archive(s, d), "thing,")


@query("fts_ranked", CTE + S.words(["hand", "with"]) + r""", t AS (SELECT path, content, ' ' || trim(lower(regexp_replace(content, '[^\p{L}\p{N}]+', ' ', 'g'))) || ' ' AS w FROM archive)
  SELECT t.path, round(score, 6) AS score, substr(content, 1, 200) AS snippet FROM t JOIN sc USING (path) WHERE contains(w, ' hand with ')""")
def fts_ranked(s: SparkSession, d: str) -> DataFrame:
    """A phrase, from positions, with scores and the start of each text."""
    return search.text_search(keyword_index(s, d), derived(s, d, "positions"), vault.archive(s, d), '"hand with"')


@query("prefix_terms", CTE + S.ARCHIVE + r""", t AS (SELECT DISTINCT path, unnest(string_split(lower(regexp_replace(content, '[^\p{L}\p{N}]+', ' ', 'g')), ' ')) AS term FROM archive)
  SELECT term, count(*) AS df FROM t WHERE starts_with(term, 'han') GROUP BY term""")
def prefix_terms(s: SparkSession, d: str) -> DataFrame:
    """A range of the dictionary."""
    return derived(s, d, "terms").where(F.col("term").startswith("han")).select("term", "df")


def nearest_chunks(s: SparkSession, d: str, metric: str) -> DataFrame:
    """The nearest vectors first, then the paths of these few."""
    found = F.broadcast(search.nearest(vault.vectors(s, d), question_vector(s, d), 20, metric))  # 20 rows
    return vault.archive(s, d).select("doc_id", "path").join(found, "doc_id").select("vec_id", "path", (F.round("distance", 6) + 0.0).alias("distance"))  # no -0.0


@query("knn_l2", CTE + S.ARCHIVE + ", " + S.vectors(20) + " SELECT vec_id, path, round(distance, 6) AS distance FROM near")
def knn_l2(s: SparkSession, d: str) -> DataFrame:
    return nearest_chunks(s, d, "l2")


@query("knn_cosine", CTE + S.ARCHIVE + ", " + S.vectors(20, "cosine") + " SELECT vec_id, path, round(distance, 6) + 0.0 AS distance FROM near")
def knn_cosine(s: SparkSession, d: str) -> DataFrame:
    return nearest_chunks(s, d, "cosine")


@query("best_chunk_per_doc", CTE + S.ARCHIVE + ", " + S.vectors(60) + " SELECT path, vec_id, round(distance, 6) AS distance FROM chunk")
def best_chunk_per_doc(s: SparkSession, d: str) -> DataFrame:
    return search.best_chunk(search.nearest(vault.chunk_vectors(s, d), question_vector(s, d), 60)).select("path", "vec_id", "distance")


RANKS = "w AS (SELECT path, score, row_number() OVER (ORDER BY round(score, 6) DESC, path) - 1 AS wr FROM sc ORDER BY round(score, 6) DESC, path LIMIT 60), "
FUSION = (
    CTE + S.words(TERMS) + ", " + S.vectors(60) + ", " + RANKS + "v AS (SELECT path, distance, row_number() OVER (ORDER BY round(distance, 9), path) - 1 AS "
    "vr FROM chunk), "
)
MEMOS = f"type = 'memo' AND date >= '{SINCE}'"
FILTERED = (
    CTE + S.words(TERMS, MEMOS) + ", " + S.vectors(60) + ", " + RANKS + f"v AS (SELECT path, distance, row_number() OVER (ORDER BY round(distance, 9), path) - 1 AS "
    f"vr FROM chunk WHERE path IN (SELECT path FROM archive WHERE {MEMOS})), "
)
KIND = "CASE WHEN w.path IS NOT NULL AND v.path IS NOT NULL THEN 'hybrid' WHEN w.path IS NULL THEN 'vector_only' ELSE 'fts_only' END AS match_type"


RRF_FUSED = (
    f"f0 AS (SELECT coalesce(w.path, v.path) AS path, coalesce(1.0::DOUBLE / (61 + wr), 0) + coalesce(1.0::DOUBLE / (61 + vr), 0) AS score, {KIND} "
    "FROM w FULL OUTER JOIN v ON w.path = v.path), f AS (SELECT * FROM f0 ORDER BY round(score, 9) DESC, path LIMIT 20)"
)
RRF = RRF_FUSED + " SELECT path, round(score, 6) AS score, match_type, title, type, project FROM f JOIN archive USING (path)"


@query("hybrid_search", FUSION + RRF)
def hybrid_search(s: SparkSession, d: str) -> DataFrame:
    return search.hybrid(keyword_index(s, d), vault.chunk_vectors(s, d), QUESTION, question_vector(s, d))


@query("hybrid_linear", FUSION + f"m AS (SELECT path, CASE WHEN max(score) OVER () - min(score) OVER () < 0.1 THEN 0.5 ELSE (score "
    f"- min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS score FROM w), f0 AS (SELECT coalesce(w.path, v.path) AS path, CASE "
    f"WHEN w.path IS NOT NULL AND v.path IS NOT NULL THEN (1 - distance / 2) * 0.7 + w.score * 0.3 ELSE coalesce(1 - distance / 2, w.score) END AS "
    f"score, {KIND} FROM m AS w FULL OUTER JOIN v ON w.path = v.path), f AS (SELECT * FROM f0 ORDER BY round(score, 9) DESC, path LIMIT 20) SELECT "
    f"path, round(score, 6) AS score, match_type, title, type, project FROM f JOIN archive USING (path)")
def hybrid_linear(s: SparkSession, d: str) -> DataFrame:
    return search.hybrid(keyword_index(s, d), vault.chunk_vectors(s, d), QUESTION, question_vector(s, d), scoring="linear")


@query("hybrid_filtered", FILTERED + RRF)
def hybrid_filtered(s: SparkSession, d: str) -> DataFrame:
    return search.hybrid(keyword_index(s, d), vault.chunk_vectors(s, d), QUESTION, question_vector(s, d), type="memo", since=SINCE)


STOP = ", ".join(f"'{w}'" for w in search.STOPWORDS)
ASKED = (
    rf"""q0 AS (SELECT item_id, unnest(regexp_split_to_array(lower(regexp_replace(text, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')),
  '\s+')) AS term, generate_subscripts(regexp_split_to_array(lower(regexp_replace(text, '[^\p{{L}}\p{{N}}_\s]',
  ' ', 'g')), '\s+'), 1) AS n FROM benchmark),
q1 AS (SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY n) AS n FROM q0 WHERE length(term)
  > 2 AND term NOT IN ({STOP})), q AS (SELECT DISTINCT item_id, term FROM q1 WHERE n <= 7)"""
)


@query("query_keywords", CTE + ASKED + " SELECT item_id, term FROM q")
def query_keywords(s: SparkSession, d: str) -> DataFrame:
    b = vault.table(s, d, "benchmark")
    return b.select("item_id", F.explode(F.array_distinct(search.keywords_of(F.col("text")))).alias("term"))


BATCH = (
    CTE + S.ARCHIVE + ", " + ASKED + r""", tk AS (SELECT path, unnest(string_split(lower(regexp_replace(content, '[^\p{L}\p{N}]+', ' ', 'g')), ' ')) AS term
  FROM archive),
len AS (SELECT path, count(*) FILTER (term <> '') AS l FROM tk GROUP BY path), st AS (SELECT count(*) AS n, avg(l)
  AS a FROM len), tf AS (SELECT path, term, count(*) AS tf FROM tk WHERE term IN (SELECT term FROM q) GROUP BY path,
  term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT item_id, path, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25
  + 0.75 * l / a))) AS score FROM q JOIN tf USING (term) JOIN df USING (term) JOIN len USING (path), st GROUP BY
  item_id, path)
SELECT item_id, path, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER
  BY round(score, 6) DESC, path) AS rank FROM sc) WHERE rank <= 3"""
)


@query("bm25_batch", BATCH)
def bm25_batch(s: SparkSession, d: str) -> DataFrame:
    b = vault.table(s, d, "benchmark").select("item_id", search.keywords_of(F.col("text")).alias("terms"))
    return search.bm25_batch(ranked_index(s, d), b, 3)


@query("bm25_stemmed")
def bm25_stemmed(s: SparkSession, d: str) -> DataFrame:
    b = vault.table(s, d, "benchmark").select("item_id", search.keywords_of(F.col("text")).alias("terms"))
    return search.bm25_batch(ranked_index(s, d, stemmed=True), b, 3, stemmed=True)


@query("snippets", CTE + S.NOTES + r""" SELECT path, substr(regexp_replace(content, '\s+', ' ', 'g'), 1, 200) || CASE WHEN length(content) > 200 THEN '...'
  ELSE '' END AS snippet FROM docs""")
def snippets(s: SparkSession, d: str) -> DataFrame:
    return vault.notes(s, d).select("path", M.snippet(F.col("raw")).alias("snippet"))


RELATED = (
    (
    CTE + S.ARCHIVE + rf""", a AS (SELECT path AS asks, list_distinct(list_slice(list_filter(regexp_extract_all(lower(split_part(content, chr(10),
  1)), '[a-z]{{3,}}'),
  lambda x: x NOT IN ('and', 'or', 'not', 'near')), 1, 8)) AS terms FROM archive WHERE type = 'auto-memory'), q
  AS (SELECT asks, unnest(terms) AS term FROM a),
tk AS (SELECT path, unnest(string_split(lower(regexp_replace(content, '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')) AS
  term FROM archive), len AS (SELECT path, count(*) FILTER (term <> '') AS l FROM tk GROUP BY path), st AS (SELECT
  count(*) AS n, avg(l) AS a FROM len),
tf AS (SELECT path, term, count(*) AS tf FROM tk WHERE term IN (SELECT term FROM q) GROUP BY path, term), df AS
  (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT asks, path, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 +
  0.75 * l / a))) AS score FROM q JOIN tf USING (term) JOIN df USING (term) JOIN len USING (path), st GROUP BY
  asks,
  path),
r AS (SELECT *, row_number() OVER (PARTITION BY asks ORDER BY round(score, 6) DESC, path) AS nth FROM sc WHERE
  asks <> path), k AS (SELECT asks, r.path, row_number() OVER (PARTITION BY asks ORDER BY nth) AS rank FROM r JOIN
  archive USING (path) WHERE nth <= 7 AND type <> 'transcript')
SELECT asks AS path, rank, path AS related FROM k WHERE rank <= 5"""
)
)


@query("related_notes", RELATED)
def related_notes(s: SparkSession, d: str) -> DataFrame:
    """Every note of the tool's own memory asks, by its first line."""
    asking = vault.archive(s, d).where(F.col("type") == "auto-memory").select("path", F.substring_index("content", "\n", 1).alias("title"))
    return search.related(ranked_index(s, d), asking)


# Extraction


@query("note_documents", CTE + S.NOTES + " SELECT path, title, type, project, date, status, sha256(content) AS content_hash FROM docs")
def note_documents(s: SparkSession, d: str) -> DataFrame:
    return extract.documents(vault.notes(s, d)).select("path", "title", "type", "project", "date", "status", F.sha2("content", 256).alias("content_hash"))


@query("wikilinks", CTE + S.LINKS + " SELECT source_path, link_text, display_text, line_number FROM links")
def wikilinks(s: SparkSession, d: str) -> DataFrame:
    return extract.links(vault.notes(s, d)).select("source_path", "link_text", "display_text", "line_number")


@query("links_resolved", CTE + S.LINKS + " SELECT source_path, link_text, line_number, target_path, is_broken FROM resolved")
def links_resolved(s: SparkSession, d: str) -> DataFrame:
    return graph_tables(s, d)[2].select("source_path", "link_text", "line_number", "target_path", "is_broken")


@query("note_tasks", CTE + S.GRAPH + " SELECT doc_path, task_text, completed, line_number, section FROM tasks")
def note_tasks(s: SparkSession, d: str) -> DataFrame:
    return extract.tasks(vault.notes(s, d))


@query("note_headings", CTE + S.NOTES + ", " + S.HEADINGS + " SELECT * FROM heads")
def note_headings(s: SparkSession, d: str) -> DataFrame:
    return extract.headings(vault.notes(s, d))


@query("note_tags", CTE + S.NOTES + " SELECT doc_path, tag FROM tags")
def note_tags(s: SparkSession, d: str) -> DataFrame:
    return extract.tags(extract.documents(vault.notes(s, d)))


@query("content_hashes", CTE + S.NOTES + " SELECT path, sha256(raw) AS content_hash FROM notes")
def content_hashes(s: SparkSession, d: str) -> DataFrame:
    return index.hashes(vault.notes(s, d))


@query("header_sections", CTE + S.NOTES + r""" SELECT path, CAST(len(regexp_extract_all(raw, '(?m)^#{2,3}\s')) + 1 AS BIGINT) AS pieces FROM notes""")
def header_sections(s: SparkSession, d: str) -> DataFrame:
    return vault.notes(s, d).select("path", F.size(M.split_by_headers(F.col("raw"))).alias("pieces"))


@query(
    "open_thread_sections",
    CTE + S.NOTES + r""" SELECT path, trim(regexp_extract(raw, '(?s)## Open Threads\n(.*)$', 1), ' ' || chr(10)) AS section FROM notes""",
)
def open_thread_sections(s: SparkSession, d: str) -> DataFrame:
    return vault.notes(s, d).select("path", M.section(F.col("raw"), "Key Decisions", "Open Threads").alias("section"))


@query("without_threads", CTE + S.NOTES + r""" SELECT path, sha256(regexp_replace(regexp_replace(raw, '(?s)## Open Threads\n.*$', ''), '\n{3,}', chr(10) || chr(10),
  'g')) AS kept FROM notes""")
def without_threads(s: SparkSession, d: str) -> DataFrame:
    return vault.notes(s, d).select("path", F.sha2(M.without_section(F.col("raw"), "Open Threads"), 256).alias("kept"))


@query("note_chunks")
def note_chunks(s: SparkSession, d: str) -> DataFrame:
    return chunking.chunks(vault.notes(s, d))


@query("chunk_embeddings")
def chunk_embeddings(s: SparkSession, d: str) -> DataFrame:
    return chunking.embedded(chunking.chunks(vault.notes(s, d)), chunking.hash_embedder()).select("doc_path", "chunk_index", "content_hash", "embedding")


# Graph


@query("backlinks", CTE + S.LINKS + r""", nm AS (SELECT path, path AS link_text FROM docs UNION SELECT path, regexp_replace(regexp_extract(path, '[^/]+$'),
  '\.md$', '') FROM docs) SELECT path, count(*) AS backlinks, count(DISTINCT source_path) AS sources FROM (SELECT
  target_path AS path, source_path, link_text, line_number FROM resolved WHERE target_path IS NOT NULL UNION SELECT
  nm.path, source_path, link_text, line_number FROM resolved JOIN nm USING (link_text)) GROUP BY path""")
def backlinks(s: SparkSession, d: str) -> DataFrame:
    _, docs, resolved, _ = graph_tables(s, d)
    return graph.backlinks(resolved, docs).groupBy("path").agg(F.count("*").alias("backlinks"), F.countDistinct("source_path").alias("sources"))


@query("broken_links", CTE + S.LINKS + " SELECT source_path, link_text, line_number FROM resolved WHERE is_broken")
def broken_links(s: SparkSession, d: str) -> DataFrame:
    return graph.broken(graph_tables(s, d)[2]).select("source_path", "link_text", "line_number")


@query("open_tasks", CTE + S.GRAPH + f" SELECT doc_path, task_text, line_number, title, project, date FROM tasks LEFT JOIN docs ON "
    f"path = doc_path WHERE NOT completed AND NOT contains(doc_path, '/transcripts/') AND section = 'Open Threads' AND (date >= '{SINCE}' OR date "
    f"IS NULL)")
def open_tasks(s: SparkSession, d: str) -> DataFrame:
    _, docs, _, tasks = graph_tables(s, d)
    return graph.open_tasks(tasks, docs, SINCE).select("doc_path", "task_text", "line_number", "title", "project", "date")


@query("tag_histogram", CTE + S.NOTES + ' SELECT tag, count(*) AS "count" FROM tags GROUP BY tag')
def tag_histogram(s: SparkSession, d: str) -> DataFrame:
    return graph.tag_histogram(note_tags(s, d))


@query("alias_map", CTE + S.NOTES + " SELECT lower(alias) AS alias, max(doc_path) AS doc_path FROM aliases GROUP BY lower(alias)")
def alias_map(s: SparkSession, d: str) -> DataFrame:
    return graph.alias_map(extract.tags(extract.documents(vault.notes(s, d)), "aliases", "alias"))


@query("topic_connections", CTE + S.GRAPH + ", o AS (SELECT doc_path AS source_path, task_text FROM tasks WHERE NOT completed) SELECT target_path "
    "AS path, count(*) AS task_rows, count(DISTINCT source_path) AS sources FROM resolved JOIN o USING (source_path) WHERE target_path IS NOT NULL "
    "GROUP BY target_path")
def topic_connections(s: SparkSession, d: str) -> DataFrame:
    _, _, resolved, tasks = graph_tables(s, d)
    back = resolved.where(F.col("target_path").isNotNull()).select(F.col("target_path").alias("path"), "source_path", "link_text", "line_number")
    return graph.topic_connections(back, tasks)


@query("cross_project_links", CTE + S.LINKS + ", c AS (SELECT source_path, target_path, line_number, split_part(source_path, '/', 2) AS source_project, "
    "split_part(target_path, '/', 2) AS target_project FROM resolved WHERE target_path LIKE 'projects/%' AND source_path LIKE 'projects/%') SELECT "
    "* FROM c WHERE source_project <> target_project")
def cross_project_links(s: SparkSession, d: str) -> DataFrame:
    return graph.cross_project(graph_tables(s, d)[2])


@query("graph_stats", CTE + S.GRAPH + " SELECT * FROM (SELECT count(*) AS documents, count(DISTINCT project) AS projects, count(*) "
    "FILTER (type = 'memo') AS memos FROM docs), (SELECT count(*) AS links, count(*) FILTER (is_broken) AS broken_links, count(DISTINCT target_path) "
    "AS linked_documents FROM resolved), (SELECT count(*) AS tasks, count(*) FILTER (NOT completed) AS open_tasks, count(*) FILTER (NOT completed "
    "AND section = 'Open Threads' AND NOT contains(doc_path, '/transcripts/')) AS actionable_tasks FROM tasks), (SELECT count(DISTINCT tag) AS tags "
    "FROM tags)")
def graph_stats(s: SparkSession, d: str) -> DataFrame:
    _, docs, resolved, tasks = graph_tables(s, d)
    return graph.stats(docs, resolved, tasks, extract.tags(docs))


@query("recent_activity", CTE + S.GRAPH + f", o AS (SELECT doc_path AS path, count(*) AS open_tasks FROM tasks WHERE NOT completed GROUP "
    f"BY doc_path) SELECT path, title, type, project, date, coalesce(open_tasks, 0) AS open_tasks FROM docs LEFT JOIN o USING (path) WHERE date >= "
    f"'{WEEK}'")
def recent_activity(s: SparkSession, d: str) -> DataFrame:
    _, docs, _, tasks = graph_tables(s, d)
    return graph.recent(docs, tasks, WEEK)


@query("project_status", CTE + S.GRAPH + f""", p AS (SELECT project, count(*) FILTER (date >= '{WEEK}') AS last_week, count(*) FILTER (date >= '{SINCE}') AS
  last_month, count(*) FILTER (type = 'memo') AS memos, count(*) FILTER (type = 'transcript') AS transcripts, max(date)
  AS latest FROM docs GROUP BY project), o AS (SELECT split_part(doc_path, '/', 2) AS project, count(*) AS n FROM
  tasks WHERE doc_path LIKE 'projects/%' AND NOT completed AND section = 'Open Threads' AND NOT contains(doc_path,
  '/transcripts/') GROUP BY 1)
SELECT p.*, coalesce(n, 0) AS open_tasks, CASE WHEN last_week > 0 THEN 'active' WHEN last_month > 0 THEN 'recent'
  WHEN memos + transcripts > 0 THEN 'dormant' ELSE 'empty' END AS state FROM p LEFT JOIN o USING (project)""")
def project_status(s: SparkSession, d: str) -> DataFrame:
    _, docs, _, tasks = graph_tables(s, d)
    return graph.project_status(docs, tasks, WEEK, SINCE)


@query("project_activity", CTE + S.GRAPH + f", p AS (SELECT project, count(*) AS documents FROM docs WHERE date >= '{SINCE}' GROUP BY project), "
    f"o AS (SELECT split_part(doc_path, '/', 2) AS project, count(*) FILTER (completed) AS done, count(*) FILTER (NOT completed) AS open FROM tasks "
    f"WHERE doc_path LIKE 'projects/%' GROUP BY 1) SELECT project, documents, coalesce(done, 0) AS done, coalesce(open, 0) AS open FROM p LEFT JOIN "
    f"o USING (project)")
def project_activity(s: SparkSession, d: str) -> DataFrame:
    _, docs, _, tasks = graph_tables(s, d)
    return graph.project_activity(docs, tasks, SINCE)


@query("orphans", CTE + S.LINKS + " SELECT path FROM docs WHERE path NOT IN (SELECT target_path FROM resolved WHERE target_path IS NOT NULL)")
def orphans(s: SparkSession, d: str) -> DataFrame:
    _, docs, resolved, _ = graph_tables(s, d)
    return graph.orphans(docs, resolved)


@query("link_check", CTE + S.LINKS + " SELECT source_path, count(*) AS links, count(*) FILTER (is_broken) AS unresolved FROM resolved GROUP BY source_path")
def link_check(s: SparkSession, d: str) -> DataFrame:
    return graph.link_check(graph_tables(s, d)[2])


@query("link_density", CTE + S.LINKS + ", c AS (SELECT source_path AS path, count(*) AS links FROM links GROUP BY source_path) SELECT "
    "path, coalesce(links, 0) AS links, CASE WHEN coalesce(links, 0) < 3 THEN 'isolated' WHEN links <= 10 THEN 'typical' WHEN links > 15 THEN 'over-linked' "
    "ELSE 'dense' END AS density FROM docs LEFT JOIN c USING (path)")
def link_density(s: SparkSession, d: str) -> DataFrame:
    n = vault.notes(s, d)
    return curation.link_density(extract.documents(n), extract.links(n))


@query("file_info", CTE + S.NOTES + r""" SELECT path, CAST(length(raw) AS BIGINT) AS chars, CAST(len(regexp_extract_all(content, '\S+')) AS BIGINT) AS words,
  CAST(len(string_split(raw, chr(10))) AS BIGINT) AS lines FROM docs JOIN notes USING (path)""")
def file_info(s: SparkSession, d: str) -> DataFrame:
    raw = F.col("raw")
    return vault.notes(s, d).select(
        "path",
        F.length(raw).alias("chars"),
        F.regexp_count(M.body(raw), F.lit(r"(?U)\S+")).alias("words"),
        F.size(M.lines(raw)).alias("lines"),
    )


@query("dead_ends", CTE + S.LINKS + " SELECT path FROM docs WHERE path NOT IN (SELECT source_path FROM resolved WHERE NOT is_broken)")
def dead_ends(s: SparkSession, d: str) -> DataFrame:
    _, docs, resolved, _ = graph_tables(s, d)
    return graph.dead_ends(docs, resolved.where("not is_broken"))


@query("frontmatter_properties", CTE + S.NOTES + ", f AS (SELECT path, unnest(string_split(b, chr(10))) AS line FROM fm) SELECT trim(split_part(line, "
    "':', 1)) AS key, count(DISTINCT path) AS documents, count(DISTINCT substr(line, instr(line, ':') + 1)) AS distinct_values FROM f WHERE contains(line, "
    "':') GROUP BY 1")
def frontmatter_properties(s: SparkSession, d: str) -> DataFrame:
    f = vault.notes(s, d).select("path", F.explode(M.frontmatter(F.col("raw"))).alias("e"))
    return curation.properties(f.select("path", "e.key", "e.value"))


NEWEST = "n AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY date DESC, path) AS nth FROM docs WHERE type = 'memo')"


@query("project_context", CTE + S.NOTES + ", " + NEWEST + r" SELECT project, string_agg('- ' || title, chr(10) ORDER BY nth) FILTER (nth <= 3) AS memos, "
    r"CAST(sum(len(regexp_extract_all(content, '- \[ \] '))) AS BIGINT) AS open_threads FROM n WHERE nth <= 5 GROUP BY project")
def project_context(s: SparkSession, d: str) -> DataFrame:
    return context.standard(extract.documents(vault.notes(s, d)))


SECTION = r"regexp_extract(content, '(?s)## Open Threads\s*\n(.*)$', 1)"


@query("session_context", CTE + S.NOTES + ", " + NEWEST + rf", i AS (SELECT *, 'From ' || title || ':' || chr(10) || list_aggregate(list_transform(regexp_extract_all({SECTION}, "
    rf"'- \[ \] (.+)', 1), lambda x: '- [ ] ' || x), 'string_agg', chr(10)) AS items, '**' || title || '** (' || date || ')' AS summary FROM n WHERE "
    rf"nth <= 3) SELECT project, string_agg(items, chr(10) || chr(10) ORDER BY nth) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || string_agg(summary, "
    rf"chr(10) || chr(10) ORDER BY nth) AS context FROM i GROUP BY project")
def session_context(s: SparkSession, d: str) -> DataFrame:
    return context.full(extract.documents(vault.notes(s, d)))


@query("auto_memory_sources", CTE + S.NOTES + " SELECT path, sha256(raw) AS content_hash, CAST(len(string_split(raw, chr(10))) AS BIGINT) "
    "AS line_count, 'D' || doc_id AS title FROM notes WHERE contains(path, '/auto-memory/')")
def auto_memory_sources(s: SparkSession, d: str) -> DataFrame:
    return sync.sources(vault.notes(s, d).where(F.col("path").contains("/auto-memory/")))


@query("projects_without_memory", CTE + S.ARCHIVE + f" SELECT DISTINCT project FROM archive WHERE type = 'transcript' AND project NOT IN (SELECT "
    f"project FROM archive WHERE type = 'auto-memory' AND date >= '{WEEK}')")
def projects_without_memory(s: SparkSession, d: str) -> DataFrame:
    a = vault.archive(s, d)
    return sync.without_memory(a.where("type = 'transcript'"), a.where((F.col("type") == "auto-memory") & (F.col("date") >= WEEK)))


# Curation

TIER = "CASE WHEN refs >= 5 THEN 'OVERDUE' WHEN refs >= 3 AND projects >= 2 THEN 'READY' WHEN refs >= 2 THEN 'MATURING' ELSE 'SEEDLING' END"
NOISE = ", ".join(f"'{x}'" for x in curation.NOISE)
PAGES = (
    rf"""a AS (SELECT url, unnest(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 2)) AS t FROM pages),
  u AS (SELECT DISTINCT trim(t) AS link, url, coalesce(nullif(regexp_extract(url, '^https?://[^/]+/([^/]+)', 1),
  ''), '_vault') AS project FROM a),
refs AS (SELECT link, count(DISTINCT url) AS refs, count(DISTINCT CASE WHEN project NOT LIKE '\_%' ESCAPE '\' THEN
  project END) AS projects FROM u WHERE lower(link) NOT IN ({NOISE}) AND NOT regexp_matches(link, '^\?|/|^\d{{8}}|^https?://|^\d+$')
  GROUP BY link)"""
)


@query("crystallization_tiers", CTE + PAGES + f" SELECT link, refs, projects, {TIER} AS tier FROM refs")
def crystallization_tiers(s: SparkSession, d: str) -> DataFrame:
    r = curation.link_refs(vault.page_links(s, d))
    return r.withColumn("tier", curation.tier(F.col("refs"), F.col("projects")))


@query("crystallization_delta", CTE + PAGES + ", n AS (SELECT link, refs FROM refs WHERE length(link) % 5 <> 0), b AS (SELECT link, refs "
    "- length(link) % 2 AS refs FROM refs WHERE length(link) % 5 <> 1) SELECT * FROM (SELECT coalesce(n.link, b.link) AS link, n.refs AS refs_now, "
    "b.refs AS refs_before, CASE WHEN b.refs IS NULL THEN 'new' WHEN n.refs IS NULL THEN 'resolved' WHEN n.refs > b.refs THEN 'grown' END AS change "
    "FROM n FULL OUTER JOIN b ON n.link = b.link) WHERE change IS NOT NULL")
def crystallization_delta(s: SparkSession, d: str) -> DataFrame:
    r = curation.link_refs(vault.page_links(s, d)).select("link", "refs")
    n = F.length("link")
    return curation.delta(r.where(n % 5 != 0), r.where(n % 5 != 1).withColumn("refs", F.col("refs") - n % 2))


@query("unresolved_concepts", CTE + S.LINKS + f", u AS (SELECT DISTINCT link_text AS link, source_path, CASE WHEN source_path LIKE 'projects/%' "
    f"THEN split_part(source_path, '/', 2) ELSE '_topics' END AS project FROM resolved WHERE is_broken AND NOT contains(link_text, '/')), refs AS "
    f"(SELECT link, count(DISTINCT source_path) AS refs, count(DISTINCT CASE WHEN project <> '_topics' THEN project END) AS projects FROM u GROUP "
    f"BY link) SELECT link, refs, projects, {TIER} AS tier FROM refs")
def unresolved_concepts(s: SparkSession, d: str) -> DataFrame:
    b = graph.broken(graph_tables(s, d)[2]).withColumn("project", F.coalesce(graph.project_of(F.col("source_path")), F.lit("_topics")))
    return curation.link_refs(b).withColumn("tier", curation.tier(F.col("refs"), F.col("projects")))


@query("index_plan", CTE + S.NOTES + ", h AS (SELECT doc_id, path, sha256(raw) AS a FROM notes), n AS (SELECT * FROM h WHERE doc_id "
    "% 13 <> 0), b AS (SELECT path, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE a END AS b FROM h WHERE doc_id % 13 <> 1) SELECT coalesce(n.path, b.path) "
    "AS path, CASE WHEN b.b IS NULL THEN 'new' WHEN n.a IS NULL THEN 'deleted' WHEN a <> b THEN 'updated' ELSE 'unchanged' END AS action FROM n FULL "
    "OUTER JOIN b ON n.path = b.path")
def index_plan(s: SparkSession, d: str) -> DataFrame:
    n = vault.notes(s, d)
    i = F.col("doc_id")
    h = n.select("doc_id", "path", F.sha2("raw", 256).alias("content_hash"))
    before = h.where(i % 13 != 1).withColumn("content_hash", F.when(i % 5 == 0, "old").otherwise(F.col("content_hash")))
    return curation.hash_plan(h.where(i % 13 != 0), before)


@query("condensation", CTE + S.ARCHIVE + ", o AS (SELECT project, min(date) AS condensed FROM archive WHERE type = 'auto-memory' GROUP "
    "BY project) SELECT project, count(*) FILTER (condensed IS NULL OR date > condensed) AS undigested, count(*) FILTER (condensed IS NULL OR date "
    "> condensed) >= 5 AS condense FROM archive LEFT JOIN o USING (project) WHERE type = 'memo' GROUP BY project")
def condensation(s: SparkSession, d: str) -> DataFrame:
    a = vault.archive(s, d)
    return curation.staleness(a, a.where("type = 'auto-memory'").groupBy("project").agg(F.min("date").alias("condensed")))


@query("stale_topics", CTE + S.LINKS + f", r AS (SELECT target_path AS path, max(date) AS latest FROM resolved JOIN docs ON docs.path "
    f"= source_path WHERE target_path IS NOT NULL GROUP BY target_path) SELECT path, latest FROM docs LEFT JOIN r USING (path) WHERE type = 'concept' "
    f"AND (latest IS NULL OR latest < '{SINCE}')")
def stale_topics(s: SparkSession, d: str) -> DataFrame:
    _, docs, resolved, _ = graph_tables(s, d)
    return curation.stale_topics(resolved, docs, SINCE)


@query("missing_memos", CTE + S.ARCHIVE + ", t AS (SELECT path, left(md5(CAST(doc_id // 10 AS VARCHAR)), 8) AS suffix FROM archive WHERE type = 'transcript') "
    "SELECT path, suffix FROM t WHERE suffix IN (SELECT left(md5(CAST(doc_id // 10 * 2 AS VARCHAR)), 8) FROM archive WHERE type = 'memo')")
def missing_memos(s: SparkSession, d: str) -> DataFrame:
    """The session of a transcript is its block of ten documents; the memos of a block are of the session of twice its number."""
    a = vault.archive(s, d)
    block = F.floor(F.col("doc_id") / 10)
    suffix = lambda c: F.left(F.md5(c.cast("string").cast("binary")), F.lit(8)).alias("suffix")
    t = a.where("type = 'transcript'").select("path", suffix(block))
    return curation.missing_memos(t, a.where("type = 'memo'").select(suffix(block * 2))).select("path", "suffix")


@query("cartography", CTE + S.LINKS + ", b AS (SELECT target_path AS path, count(DISTINCT source_path) AS n FROM resolved WHERE target_path "
    "IS NOT NULL GROUP BY target_path), l AS (SELECT path, CAST(len(string_split(raw, chr(10))) AS BIGINT) AS lines FROM notes) SELECT path, coalesce(n, "
    "0) AS backlinks, lines, CASE WHEN lines >= 200 THEN 'mature' WHEN lines >= 50 THEN 'growing' ELSE 'stub' END AS maturity FROM l LEFT JOIN b "
    "USING (path)")
def cartography(s: SparkSession, d: str) -> DataFrame:
    n, docs, resolved, _ = graph_tables(s, d)
    return curation.cartography(docs, resolved, n.select("path", F.size(M.lines(F.col("raw"))).alias("lines")))


TAGGED_SQL = "g AS (SELECT DISTINCT project, tag AS topic FROM tags JOIN docs ON path = doc_path)"


def tagged(s: SparkSession, d: str) -> DataFrame:
    return extract.documents(vault.notes(s, d)).select("path", "project", "type", "date", F.explode("tags").alias("topic"))


@query("project_adjacency", CTE + S.NOTES + ", " + TAGGED_SQL + " SELECT a.project AS project_a, b.project AS project_b, count(*) AS shared FROM g a JOIN g "
    "b USING (topic) WHERE a.project < b.project GROUP BY 1, 2")
def project_adjacency(s: SparkSession, d: str) -> DataFrame:
    return curation.adjacency(tagged(s, d).select("project", "topic"))


@query("memos_by_topic", CTE + S.NOTES + " SELECT tag AS topic, count(*) AS memos FROM tags JOIN docs ON path = doc_path WHERE type "
    "= 'memo' GROUP BY tag HAVING count(*) >= 2")
def memos_by_topic(s: SparkSession, d: str) -> DataFrame:
    return curation.memos_by_topic(tagged(s, d).where("type = 'memo'").select("path", "topic"))


@query("themes_without_topic", CTE + S.NOTES + ", " + TAGGED_SQL + f", k AS (SELECT string_split(tags, ', ')[1] AS topic FROM docs WHERE type = 'concept' AND date "
    f">= '{WEEK}') SELECT topic, count(DISTINCT project) AS projects FROM g WHERE topic NOT IN (SELECT topic FROM k) GROUP BY topic HAVING count(DISTINCT "
    f"project) >= 2")
def themes_without_topic(s: SparkSession, d: str) -> DataFrame:
    known = extract.documents(vault.notes(s, d)).where((F.col("type") == "concept") & (F.col("date") >= WEEK)).select(F.col("tags")[0].alias("topic"))
    return curation.themes_without_topic(tagged(s, d).select("project", "topic"), known)


@query("suggested_concepts", CTE + "a AS (SELECT url, unnest(regexp_extract_all(html, '<a\\s[^>]*href=\"([^\"]*)\"[^>]*>([^<]*)</a>', "
    "2)) AS t FROM pages) SELECT trim(t) AS concept, count(*) AS mentions, count(DISTINCT url) AS notes FROM a GROUP BY trim(t)")
def suggested_concepts(s: SparkSession, d: str) -> DataFrame:
    return curation.suggested(vault.page_links(s, d).withColumn("link_text", F.concat(F.lit("?"), "link_text")))


@query("note_sizes", CTE + S.NOTES + ", z AS (SELECT strlen(raw) AS bytes FROM notes) SELECT CASE WHEN bytes < 1000 THEN 'tiny' "
    "WHEN bytes < 10000 THEN 'small' WHEN bytes < 1000000 THEN 'medium' WHEN bytes < 10000000 THEN 'large' ELSE 'huge' END AS size_class, count(*) "
    "AS files, round(avg(bytes), 6) AS mean_bytes FROM z GROUP BY 1")
def note_sizes(s: SparkSession, d: str) -> DataFrame:
    return curation.by_size(vault.notes(s, d).select(F.octet_length("raw").alias("bytes")))


@query("orphaned_sessions", "WITH p AS (SELECT 's' || user_id || '-' || strftime(ts, '%Y-%m-%d') AS session_id, max(ts) "
    "FILTER (event_type = 'error') AS archived, count(*) FILTER (event_type = 'purchase') AS completed FROM events GROUP BY 1) SELECT session_id, "
    "strftime(archived, '%Y-%m-%d %H:%M:%S') AS archived FROM p WHERE completed = 0 AND archived < (SELECT max(ts) FROM events) - INTERVAL 24 HOURS")
def orphaned_sessions(s: SparkSession, d: str) -> DataFrame:
    e = vault.session_events(s, d)
    phase = F.when(F.col("kind") == "error", "archived").when(F.col("kind") == "purchase", "completed")
    p = e.select(F.concat("session_id", F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("session_id"), phase.alias("phase"), F.col("ts").alias("at"))
    now = F.broadcast(e.agg(F.max("ts").alias("now")))  # one row
    return curation.orphaned_sessions(p.crossJoin(now)).select("session_id", F.date_format("archived", "yyyy-MM-dd HH:mm:ss").alias("archived"))


# Conversations

MSG = (
    """msg AS (SELECT conv_id AS session, turn AS seq, role, text, make_timestamp((1704067200 + conv_id * 3600 + turn *
  100) * 1000000) AS ts FROM conversations),
kept AS (SELECT * FROM msg WHERE role <> 'system' AND coalesce(text, '') <> ''), turned AS (SELECT *, greatest(1,
  sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq)) AS turn FROM kept)"""
)


@query("conversation_turns", CTE + MSG + " SELECT session, CAST(turn AS BIGINT) AS turn, count(*) AS messages, count(*) FILTER (role "
    "= 'assistant') AS responses, CAST(sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END) AS BIGINT) AS user_chars, CAST(sum(CASE WHEN role "
    "= 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS reply_chars, arg_min(text, seq) FILTER (role = 'user') AS prompt FROM turned GROUP "
    "BY session, turn")
def conversation_turns(s: SparkSession, d: str) -> DataFrame:
    turned = transcripts.turns(vault.messages(s, d))
    prompts = transcripts.turn_table(turned).drop("prompt")
    first = turned.where("role = 'user'").groupBy("session", "turn").agg(F.min_by("text", "seq").alias("prompt"))
    return prompts.join(first, ["session", "turn"], "left")


@query("conversation_sessions", CTE + MSG + " SELECT session, count(*) AS messages, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), "
    "'%Y-%m-%d %H:%M:%S') AS last, CASE WHEN count(*) > 1 THEN greatest(1, CAST(floor(epoch(max(ts) - min(ts)) / 60) AS BIGINT)) END AS minutes FROM "
    "msg GROUP BY session")
def conversation_sessions(s: SparkSession, d: str) -> DataFrame:
    at = lambda c: F.date_format(
        F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col(c).cast("timestamp_ntz")),
        "yyyy-MM-dd HH:mm:ss",
    ).alias(c)
    return transcripts.sessions(vault.messages(s, d)).select("session", "messages", at("first"), at("last"), "minutes")


@query("message_dedupe", CTE + MSG + ", k AS (SELECT session, min(seq) AS seq, role, CAST(seq // 2 AS BIGINT) AS slot, max(length(text)) "
    "AS chars FROM msg GROUP BY session, role, seq // 2) SELECT session, seq, role, slot, chars FROM k")
def message_dedupe(s: SparkSession, d: str) -> DataFrame:
    m = vault.messages(s, d).withColumn("slot", F.floor(F.col("seq") / 2))
    return transcripts.deduplicated(m, ["session", "role", "slot"]).select("session", "seq", "role", "slot", F.length("text").alias("chars"))


TAGGED = "text"
for _tag in transcripts.TAGS:
    TAGGED = f"regexp_replace({TAGGED}, '(?s)<{_tag}>.*?</{_tag}>', '', 'g')"
RENDERED = (
    (
    MSG
    + rf""", cl AS (SELECT *, trim(regexp_replace({TAGGED}, '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS c FROM
  turned),
ct AS (SELECT *, CASE WHEN length(c) > 5000 THEN left(c, 3500) || chr(10) || '... [truncated] ...' || chr(10) ||
  right(c, 1250) ELSE c END AS t FROM cl),
rd AS (SELECT session, CAST(turn AS BIGINT) AS turn, seq, CASE WHEN seq = min(seq) OVER (PARTITION BY session,
  turn)
  THEN '## Turn ' || CAST(turn AS BIGINT) || chr(10) || chr(10) ELSE '' END || CASE WHEN role = 'user' THEN '**User:** '
  ELSE '**Assistant:** ' END || t AS markdown
  FROM ct)"""
)
)


@query("rendered_sessions", CTE + RENDERED + " SELECT session, turn, seq, markdown FROM rd")
def rendered_sessions(s: SparkSession, d: str) -> DataFrame:
    return transcripts.rendered(transcripts.turns(vault.messages(s, d)))


NOTE = """, ss AS (SELECT session, count(*) AS n, CAST(max(turn) AS BIGINT) AS turns, strftime(min(ts), '%Y-%m-%d') AS day,
  CASE WHEN count(*) > 1 THEN greatest(1, CAST(floor(epoch(max(ts) - min(ts)) / 60) AS BIGINT)) END AS minutes FROM turned GROUP BY session)
SELECT session, CAST(0 AS BIGINT) AS part, concat_ws(chr(10), '---', 'type: transcript', 'session_id: ' || session, 'date: ' || day, 'turns: ' || turns,
  'total_messages: ' || n, 'duration_minutes: ' || minutes, '---') || chr(10) AS raw FROM ss
UNION ALL SELECT session, row_number() OVER (PARTITION BY session ORDER BY seq) AS part, chr(10) || markdown || chr(10) AS raw FROM rd"""


@query("session_notes", CTE + RENDERED + NOTE)
def session_notes(s: SparkSession, d: str) -> DataFrame:
    return transcripts.notes(transcripts.turns(vault.messages(s, d)))


@query("message_signals", CTE + MSG + r""" SELECT session, count(*) FILTER (role = 'user') AS users, count(*) FILTER (role = 'assistant') AS assistants, CAST(floor(epoch(max(ts)
  - min(ts)) / 60) AS BIGINT) AS minutes, coalesce(translate(left(trim(regexp_replace(arg_min(text, seq) FILTER
  (role = 'user'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)), 150), chr(10), ' '), '') AS first_message
  FROM msg GROUP BY session""")
def message_signals(s: SparkSession, d: str) -> DataFrame:
    m = vault.messages(s, d)
    at = F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("ts").cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = F.to_json(F.struct(F.col("role").alias("type"), at.alias("timestamp"), F.struct(F.col("text").alias("content")).alias("message")))
    return transcripts.signals(m.select("session", "seq", line.alias("value")), "session").select("session", "users", "assistants", "minutes", "first_message")


@query("viable_sessions", "SELECT conv_id AS session_id, count(*) AS lines, count(*) FILTER (contains(text, 'tool_use')) "
    "AS tools FROM conversations GROUP BY conv_id HAVING count(*) >= 6 OR count(*) FILTER (contains(text, 'tool_use')) > 0")
def viable_sessions(s: SparkSession, d: str) -> DataFrame:
    return hooks.viable(vault.messages(s, d).select(F.col("session").alias("session_id"), "text"))


SIGNALS = (
    """sg AS (SELECT 's' || user_id AS session_id, count(*) FILTER (event_type = 'purchase') AS writes, count(*) FILTER
  (event_type = 'signup') AS commits, count(*) FILTER (event_type = 'click') AS bash, count(*) FILTER (event_type
  = 'view') AS users, count(*) FILTER (event_type = 'error') AS errors, epoch(max(ts) - min(ts)) / 60 AS minutes
  FROM events GROUP BY user_id),
sc AS (SELECT session_id, CAST(greatest(0, least(writes * 3, 15) + least(commits * 5, 15) + least(bash, 5) + least(users,
  10) + CASE WHEN minutes >= 60 THEN 8 WHEN minutes >= 30 THEN 5 WHEN minutes >= 10 THEN 3 WHEN minutes >= 5 THEN
  1 ELSE 0 END - least(errors, 3)) AS BIGINT) AS score FROM sg), g AS (SELECT *, CASE WHEN score >= 16 THEN 'high'
  WHEN score >= 9 THEN 'moderate' WHEN score >= 4 THEN 'low' ELSE 'skip' END AS grade FROM sc)"""
)


@query("triage_scores", CTE + SIGNALS + " SELECT session_id, score, grade FROM g")
def triage_scores(s: SparkSession, d: str) -> DataFrame:
    e = vault.session_events(s, d)
    of = lambda k: F.count_if(F.col("kind") == k)
    g = e.groupBy("session_id").agg(
        of("purchase").alias("writes"),
        of("signup").alias("commits"),
        of("click").alias("bash"),
        of("view").alias("users"),
        of("error").alias("errors"),
        (F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")) / 60_000_000).alias("minutes"),
    )
    zero = F.lit(0)
    score = curation.triage_score(
        F.col("writes"),
        F.col("commits"),
        F.col("bash"),
        F.col("users"),
        zero,
        zero,
        F.col("minutes"),
        F.lit(False),
        F.lit(False),
        F.col("errors"),
    )
    return g.select("session_id", score.cast("long").alias("score")).withColumn("grade", curation.grade(F.col("score")))


@query("triage_histogram", CTE + SIGNALS + " SELECT grade, count(*) AS sessions FROM g GROUP BY grade")
def triage_histogram(s: SparkSession, d: str) -> DataFrame:
    return triage_scores(s, d).groupBy("grade").agg(F.count("*").alias("sessions"))


@query("import_plan", CTE + SIGNALS + ", l AS (SELECT 's' || user_id AS session_id, arg_max(event_type, event_id) AS last FROM events GROUP BY user_id), "
    "k AS (SELECT g.* FROM g JOIN l USING (session_id) WHERE last <> 'purchase') SELECT session_id, score, grade, CASE WHEN grade = 'skip' THEN 'skipped' "
    "ELSE 'would_import' END AS action FROM k")
def import_plan(s: SparkSession, d: str) -> DataFrame:
    """Sessions whose last event is a purchase count as archived."""
    t = triage_scores(s, d)
    last = vault.session_events(s, d).groupBy("session_id").agg(F.max_by("kind", "event_id").alias("last"))
    archived = last.where("last = 'purchase'").select("session_id")
    return curation.unarchived(t, archived).withColumn("action", F.when(F.col("grade") == "skip", "skipped").otherwise("would_import"))


@query("nudges", CTE + "e AS (SELECT 's' || user_id AS session_id, count(*) OVER w AS n, max(CASE WHEN event_type "
    "= 'purchase' THEN 1 ELSE 0 END) OVER w AS saved FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT session_id, n AS "
    "\"count\" FROM e WHERE saved = 0 AND n >= 5 AND (n - 5) % 3 = 0")
def nudges(s: SparkSession, d: str) -> DataFrame:
    return hooks.nudges_batch(vault.session_events(s, d), 5, 3, "ts", "event_id")


@query("phases_once", "SELECT 's' || user_id AS session_id, event_type AS phase, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def phases_once(s: SparkSession, d: str) -> DataFrame:
    e = vault.session_events(s, d).withColumnRenamed("kind", "phase")
    return hooks.phases_first(e, "ts", "event_id").select("session_id", "phase", "event_id")


#: Jobs of a stored queue: a session's day with errors, done if it also has a purchase.
JOBS_SQL = """WITH e AS (SELECT 's' || user_id || '/' || strftime(ts, '%Y-%m-%d') AS path, ts, event_type FROM events),
q AS (SELECT path, min(ts) AS since FROM e WHERE event_type = 'error' AND path NOT IN (SELECT path FROM e WHERE event_type = 'purchase') GROUP BY 1)"""


def queue_jobs(s: SparkSession, d: str) -> tuple[str, DataFrame]:
    """The folder of a queue to which the jobs were appended, and the jobs that are done."""
    day = F.concat("session_id", F.lit("/"), F.date_format("ts", "yyyy-MM-dd"))
    e = vault.session_events(s, d).select(day.alias("path"), F.col("ts").alias("enqueued_at"), "kind")
    root = store.fresh(s, "queue")
    hooks.enqueued(e.where("kind = 'error'").drop("kind"), root)
    return root, e.where("kind = 'purchase'").select("path").distinct()


@query("queue_drain", JOBS_SQL + " SELECT path, strftime(since, '%Y-%m-%d %H:%M:%S') AS enqueued_at FROM q ORDER BY since, path LIMIT 10")
def queue_drain(s: SparkSession, d: str) -> DataFrame:
    """The oldest ten jobs, taken from the stored queue."""
    root, done = queue_jobs(s, d)
    return hooks.taken(s, root, done, 10).select("path", F.date_format("enqueued_at", "yyyy-MM-dd HH:mm:ss").alias("enqueued_at"))


@query("activity_windows", "SELECT event_type AS kind, strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, count(*) "
    "AS events, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def activity_windows(s: SparkSession, d: str) -> DataFrame:
    e = vault.session_events(s, d)
    return e.groupBy(
        "kind",
        F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd").alias("day"),
    ).agg(F.count("*").alias("events"), F.countDistinct("session_id").alias("users"))


# Further queries register themselves.
from lorekeep.plans import logs, upkeep  # noqa: E402, F401
