"""SQL of the derived tables, from which each query's own SQL is put together; written for DuckDB, apart from the Spark code."""

ARCHIVE = (
    """archive AS (SELECT doc_id,
  CASE WHEN doc_id % 10 = 8 THEN 'topics/d' || doc_id || '.md' ELSE 'projects/' || source || '/' || CASE WHEN doc_id
  % 10 < 6 THEN 'memos' WHEN doc_id % 10 < 8 THEN 'transcripts' ELSE 'auto-memory' END || '/d' || doc_id || '.md'
  END AS path,
  'doc-' || doc_id AS title, coalesce(text, '') AS content,
  CASE WHEN doc_id % 10 < 6 THEN 'memo' WHEN doc_id % 10 < 8 THEN 'transcript' WHEN doc_id % 10 = 8 THEN 'concept'
  ELSE 'auto-memory' END AS type,
  source AS project, strftime(DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER), '%Y-%m-%d') AS date FROM documents)"""
)
NOTES = (
    (
    ARCHIVE
    + r""", notes AS (SELECT doc_id, path, '---' || chr(10) || 'type: ' || type || chr(10) || 'title: "' || title || '"' ||
  chr(10) || 'project: ' || project || chr(10) || 'date: ' || date || chr(10)
  || 'status: ' || CASE WHEN doc_id % 17 = 0 THEN 'archived' ELSE 'active' END || chr(10) || 'tags: [t' || (doc_id
  % 7) || ', u' || (doc_id % 11) || ']' || chr(10) || 'aliases: [doc-' || doc_id || ']' || chr(10) || '---' || chr(10)
  || '## Summary' || chr(10) || content || chr(10) || 'See [[doc-' || ((doc_id * 7 + 3) % (n * 12 // 10)) || ']] and [[projects/'
  || project || '/memos/d' || ((doc_id * 3) % n) || '|other]].' || chr(10)
  || CASE WHEN doc_id % 4 = 0 THEN 'About [[topic-' || (doc_id % 37) || ']].' || chr(10) ELSE '' END || CASE WHEN
  doc_id % 5 = 0 THEN '- [ ] early ' || doc_id || chr(10) ELSE '' END
  || '## Open Threads' || chr(10) || '- [ ] follow up ' || doc_id || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '- [x] closed '
  || doc_id || chr(10) ELSE '' END AS raw
  FROM archive, (SELECT count(*) AS n FROM documents)),
fm AS (SELECT path, raw, regexp_extract(raw, '(?s)^---(.*?)---', 1) AS b FROM notes),
docs AS (SELECT path, regexp_extract(b, '(?m)^title: "(.*)"$', 1) AS title, regexp_extract(b, '(?m)^type: (.*)$',
  1) AS type, regexp_extract(b, '(?m)^project: (.*)$', 1) AS project,
  regexp_extract(b, '(?m)^date: (.*)$', 1) AS date, regexp_extract(b, '(?m)^status: (.*)$', 1) AS status, regexp_extract(b,
  '(?m)^tags: \[(.*)\]$', 1) AS tags, regexp_extract(b, '(?m)^aliases: \[(.*)\]$', 1) AS aliases,
  trim(regexp_replace(raw, '(?s)^---.*?---', ''), ' ' || chr(10) || chr(13) || chr(9)) AS content FROM fm),
tags AS (SELECT DISTINCT path AS doc_path, unnest(string_split(tags, ', ')) AS tag FROM docs),
aliases AS (SELECT DISTINCT path AS doc_path, unnest(string_split(aliases, ', ')) AS alias FROM docs),
lines AS (SELECT path, unnest(string_split(raw, chr(10))) AS line, generate_subscripts(string_split(raw, chr(10)),
  1) AS line_number FROM notes)"""
)
)
LINKS = (
    (
    NOTES
    + r""", found AS (SELECT path AS source_path, line_number, unnest(regexp_extract_all(line, '\[\[([^\]|]+)(?:\|([^\]]+))?\]\]',
  1)) AS a, unnest(regexp_extract_all(line, '\[\[([^\]|]+)(?:\|([^\]]+))?\]\]', 2)) AS b FROM lines WHERE contains(line,
  '[[')),
links AS (SELECT source_path, trim(a) AS link_text, min(nullif(trim(b), '')) AS display_text, line_number FROM
  found GROUP BY source_path, trim(a), line_number),
tgt AS (SELECT DISTINCT link_text, regexp_replace(trim(split_part(link_text, '#', 1)), '\.md$', '') AS t FROM links),
cand AS (SELECT link_text, 0 AS rank, path FROM tgt JOIN docs ON path = t || '.md' UNION ALL SELECT link_text,
  1, path FROM tgt JOIN docs ON path = 'topics/' || t || '.md'
  UNION ALL SELECT link_text, 2, path FROM tgt JOIN docs ON path = CASE WHEN contains(t, '/') THEN t ELSE 'projects/'
  || t END || '/_project.md' UNION ALL SELECT link_text, 3, doc_path FROM tgt JOIN aliases ON alias = t),
best AS (SELECT link_text, path AS target_path FROM (SELECT *, row_number() OVER (PARTITION BY link_text ORDER
  BY rank, path) AS nth FROM cand) WHERE nth = 1),
resolved AS (SELECT l.*, target_path, target_path IS NULL AS is_broken FROM links l LEFT JOIN best USING (link_text))"""
)
)
HEADINGS = (
    r"""heads AS (SELECT path AS doc_path, trim(regexp_extract(line, '^(#{1,6})\s+(.+)$', 2)) AS heading, CAST(length(regexp_extract(line,
  '^(#{1,6})\s+(.+)$', 1)) AS BIGINT) AS level, line_number FROM lines WHERE regexp_matches(line, '^(#{1,6})\s+(.+)$'))"""
)
TASKS = (
    r"""marked AS (SELECT *, last_value(CASE WHEN regexp_matches(line, '^(#{1,6})\s+(.+)$') THEN trim(regexp_extract(line,
  '^(#{1,6})\s+(.+)$', 2)) END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_number) AS section FROM lines),
tasks AS (SELECT path AS doc_path, trim(regexp_extract(line, '^(\s*)-\s*\[([ xX])\]\s*(.+)$', 3)) AS task_text,
  lower(regexp_extract(line, '^(\s*)-\s*\[([ xX])\]\s*(.+)$', 2)) = 'x' AS completed, line_number, section FROM
  marked WHERE regexp_matches(line, '^(\s*)-\s*\[([ xX])\]\s*(.+)$'))"""
)
GRAPH = LINKS + ", " + HEADINGS + ", " + TASKS


def words(terms: list[str], where: str = "TRUE") -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return (
        ARCHIVE
        + rf""", tk AS (SELECT path, unnest(string_split(lower(regexp_replace(content, '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '))
  AS term FROM archive WHERE {where}),
len AS (SELECT path, count(*) FILTER (term <> '') AS l FROM tk GROUP BY path), st AS (SELECT count(*) AS n, avg(l)
  AS a FROM len),
tf AS (SELECT path, term, count(*) AS tf FROM tk WHERE term IN ({listed}) GROUP BY path, term), df AS (SELECT term,
  count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT path, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 *
  l / a))) AS score FROM tf JOIN df USING (term) JOIN len USING (path), st GROUP BY path)"""
    )


def vectors(k: int, metric: str = "l2") -> str:
    dist = "list_distance(v.e, q.e)" if metric == "l2" else "1 - list_cosine_similarity(v.e, q.e)"
    return f"""vec AS (SELECT vec_id, path, CAST(embedding AS DOUBLE[]) AS e FROM embeddings JOIN archive
  ON archive.doc_id = vec_id // 3 * 31 % (SELECT count(*) FROM documents)),
near AS (SELECT v.vec_id, v.path, {dist} AS distance FROM vec v, (SELECT CAST(embedding AS DOUBLE[]) AS e FROM
  embeddings WHERE vec_id = 0) q ORDER BY round({dist}, 9), v.vec_id LIMIT {k}),
chunk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY round(distance, 9), vec_id) AS
  nth FROM near) WHERE nth = 1)"""
