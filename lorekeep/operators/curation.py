"""Curation: maturity of unresolved links, snapshots, sync plans, staleness, triage."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Link texts that are templates, and patterns of links that aren't concepts.
NOISE = (
    "topic-name-kebab-case", "another-topic", "existing-topic", "suggested-new-concept", "new-concept", "project-name", "detected-project",
    "detected project", "related-concept", "topic", "topic1", "topic2", "topic-name", "iso date", "decision", "title", "link", "session-summary",
)
NOISE_PATTERN = r"^\?|/|^\d{8}|^https?://|^\d+$"


def noise(text: Column) -> Column:
    return F.lower(text).isin(*NOISE) | text.rlike(NOISE_PATTERN)


def link_refs(unresolved: DataFrame, link: str = "link_text", source: str = "source_path", project: str = "project") -> DataFrame:
    """refs (distinct sources) and projects (distinct, those that begin with _ not counted) of each link that isn't noise."""
    u = unresolved.where(~noise(F.col(link))).select(F.col(link).alias("link"), F.col(source).alias("file"), F.col(project).alias("project")).distinct()
    real = F.when(~F.col("project").startswith("_"), F.col("project"))
    return u.groupBy("link").agg(F.countDistinct("file").alias("refs"), F.countDistinct(real).alias("projects"))


def tier(refs: Column, projects: Column) -> Column:
    return F.when(refs >= 5, "OVERDUE").when((refs >= 3) & (projects >= 2), "READY").when(refs >= 2, "MATURING").otherwise("SEEDLING")


#: Tiers in the order of a report.
TIERS = ("OVERDUE", "READY", "MATURING", "SEEDLING")


def ranked(tiers: DataFrame, most: int | None = None) -> DataFrame:
    """Links (link, refs, tier) as a report lists them: by tier, then most references, then text."""
    listed = tiers.orderBy(F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier")), F.col("refs").desc(), "link")
    return listed.limit(most) if most else listed


def known_suffixes(*sources: DataFrame) -> DataFrame:
    """Distinct session suffixes (suffix) of several sources."""
    return functools.reduce(DataFrame.unionByName, [s.select("suffix") for s in sources]).where(F.col("suffix").isNotNull()).distinct()


def without_aliases(refs: DataFrame, aliases: DataFrame) -> DataFrame:
    return refs.join(aliases.select(F.lower("alias").alias("a")).distinct(), F.lower("link") == F.col("a"), "left_anti")


def delta(now: DataFrame, before: DataFrame) -> DataFrame:
    """new, resolved and grown links between two snapshots (link, refs)."""
    j = now.select("link", F.col("refs").alias("refs_now")).join(before.select("link", F.col("refs").alias("refs_before")), "link", "full_outer")
    change = F.when(F.col("refs_before").isNull(), "new").when(F.col("refs_now").isNull(), "resolved").when(F.col("refs_now") > F.col("refs_before"), "grown")
    return j.withColumn("change", change).where(F.col("change").isNotNull())


def hash_plan(now: DataFrame, before: DataFrame, key: str = "path") -> DataFrame:
    """new, updated, unchanged and deleted rows by content hash; both sides: key, content_hash."""
    j = now.select(key, F.col("content_hash").alias("a")).join(before.select(key, F.col("content_hash").alias("b")), key, "full_outer")
    return j.select(
        key,
        F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "deleted").when(F.col("a") != F.col("b"), "updated").otherwise("unchanged").alias("action"),
    )


def staleness(docs: DataFrame, overviews: DataFrame, least: int = 5) -> DataFrame:
    """Memos that are newer than their project's overview (project, condensed), and whether there are enough to condense."""
    m = docs.where("type = 'memo'").select("project", "date")
    newer = F.count_if(F.col("condensed").isNull() | (F.col("date") > F.col("condensed")))
    return m.join(overviews, "project", "left").groupBy("project").agg(newer.alias("undigested")).withColumn("condense", F.col("undigested") >= least)


def stale_topics(resolved: DataFrame, docs: DataFrame, before: str) -> DataFrame:
    """Concept notes whose latest reference is older than `before`, or that have none."""
    r = resolved.where(F.col("target_path").isNotNull()).join(
        docs.select(F.col("path").alias("source_path"), "date"),
        "source_path",
    ).groupBy(F.col("target_path").alias("path")).agg(F.max("date").alias("latest"))
    return docs.where("type = 'concept'").select("path").join(r, "path", "left").where(F.col("latest").isNull() | (F.col("latest") < before))


def link_density(docs: DataFrame, links: DataFrame) -> DataFrame:
    n = links.groupBy(F.col("source_path").alias("path")).agg(F.count("*").alias("links"))
    c = F.coalesce("links", F.lit(0))
    return docs.select("path").join(n, "path", "left").select(
        "path",
        c.alias("links"),
        F.when(c < 3, "isolated").when(c <= 10, "typical").when(c > 15, "over-linked").otherwise("dense").alias("density"),
    )


def archived_ids(paths: DataFrame) -> DataFrame:
    """session_id: what the names of archived transcripts (path) tell of their sessions: the whole stem, and what follows its date and time or else its first eight characters."""
    kept = paths.where(F.col("path").rlike(r"^projects/[^/]+/transcripts/[^/]+\.(?:md|jsonl)$"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.(?:md|jsonl)$", "")
    dated = F.regexp_extract(stem, r"^\d{8}-\d{6}-(.*)$", 1)
    part = F.when(stem.rlike(r"^\d{8}-\d{6}-"), F.nullif(dated, F.lit(""))).otherwise(F.left(stem, F.lit(8)))
    return kept.select(F.explode(F.array_compact(F.array(stem, part))).alias("session_id")).distinct()


def unarchived(sessions: DataFrame, archived: DataFrame) -> DataFrame:
    """Sessions whose id, or its first eight characters, is not among the archived ids."""
    a = archived.select(F.col("session_id").alias("known"))
    return sessions.join(a, F.col("session_id") == F.col("known"), "left_anti").join(a, F.left("session_id", F.lit(8)) == F.col("known"), "left_anti")


def missing_memos(transcripts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Transcripts whose session suffix has a memo after all."""
    return transcripts.join(suffixes.select("suffix").distinct(), "suffix", "left_semi")


def triage_score(
    writes: Column,
    commits: Column,
    bash: Column,
    user: Column,
    subagents: Column,
    compactions: Column,
    minutes: Column,
    opus: Column,
    long_start: Column,
    errors: Column,
) -> Column:
    capped = F.least(writes * 3, F.lit(15)) + F.least(commits * 5, F.lit(15)) + F.least(bash, F.lit(5)) + F.least(user, F.lit(10)) + F.least(subagents * 3, F.lit(9)) + compactions * 4
    long = F.when(minutes >= 60, 8).when(minutes >= 30, 5).when(minutes >= 10, 3).when(minutes >= 5, 1).otherwise(0)
    return F.greatest(F.lit(0), capped + long + F.when(opus, 2).otherwise(0) + F.when(long_start, 2).otherwise(0) - F.least(errors, F.lit(3)))


def grade(score: Column) -> Column:
    return F.when(score >= 16, "high").when(score >= 9, "moderate").when(score >= 4, "low").otherwise("skip")


def orphaned_sessions(phases: DataFrame) -> DataFrame:
    """Sessions (session_id, phase, at, and now: the time to look from) that were archived over a day ago and never completed."""
    archived = F.max(F.when(F.col("phase") == "archived", F.col("at")))
    p = phases.groupBy("session_id").agg(archived.alias("archived"), F.count_if(F.col("phase") == "completed").alias("completed"), F.max("now").alias("now"))
    return p.where((F.col("completed") == 0) & (F.col("archived") < F.col("now") - F.expr("interval 24 hours")))


def suggested(links: DataFrame, source: str = "source_path") -> DataFrame:
    """Concepts that notes suggest by [[?x]]: mentions and distinct notes."""
    s = links.where(F.col("link_text").startswith("?")).select(F.trim(F.substring("link_text", F.lit(2), F.length("link_text"))).alias("concept"), source)
    return s.groupBy("concept").agg(F.count("*").alias("mentions"), F.countDistinct(source).alias("notes"))


def cartography(docs: DataFrame, resolved: DataFrame, lines: DataFrame) -> DataFrame:
    """path, backlinks, lines, maturity of each document; lines: path, lines."""
    n = resolved.where(F.col("target_path").isNotNull()).groupBy(F.col("target_path").alias("path")).agg(F.countDistinct("source_path").alias("backlinks"))
    maturity = F.when(F.col("lines") >= 200, "mature").when(F.col("lines") >= 50, "growing").otherwise("stub")
    return docs.select("path").join(lines, "path").join(n, "path", "left").select(
        "path",
        F.coalesce("backlinks", F.lit(0)).alias("backlinks"),
        "lines",
        maturity.alias("maturity"),
    )


def adjacency(tagged: DataFrame) -> DataFrame:
    """project_a < project_b with how many topics they share. tagged: project, topic; made distinct first, so only projects meet, never their notes."""
    t = tagged.where(F.col("project") != "").distinct()
    a, b = t.select("topic", F.col("project").alias("project_a")), t.select("topic", F.col("project").alias("project_b"))
    return a.join(b, "topic").where("project_a < project_b").groupBy("project_a", "project_b").agg(F.count("*").alias("shared"))


def memos_by_topic(tagged: DataFrame, least: int = 2) -> DataFrame:
    """Topics that at least so many memos hold, candidates for merging. tagged: path, topic."""
    return tagged.distinct().groupBy("topic").agg(F.count("*").alias("memos")).where(F.col("memos") >= least)


def themes_without_topic(tagged: DataFrame, known: DataFrame, least: int = 2) -> DataFrame:
    """Topics of at least `least` projects for which there is no topic note (known: topic)."""
    t = tagged.where(F.col("project") != "").groupBy("topic").agg(F.countDistinct("project").alias("projects")).where(F.col("projects") >= least)
    return t.join(known.select("topic").distinct(), "topic", "left_anti")


def size_class(bytes: Column) -> Column:
    return F.when(bytes < 1_000, "tiny").when(bytes < 10_000, "small").when(bytes < 1_000_000, "medium").when(bytes < 10_000_000, "large").otherwise("huge")


def by_size(files: DataFrame, bytes: str = "bytes") -> DataFrame:
    return files.groupBy(size_class(F.col(bytes)).alias("size_class")).agg(F.count("*").alias("files"), F.avg(bytes).alias("mean_bytes"))


def properties(fields: DataFrame) -> DataFrame:
    """How many documents have each frontmatter key, and how many values it takes. fields: path, key, value."""
    return fields.groupBy("key").agg(F.countDistinct("path").alias("documents"), F.countDistinct("value").alias("distinct_values"))
