"""Link, task, temporal and project queries over the derived tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def project_of(path: Column) -> Column:
    return F.when(path.startswith("projects/"), F.split_part(path, F.lit("/"), F.lit(2)))


def backlinks(resolved: DataFrame, docs: DataFrame) -> DataFrame:
    """For every document the links to it: by target, by full path or by stem, once each. Three equi-joins, not one join on OR."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    names = docs.select("path", F.explode(F.array_distinct(F.array(F.col("path"), stem))).alias("link_text"))
    row = ["path", "source_path", "link_text", "line_number"]
    by_target = resolved.where(F.col("target_path").isNotNull()).withColumnRenamed("target_path", "path").select(*row)
    by_text = resolved.select("source_path", "link_text", "line_number").join(names, "link_text").select(*row)
    return by_target.unionByName(by_text).distinct()


def outlinks(resolved: DataFrame) -> DataFrame:
    return resolved.select("source_path", "link_text", "target_path", "line_number")


def broken(resolved: DataFrame, project: str | None = None) -> DataFrame:
    b = resolved.where("is_broken")
    return b.where(F.col("source_path").startswith(f"projects/{project}/")) if project else b


def open_tasks(
    tasks: DataFrame,
    docs: DataFrame,
    since: str | None = None,
    project: str | None = None,
    transcripts: bool = False,
    only_open_threads: bool = True,
) -> DataFrame:
    """Open tasks with their document's title and date; unknown documents stay when since is given."""
    t = tasks.where(~F.col("completed"))
    if not transcripts:
        t = t.where(~F.col("doc_path").contains("/transcripts/"))
    if only_open_threads:
        t = t.where(F.col("section") == "Open Threads")
    if project:
        t = t.where(F.col("doc_path").startswith(f"projects/{project}/"))
    t = t.join(docs.select(F.col("path").alias("doc_path"), "title", "project", "date"), "doc_path", "left")
    return t.where((F.col("date") >= since) | F.col("date").isNull()) if since else t


def newest_tasks(open_tasks: DataFrame, most: int | None = None) -> DataFrame:
    """Open tasks as they are listed: latest documents first, unknown dates last, then by path and line."""
    listed = open_tasks.orderBy(F.col("date").desc(), "doc_path", "line_number")
    return listed.limit(most) if most else listed


def tag_histogram(tags: DataFrame) -> DataFrame:
    return tags.groupBy("tag").agg(F.count("*").alias("count"))


def alias_map(aliases: DataFrame) -> DataFrame:
    return aliases.groupBy(F.lower("alias").alias("alias")).agg(F.max("doc_path").alias("doc_path"))


def topic_connections(links_back: DataFrame, tasks: DataFrame) -> DataFrame:
    """Open tasks of the documents that link to each document, once for each such link."""
    t = tasks.where(~F.col("completed")).select(F.col("doc_path").alias("source_path"), "task_text", F.col("line_number").alias("task_line"))
    return links_back.join(t, "source_path").groupBy("path").agg(F.count("*").alias("task_rows"), F.countDistinct("source_path").alias("sources"))


def cross_project(resolved: DataFrame) -> DataFrame:
    a, b = project_of(F.col("source_path")), project_of(F.col("target_path"))
    return resolved.where(F.col("target_path").isNotNull()).withColumn("source_project", a).withColumn("target_project", b).where("source_project <> target_project").select(
        "source_path",
        "target_path",
        "source_project",
        "target_project",
        "line_number",
    )


def stats(docs: DataFrame, resolved: DataFrame, tasks: DataFrame, tags: DataFrame) -> DataFrame:
    """One row; each table is read once. The joined sides have one row each."""
    d = docs.agg(F.count("*").alias("documents"), F.countDistinct("project").alias("projects"), F.count_if(F.col("type") == "memo").alias("memos"))
    r = resolved.agg(F.count("*").alias("links"), F.count_if("is_broken").alias("broken_links"), F.countDistinct("target_path").alias("linked_documents"))
    t = tasks.agg(
        F.count("*").alias("tasks"),
        F.count_if(~F.col("completed")).alias("open_tasks"),
        F.count_if(
            ~F.col("completed") & (F.col("section") == "Open Threads") & ~F.col("doc_path").contains("/transcripts/")
        ).alias("actionable_tasks"),
    )
    g = tags.agg(F.countDistinct("tag").alias("tags"))
    return d.crossJoin(r).crossJoin(t).crossJoin(g)


def recent(docs: DataFrame, tasks: DataFrame, since: str) -> DataFrame:
    """Recent documents and how many open tasks each has."""
    d = docs.where(F.col("date") >= since).select("path", "title", "type", "project", "date")
    n = tasks.where(~F.col("completed")).join(
        d.select(F.col("path").alias("doc_path")),
        "doc_path",
        "left_semi",
    ).groupBy(F.col("doc_path").alias("path")).agg(F.count("*").alias("open_tasks"))
    return d.join(n, "path", "left").withColumn("open_tasks", F.coalesce("open_tasks", F.lit(0)))


def project_status(docs: DataFrame, tasks: DataFrame, week: str, month: str) -> DataFrame:
    """One aggregate of the documents and one of the tasks for all projects."""
    d = docs.where(F.col("project") != "").groupBy("project").agg(
        F.count_if(F.col("date") >= week).alias("last_week"),
        F.count_if(F.col("date") >= month).alias("last_month"),
        F.count_if(F.col("type") == "memo").alias("memos"),
        F.count_if(F.col("type") == "transcript").alias("transcripts"),
        F.max("date").alias("latest"),
    )
    actionable = ~F.col("completed") & ~F.col("doc_path").contains("/transcripts/") & (F.col("section") == "Open Threads")
    t = tasks.where(actionable).groupBy(project_of(F.col("doc_path")).alias("project")).agg(F.count("*").alias("open_tasks"))
    state = F.when(F.col("last_week") > 0, "active").when(F.col("last_month") > 0, "recent").when(
        F.col("memos") + F.col("transcripts") > 0,
        "dormant",
    ).otherwise("empty")
    return d.join(t, "project", "left").withColumn("open_tasks", F.coalesce("open_tasks", F.lit(0))).withColumn("state", state)


def project_activity(docs: DataFrame, tasks: DataFrame, since: str) -> DataFrame:
    d = docs.where((F.col("date") >= since) & (F.col("project") != "")).groupBy("project").agg(F.count("*").alias("documents"))
    t = tasks.groupBy(project_of(F.col("doc_path")).alias("project")).agg(F.count_if("completed").alias("done"), F.count_if(~F.col("completed")).alias("open"))
    return d.join(t, "project", "left").select("project", "documents", F.coalesce("done", F.lit(0)).alias("done"), F.coalesce("open", F.lit(0)).alias("open"))


def orphans(docs: DataFrame, resolved: DataFrame) -> DataFrame:
    return docs.select("path").join(resolved.select(F.col("target_path").alias("path")), "path", "left_anti")


def dead_ends(docs: DataFrame, resolved: DataFrame) -> DataFrame:
    return docs.select("path").join(resolved.select(F.col("source_path").alias("path")), "path", "left_anti")


def link_check(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("source_path").agg(F.count("*").alias("links"), F.count_if("is_broken").alias("unresolved"))
