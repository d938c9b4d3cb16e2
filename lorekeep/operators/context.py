"""What a new session should know of each project: overview, recent memos, open threads, cut to a budget.

Every table has one row for each project or item, so all projects are served by one job; the newest notes of a project are picked by a
window, of which Spark keeps the first rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import markdown as M
from lorekeep.operators.chunking import first_words

#: Section names in the order in which they are looked for.
DECISIONS = ("Key Decisions", "Decisions", "Key Points")
THREADS = ("Open Threads", "Open Items", "TODO", "Next Steps")
ITEM = r"- \[ \] (.+)"


def newest(docs: DataFrame, most: int, type: str = "memo") -> DataFrame:
    """The latest `most` notes of the type in each project, with nth from 1; unknown dates come last."""
    w = Window.partitionBy("project").orderBy(F.col("date").desc(), "path")
    return docs.where(F.col("type") == type).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)


def summary(title: Column, date: Column, text: Column) -> Column:
    """Title, date and the first section of decisions there is."""
    head = F.concat(F.lit("**"), title, F.lit("**"), F.when(date != "", F.concat(F.lit(" ("), date, F.lit(")"))).otherwise(""))
    return F.concat(head, F.coalesce(F.concat(F.lit("\n"), M.section(text, *DECISIONS)), F.lit("")))


def recent_memos(docs: DataFrame, most: int = 3) -> DataFrame:
    """project, nth, path, title, summary of the newest memos."""
    return newest(docs, most).select("project", "nth", "path", "title", summary(F.col("title"), F.col("date"), F.col("content")).alias("summary"))


def open_threads(docs: DataFrame, read: int = 5, memos: int = 3, items: int = 4) -> DataFrame:
    """project, path, title, items: unchecked items of the thread sections in the newest `read` memos; the first `memos` that have any, `items` of each."""
    found = F.regexp_extract_all(M.section(F.col("content"), *THREADS), F.lit(ITEM), F.lit(1))
    t = newest(docs, read).select("project", "path", "title", "nth", found.alias("items")).where(F.size("items") > 0)
    w = Window.partitionBy("project").orderBy("nth")
    return t.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= memos).withColumn("items", F.slice("items", 1, items))


def open_counts(docs: DataFrame, read: int = 5) -> DataFrame:
    """project, open_threads: unchecked items anywhere in the newest `read` memos."""
    return newest(docs, read).groupBy("project").agg(F.sum(F.regexp_count("content", F.lit(r"- \[ \] "))).cast("long").alias("open_threads"))


def joined(rows: DataFrame, text: Column, name: str, between: str) -> DataFrame:
    """One text for each project, its parts in the order of nth; a project has a fixed number of parts."""
    parts = F.array_sort(F.collect_list(F.struct("nth", text.alias("part"))))
    return rows.groupBy("project").agg(F.concat_ws(between, F.transform(parts, lambda p: p["part"])).alias(name))


def standard(docs: DataFrame) -> DataFrame:
    """project, memos (titles of the newest three), open_threads."""
    titles = joined(newest(docs, 3), F.concat(F.lit("- "), "title"), "memos", "\n")
    return titles.join(open_counts(docs), "project", "full_outer")


def full(docs: DataFrame, budget: int = 6000) -> DataFrame:
    """project, context: overview, open threads and summaries of recent memos, at most `budget` words."""
    overview = docs.where(F.element_at(F.split("path", "/"), -1) == "_project.md").groupBy("project").agg(
        F.min_by(M.overview(F.col("content")), "path").alias("overview")
    )
    items = F.concat_ws("\n", F.concat(F.lit("From "), "title", F.lit(":")), F.array_join(F.transform("items", lambda i: F.concat(F.lit("- [ ] "), i)), "\n"))
    threads = joined(open_threads(docs), items, "threads", "\n\n")
    memos = joined(recent_memos(docs), F.col("summary"), "memos", "\n\n")
    every = overview.join(threads, "project", "full_outer").join(memos, "project", "full_outer")
    return every.select("project", first_words(F.concat_ws("\n\n---\n\n", "overview", "threads", "memos"), budget).alias("context"))
