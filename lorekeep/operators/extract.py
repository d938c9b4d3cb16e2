"""Tables derived from notes (path, raw): documents, links, tasks, headings, tags, aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import markdown as M


def documents(notes: DataFrame) -> DataFrame:
    """path, title, content, type, project, date (text, '' if unknown), status, tags, aliases."""
    n = notes.select("path", "raw", M.frontmatter(F.col("raw")).alias("fm"))
    fm, path = F.col("fm"), F.col("path")
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.md$", "")
    by_path = F.when(path.contains("/memos/"), "memo").when(path.contains("/transcripts/"), "transcript").when(
        path.contains("/auto-memory/"),
        "auto-memory",
    ).when(path.startswith("topics/"), "concept").otherwise("note")
    named = F.regexp_replace(F.regexp_extract(stem, r"^(\d{8})", 1), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    or_else = lambda key, other: F.coalesce(F.nullif(M.value(fm, key), F.lit("")), other)
    return n.select(
        "path",
        or_else("title", stem).alias("title"),
        M.body(F.col("raw")).alias("content"),
        or_else("type", by_path).alias("type"),
        or_else("project", F.when(path.startswith("projects/"), F.split_part(path, F.lit("/"), F.lit(2))).otherwise("")).alias("project"),
        or_else("date", named).alias("date"),
        or_else("status", F.lit("")).alias("status"),
        M.listed(fm, "tags").alias("tags"),
        M.listed(fm, "aliases").alias("aliases"),
    )


def numbered(notes: DataFrame) -> DataFrame:
    """path, line_number (from 1), line."""
    return notes.select("path", F.posexplode(M.lines(F.col("raw"))).alias("at", "line")).select("path", (F.col("at") + 1).alias("line_number"), "line")


def links(notes: DataFrame) -> DataFrame:
    """source_path, link_text, display_text (null if none), line_number; once for each text and line. Each note's row gives its links: nothing is shuffled."""
    numbered_lines = F.transform(M.lines(F.col("raw")), lambda x, i: F.struct((i + 1).alias("n"), x.alias("line")))
    linked = F.filter(numbered_lines, lambda x: x["line"].contains("[["))
    found = notes.where(F.col("raw").contains("[[")).select("path", F.explode(linked).alias("x")).select("path", F.col("x.n").alias("line_number"), "x.line")
    texts = F.transform(F.regexp_extract_all("line", F.lit(M.LINK), F.lit(1)), lambda x: F.trim(x))  # noqa: PLW0108
    shown = F.transform(F.regexp_extract_all("line", F.lit(M.LINK), F.lit(2)), lambda x: F.nullif(F.trim(x), F.lit("")))
    both = found.select("path", "line_number", texts.alias("texts"), shown.alias("shown")).select("*", F.explode(F.array_distinct("texts")).alias("link_text"))
    own = F.filter(F.arrays_zip("texts", "shown"), lambda x: x["texts"] == F.col("link_text"))
    display = F.array_min(F.transform(own, lambda x: x["shown"]))
    return both.select(F.col("path").alias("source_path"), "link_text", "line_number", display.alias("display_text"))


def resolved(links: DataFrame, docs: DataFrame) -> DataFrame:
    """links with target_path (null if broken) and is_broken: by path, topic or project first, then by alias."""
    target = F.regexp_replace(F.trim(F.substring_index("link_text", "#", 1)), r"\.md$", "")
    distinct = links.select("link_text").distinct().withColumn("t", target).where(F.col("t") != "")
    t = F.col("t")
    tries = F.array(
        F.concat(t, F.lit(".md")),
        F.concat(F.lit("topics/"), t, F.lit(".md")),
        F.when(t.contains("/"), F.concat(t, F.lit("/_project.md"))).otherwise(F.concat(F.lit("projects/"), t, F.lit("/_project.md"))),
    )
    by_path = distinct.select("link_text", F.posexplode(tries).alias("rank", "path")).join(docs.select("path"), "path")
    by_alias = distinct.join(docs.select("path", F.explode("aliases").alias("t")), "t").select("link_text", F.lit(3).alias("rank"), "path")
    best = by_path.select("link_text", "rank", "path").unionByName(by_alias).groupBy("link_text").agg(
        F.min_by("path", F.struct("rank", "path")).alias("target_path")
    )
    return links.join(best, "link_text", "left").withColumn("is_broken", F.col("target_path").isNull())


def headings(notes: DataFrame) -> DataFrame:
    n = numbered(notes).where(F.col("line").rlike(M.HEADING))
    return n.select(
        F.col("path").alias("doc_path"),
        F.trim(F.regexp_extract("line", M.HEADING, 2)).alias("heading"),
        F.length(F.regexp_extract("line", M.HEADING, 1)).alias("level"),
        "line_number",
    )


def tasks(notes: DataFrame) -> DataFrame:
    """doc_path, task_text, completed, line_number, section: the last heading above. Each note's row gives its tasks: nothing is shuffled."""
    marked = F.transform(M.lines(F.col("raw")), lambda x, i: F.struct((i + 1).alias("n"), x.alias("line")))
    heads = F.filter("marked", lambda x: x["line"].rlike(M.HEADING))
    items = F.filter("marked", lambda x: x["line"].rlike(M.TASK))
    found = notes.select("path", marked.alias("marked")).select("path", heads.alias("heads"), items.alias("items")).select("path", "heads", F.explode("items").alias("x"))
    above = F.try_element_at(F.filter("heads", lambda h: h["n"] < F.col("x.n")), F.lit(-1))["line"]
    line = F.col("x.line")
    return found.select(
        F.col("path").alias("doc_path"),
        F.trim(F.regexp_extract(line, M.TASK, 3)).alias("task_text"),
        (F.lower(F.regexp_extract(line, M.TASK, 2)) == "x").alias("completed"),
        F.col("x.n").alias("line_number"),
        F.trim(F.regexp_extract(above, M.HEADING, 2)).alias("section"),
    )


def tags(docs: DataFrame, column: str = "tags", name: str = "tag") -> DataFrame:
    return docs.select(F.col("path").alias("doc_path"), F.explode(column).alias(name)).distinct()
