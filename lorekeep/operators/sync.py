"""Copies of notes that a tool keeps by itself: what is new, what changed, and the note to write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import markdown as M
from lorekeep.operators import curation

#: Fixed value: the heading below which a reader's own remarks stand.
MARKER = "## Vault Annotations"


def sources(notes: DataFrame) -> DataFrame:
    """path, content_hash, line_count, title (first heading among the first 21 lines, else the file's name) of each note that isn't blank."""
    raw = F.col("raw")
    lines = F.slice(M.lines(raw), 1, 21)
    heading = F.try_element_at(F.filter(lines, lambda x: x.startswith("# ") & ~x.startswith("# ///")), F.lit(1))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    named = F.initcap(F.regexp_replace(stem, "[-_]", " "))
    return notes.where(F.trim(raw, F.lit(" \t\r\n")) != "").select(
        "path",
        F.sha2(raw.cast("binary"), 256).alias("content_hash"),
        F.size(M.lines(raw)).cast("long").alias("line_count"),
        F.coalesce(F.trim(F.substring(heading, F.lit(3), F.length(heading))), named).alias("title"),
    )


#: Fixed value: the note that changes all the time.
VOLATILE = "MEMORY.md"


def scanned(files: DataFrame, project: str | None = None, exclude: tuple[str, ...] = (), volatile: bool = True) -> DataFrame:
    """files (folder, path, raw, ...) with display and project, the folder's project and its safe name, and volatile; excluded folders and blank notes are left out, volatile ones
    if they aren't asked for, other projects than `project` if it is given (a name, or the end of one)."""
    f = files.where(~F.col("folder").isin(*exclude)) if exclude else files
    f = f.where(F.trim("raw", F.lit(" \t\r\n")) != "").withColumn("display", M.folder_project(F.col("folder")))
    f = f.withColumn("project", M.project_name(F.col("display"))).withColumn("volatile", F.element_at(F.split("path", "/"), -1) == VOLATILE)
    if not volatile:
        f = f.where(~F.col("volatile"))
    if project:
        f = f.where(F.lower("display").endswith(project.lower()) | F.lower("project").endswith(project.lower()))
    return f


def states(notes: DataFrame) -> DataFrame:
    """path, source_hash, synced, source, volatile that the kept copies' frontmatter tells."""
    fm = M.frontmatter(F.col("raw"))
    told = notes.where(F.col("path").rlike(r"^projects/[^/]+/auto-memory/[^/]+\.md$"))
    texts = [F.coalesce(M.value(fm, k), F.lit("")).alias(k) for k in ("source_hash", "synced", "source")]
    return told.select("path", *texts, (F.coalesce(M.value(fm, "volatile"), F.lit("false")) == "true").alias("volatile"))


def plan(found: DataFrame, kept: DataFrame, narrowed: bool = False) -> DataFrame:
    """path, action: new, updated, unchanged, or deleted (its source is gone; not told if the sources are narrowed to a project)."""
    p = curation.hash_plan(found, kept)
    return p.where("action <> 'deleted'") if narrowed else p


def without_memory(sessions: DataFrame, found: DataFrame) -> DataFrame:
    """Projects that have sessions but no note of the tool."""
    return sessions.select("project").distinct().join(found.select("project").distinct(), "project", "left_anti")


def annotations(kept: Column) -> Column:
    """What stands from the last marker on; null if nothing but blanks follows it."""
    after = F.element_at(F.split(kept, MARKER), -1)
    return F.when(kept.contains(MARKER) & (F.trim(after, F.lit(" \t\r\n")) != ""), F.concat(F.lit(MARKER), F.rtrim(after, F.lit(" \t\r\n"))))


def note(raw: Column, fields: dict[str, Column], kept: Column) -> Column:
    """The note to write: fields as frontmatter, the source's body, and the annotations of the kept note or an empty place for them."""
    return F.concat(
        M.formatted(fields),
        F.lit("\n\n"),
        F.rtrim(M.without_frontmatter(raw), F.lit(" \t\r\n")),
        F.lit("\n\n\n"),
        F.coalesce(annotations(kept), F.lit(f"{MARKER}\n")),
    )
