"""Column expressions over raw markdown; everything runs in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINK = r"\[\[([^\]|]+)(?:\|([^\]]+))?\]\]"
TASK = r"^(\s*)-\s*\[([ xX])\]\s*(.+)$"
HEADING = r"^(#{1,6})\s+(.+)$"


def unquoted(c: Column) -> Column:
    return F.trim(F.trim(F.trim(c), F.lit('"')), F.lit("'"))


def frontmatter(raw: Column) -> Column:
    """array of (key, value) in order; the block ends at the first --- after its start."""
    block = F.regexp_extract(raw, r"(?s)^---(.*?)---", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.contains(":"))
    return F.transform(
        lines,
        lambda x: F.struct(
            F.trim(F.substring_index(x, ":", 1)).alias("key"),
            unquoted(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("value"),
        ),
    )


def value(entries: Column, key: str) -> Column:
    """Last value of the key; null if absent."""
    return F.try_element_at(F.filter(entries, lambda e: e["key"] == key), F.lit(-1))["value"]


def listed(entries: Column, key: str) -> Column:
    """A [a, b] list, or a scalar as a list of one; empty items go."""
    v = value(entries, key)
    inner = F.when(v.rlike(r"^\[.*\]$"), F.split(F.regexp_extract(v, r"^\[(.*)\]$", 1), ",")).otherwise(F.array(v))
    return F.filter(F.transform(F.coalesce(inner, F.array().cast("array<string>")), unquoted), lambda x: x.isNotNull() & (x != ""))


def body(raw: Column) -> Column:
    return F.trim(F.regexp_replace(raw, r"(?s)^---.*?---", ""), F.lit(" \n\t\r"))


def without_frontmatter(raw: Column) -> Column:
    """What follows the frontmatter, without blank lines before it; all of raw if there is none."""
    return F.regexp_replace(raw, r"(?s)^---.*?---\n*", "")


def formatted(fields: dict[str, Column]) -> Column:
    """Frontmatter of the given fields; lists as [a, b], truth values in lower case, null fields left out."""
    parts = [F.concat(F.lit(f"{key}: "), c.cast("string")) for key, c in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *parts), F.lit("\n---"))


def list_text(c: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))


def lines(raw: Column) -> Column:
    return F.split(raw, "\n")


def section(text: Column, *names: str) -> Column:
    """Body of the first named section that there is, at most 400 characters and then an ellipsis."""
    found = F.coalesce(*[F.nullif(F.regexp_extract(text, rf"(?is)#{{2,}}\s*{n}\s*\n(.*?)(?=\n#{{2,}}|\z)", 1), F.lit("")) for n in names])
    cut = F.trim(found, F.lit(" \n"))
    return F.when(F.length(cut) > 400, F.concat(F.left(cut, F.lit(400)), F.lit("..."))).otherwise(cut)


def without_section(text: Column, name: str) -> Column:
    """text without the named second-level section; runs of blank lines shrink to one."""
    return F.regexp_replace(F.regexp_replace(text, rf"(?ms)^## {name}\s*\n.*?(?=^## |\z)", ""), r"\n{3,}", "\n\n")


#: Sections that may hold nothing but a query block, and one that always goes.
QUERY_SECTIONS = ("Memos Referencing This Topic", "Open Threads", "Connected Topics")
LISTED_SECTION = r"Recent Transcripts \(Last 7 Days\)"


def without_query_sections(text: Column) -> Column:
    """text without the sections above that hold query blocks and blank lines only; of Open Threads the blocks must ask for tasks."""
    text = without_section(text, LISTED_SECTION)
    for n in QUERY_SECTIONS:
        must = "[^`]*TASK" if n == "Open Threads" else ""
        text = F.regexp_replace(text, rf"(?m)^## {n}[ \t]*\n(?:\s*^```dataview\b{must}[^`]*^```[ \t]*$)+\s*(?=^## |\z)", "")
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def overview(text: Column) -> Column:
    """The section ## Overview, up to the next second-level heading; null if there is none."""
    return F.nullif(F.regexp_extract(text, r"(?ms)^## Overview.*?(?=\n## |\z)", 0), F.lit(""))


def plain_topics(raw: Column) -> Column:
    """raw with the quoted links "[[x]]" or "[[?x]]" of the topics list written as x; other lines stay."""
    block = F.regexp_extract(raw, r"(?m)^topics:[ \t]*\n(?:[ \t]*-.*\n?)+", 0)
    return F.when(block == "", raw).otherwise(F.replace(raw, block, F.regexp_replace(block, r"[\"']?\[\[\??([^\]|]+)(?:\|[^\]]*)?\]\][\"']?", "$1")))


def topics(raw: Column) -> Column:
    """The topics of the frontmatter, written as [a, b] or as a list of lines."""
    front = F.regexp_extract(raw, r"(?s)^---(.*?)\n---", 1)
    block = F.regexp_extract(front, r"(?m)^topics:[ \t]*\n((?:[ \t]*-.*\n?)+)", 1)
    items = F.transform(F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]*-[ \t]*(.+)$"), F.lit(1)), unquoted)
    return F.when(block != "", F.transform(items, lambda x: F.regexp_replace(x, r"^\[\[\??|\]\]$", ""))).otherwise(listed(frontmatter(raw), "topics"))


def highlighted(text: Column, terms: list[str], width: int = 50) -> Column:
    """At most `width` words from the first one that is a term on, terms between >>> and <<<; the start of the text if there is none."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    hit = lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}]+", "")).isin(*terms)
    at = F.greatest(F.coalesce(F.array_position(F.transform(words, hit), F.lit(True)), F.lit(0)), F.lit(1)).cast("int")
    shown = F.transform(F.slice(words, at, F.lit(width)), lambda w: F.when(hit(w), F.concat(F.lit(">>>"), w, F.lit("<<<"))).otherwise(w))
    return F.concat(F.when(at > 1, "...").otherwise(""), F.array_join(shown, " "), F.when(F.size(words) - at + 1 > width, "...").otherwise(""))


def split_by_headers(text: Column) -> Column:
    """Pieces that begin at second- or third-level headings, and what stands before."""
    return F.split(text, r"(?m)(?=^#{2,3}\s)")


def snippet(text: Column, width: int = 200) -> Column:
    b = body(text)
    return F.concat(F.left(F.regexp_replace(b, r"\s+", " "), F.lit(width)), F.when(F.length(b) > width, "...").otherwise(""))


#: Names that stand for no project, and folders of a home that hold projects.
RESERVED = ("", "_", "tmp", "temp", "downloads", "desktop", "home", "documents", "users", "var", "etc", "usr", "bin")
HOME_FOLDERS = ("Documents", "Downloads", "Desktop")


def project_name(c: Column) -> Column:
    """Safe name: letters, digits, _ and -, at most 50 characters; empty or reserved: _uncategorized."""
    n = F.left(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?U)[^\w-]", "_"), "_+", "_"), "^_|_$", ""), F.lit(50))
    return F.when(F.lower(n).isin(*RESERVED), "_uncategorized").otherwise(n)


def folder_project(c: Column) -> Column:
    """The project of a log folder, whose name is a path with - for /: what follows the user's home and a folder of HOME_FOLDERS in it; ~home or ~Folder if nothing does."""
    parts = F.split(F.regexp_replace(c, "^-+", ""), "-")
    n, at = F.size(parts), lambda i: F.get(parts, F.lit(i))
    rest = lambda start: F.array_join(F.slice(parts, start + 1, F.greatest(n - start, F.lit(0))), "-")
    common = at(2).isin(*HOME_FOLDERS)
    in_users = F.when((n >= 4) & common, rest(3)).when((n >= 3) & ~common, rest(2)).otherwise("")
    found = F.when((at(0) == "Users") & (n >= 2), in_users).when((at(0) == "home") & (n >= 2), F.when(n > 2, rest(2)).otherwise("")).otherwise(rest(0))
    none = F.when((n == 2) & at(0).isin("Users", "home"), "~home").when((n == 3) & at(0).isin("Users", "home") & common, F.concat(F.lit("~"), at(2)))
    bare = F.coalesce(F.nullif(F.regexp_replace(c, "^-+|-+$", ""), F.lit("")), F.lit("unknown"))
    return F.when(found != "", found).otherwise(F.coalesce(none, bare))


def remote_project(c: Column) -> Column:
    """The project of a repository's address, by ssh or http; null if it is neither."""
    found = [F.regexp_extract(c, p, 1) for p in (r"^git@[^:]+:[^/]+/([^/]+?)(?:\.git)?$", r"^https?://[^/]+/[^/]+/([^/]+?)(?:\.git)?$")]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in found])


def unique_name(name: Column, folder: Column, taken_by_other: Column) -> Column:
    """The safe name, with six digits of the folder's hash if another folder has it."""
    safe = project_name(name)
    return F.when(taken_by_other, F.concat(safe, F.lit("-"), F.left(F.md5(folder.cast("binary")), F.lit(6)))).otherwise(safe)


def stamped(raw: Column, fields: dict[str, Column]) -> Column:
    """raw with the fields at the end of its frontmatter, those that are null or 0 left out; as it was if it has no frontmatter or the first of them already."""
    lines = F.concat_ws("\n", *[F.when(c != 0, F.concat(F.lit(f"{key}: "), c.cast("string"))) for key, c in fields.items()])
    front = F.trim(F.regexp_extract(raw, r"(?s)^---(.*?)---", 1), F.lit(" \n\r\t"))
    rest = F.regexp_replace(raw, r"(?s)^---.*?(?=---)", "")
    known = F.left(raw, F.lit(1000)).contains(f"{next(iter(fields))}:")
    new = F.concat(F.lit("---\n"), front, F.lit("\n"), lines, F.lit("\n"), rest)
    return F.when(raw.rlike(r"(?s)^---.*?---") & ~known & (lines != ""), new).otherwise(raw)


def session_suffix(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"^\d{8}-\d{6}-([a-f0-9]{8})", 1), F.lit(""))


def without_system_tags(c: Column, tags: tuple[str, ...]) -> Column:
    for t in tags:
        c = F.regexp_replace(c, rf"(?s)<{t}>.*?</{t}>", "")
    return F.trim(F.regexp_replace(c, r"\n{3,}", "\n\n"), F.lit(" \n"))


def truncated(c: Column, limit: int, head: float = 0.7, tail: float = 0.25) -> Column:
    mark = F.lit("\n... [truncated] ...\n")
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(int(limit * head))), mark, F.right(c, F.lit(int(limit * tail))))).otherwise(c)
