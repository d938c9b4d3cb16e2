"""Index life cycle: the derived tables in immutable segments.

A version is a list of segments. A build writes one segment with the rows of what changed, and the paths that it takes away from earlier ones; a reader joins these marks to the
rows. Statistics of a search (documents, lengths, document frequencies) come from the rows that hold. Compaction merges the newest segments by size.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lorekeep.operators import chunking, curation, extract, inverted, search
from lorekeep.sources import store

TABLES = ("documents", "links", "tasks", "headings", "tags", "aliases", "chunks", "hashes", "catalog", "postings")
KEYS = {"documents": "path", "links": "source_path", "hashes": "path", "catalog": "path", "postings": "path"}
#: An embedding function, and the provider and model that its results are kept under.
Embedder = tuple[Callable[[list[str]], list[list[float]]], str, str]


def hashes(notes: DataFrame) -> DataFrame:
    return notes.select("path", F.sha2(F.col("raw").cast("binary"), 256).alias("content_hash"))


def derived(notes: DataFrame, docs: DataFrame) -> dict[str, DataFrame]:
    """The tables but for documents, from the notes and these."""
    return {
        "links": extract.links(notes), "tasks": extract.tasks(notes), "headings": extract.headings(notes), "tags": extract.tags(docs),
        "aliases": extract.tags(docs, "aliases", "alias"), "chunks": chunking.chunks(notes), "hashes": hashes(notes), "catalog": search.catalog(docs),
        "postings": search.postings(inverted.dealt(docs)),
    }


class Segment(NamedTuple):
    """An immutable part of an index: a folder with the rows of some notes in each table, and gone: paths whose rows in earlier segments don't hold any more."""

    path: str
    rows: int  # notes


def segments(version: str, spark: SparkSession) -> list[Segment]:
    """What a version is made of, the oldest first; their number is kept small by compact()."""
    return [Segment(r.path, r.rows) for r in spark.read.parquet(f"{version}/segments").orderBy("nth").collect()]


def versioned(made: list[Segment], version: str, spark: SparkSession) -> str:
    """Writes the list of segments that a version is; readers move by its name, so a build that fails changes nothing."""
    rows = [(i, x.path, x.rows) for i, x in enumerate(made)]
    spark.createDataFrame(rows, "nth int, path string, rows long").coalesce(1).write.mode("overwrite").parquet(f"{version}/segments")
    return version


def written(notes: DataFrame, gone: DataFrame, root: str) -> Segment:
    """A new segment of these notes: documents first, as other tables are made of them, then the rest; stats: rows of each table, observed while they are written."""
    spark, path, seen = notes.sparkSession, f"{root.rstrip('/')}/s-{uuid.uuid4().hex}", {}

    def write(name: str, table: DataFrame) -> None:
        seen[name] = Observation()
        table.observe(seen[name], F.count("*").alias("rows")).write.parquet(f"{path}/{name}")

    write("documents", extract.documents(notes))
    for name, table in derived(notes, spark.read.parquet(f"{path}/documents")).items():
        if name == "postings":
            search.write_postings(table, f"{path}/{name}")
        else:
            write(name, table)
    write("gone", gone.select("path"))
    counts = [(name, o.get["rows"]) for name, o in seen.items()]
    spark.createDataFrame(counts, "table_name string, row_count long").coalesce(1).write.parquet(f"{path}/stats")
    return Segment(path, seen["documents"].get["rows"])


def live(made: list[Segment], table: str, spark: SparkSession) -> DataFrame:
    """Rows of a table in all segments, without those whose path a later segment has marked as gone."""
    if table == "cache":
        parts = [spark.read.parquet(f"{x.path}/cache") for x in made if exists(f"{x.path}/cache", spark)]
        return functools.reduce(DataFrame.unionByName, parts)
    at = lambda df, i: df.withColumn("segment", F.lit(i))
    rows = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [at(spark.read.parquet(f"{x.path}/{table}"), i) for i, x in enumerate(made)])
    if len(made) == 1:
        return rows.drop("segment")
    marks = functools.reduce(DataFrame.unionByName, [at(spark.read.parquet(f"{x.path}/gone"), i) for i, x in enumerate(made[1:], 1)])
    last = store.small_side(marks.groupBy(F.col("path").alias("gone_path")).agg(F.max("segment").alias("gone_at")))
    key = KEYS.get(table, "doc_path")
    return rows.join(last, (F.col(key) == F.col("gone_path")) & (F.col("segment") < F.col("gone_at")), "left_anti").drop("segment")


def exists(path: str, spark: SparkSession) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read(version: str, table: str, spark: SparkSession) -> DataFrame:
    """A table of TABLES as it is in a version; cache: content_hash, provider, model, embedding; vectors: the chunks with the embeddings of the version's embedder."""
    made = segments(version, spark)
    if table != "vectors":
        return live(made, table, spark)
    by = spark.read.parquet(f"{version}/embedder").head()
    return chunking.to_embed(live(made, "chunks", spark), live(made, "cache", spark), by.provider, by.model)[0]


def with_vectors(made: list[Segment], version: str, spark: SparkSession, embedder: Embedder) -> None:
    """Adds to the last segment the embeddings that no segment has: of each text once, by its hash. A change of model asks for all of them."""
    embed, provider, model = embedder
    wanted = live(made, "chunks", spark).groupBy("content_hash").agg(F.first("content").alias("content"))
    known = [x for x in made if exists(f"{x.path}/cache", spark)]
    if known:
        wanted = chunking.to_embed(wanted, live(known, "cache", spark), provider, model)[1]
    rows = chunking.embedded(wanted, embed).select("content_hash", F.lit(provider).alias("provider"), F.lit(model).alias("model"), "embedding")
    rows.write.mode("overwrite").parquet(f"{made[-1].path}/cache")
    spark.createDataFrame([(provider, model)], "provider string, model string").coalesce(1).write.mode("overwrite").parquet(f"{version}/embedder")


def named(root: str) -> str:
    return f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"


def full(notes: DataFrame, root: str, embedder: Embedder | None = None) -> str:
    """A version of one segment, with every table of all notes."""
    spark, version = notes.sparkSession, named(root)
    made = [written(notes, notes.select("path").limit(0), root)]
    if embedder:
        with_vectors(made, version, spark, embedder)
    return versioned(made, version, spark)


def incremental(notes: DataFrame, before: str, root: str, embedder: Embedder | None = None) -> str:
    """A version with one more segment: only new and changed notes are derived and written; rows of deleted and changed ones are marked as gone. The plan is kept with the version."""
    spark, version = notes.sparkSession, named(root)
    curation.hash_plan(hashes(notes), read(before, "hashes", spark)).write.parquet(f"{version}/plan")
    plan = spark.read.parquet(f"{version}/plan")
    fresh = notes.join(store.small_side(plan.where("action in ('new', 'updated')").select("path")), "path", "left_semi")
    return added(fresh, plan.where("action in ('updated', 'deleted')"), before, version, root, embedder)


def added(fresh: DataFrame, gone: DataFrame, before: str | None, version: str, root: str, embedder: Embedder | None = None) -> str:
    """A version with one more segment of these notes, after which the gone paths of earlier segments don't hold."""
    spark = fresh.sparkSession
    made = [*(segments(before, spark) if before else []), written(fresh, gone, root)]
    if embedder:
        with_vectors(made, version, spark, embedder)
    return versioned(made, version, spark)


def compacted(before: str, root: str, ratio: int = 4) -> str:
    """A version whose newest segments are one, as far back as a segment has fewer than ratio times the notes of all after it; the same version if none has.

    So the number of segments grows with the logarithm of the index, and a note is rewritten as often.
    """
    spark = SparkSession.active()
    made = segments(before, spark)
    first, rows = len(made) - 1, made[-1].rows
    while first and made[first - 1].rows < ratio * max(rows, 1):
        first -= 1
        rows += made[first].rows
    if first == len(made) - 1:
        return before
    old, path = made[first:], f"{root.rstrip('/')}/s-{uuid.uuid4().hex}"
    for table in TABLES:
        rows_of = live(old, table, spark)
        search.write_postings(inverted.dealt(rows_of, rows), f"{path}/{table}") if table == "postings" else rows_of.write.parquet(f"{path}/{table}")
    gone = functools.reduce(DataFrame.unionByName, [spark.read.parquet(f"{x.path}/gone") for x in old]).distinct()
    (gone if first else gone.limit(0)).write.parquet(f"{path}/gone")
    if any(exists(f"{x.path}/cache", spark) for x in old):
        live([x for x in old if exists(f"{x.path}/cache", spark)], "cache", spark).write.parquet(f"{path}/cache")
    version = named(root)
    if exists(f"{before}/embedder", spark):
        spark.read.parquet(f"{before}/embedder").coalesce(1).write.parquet(f"{version}/embedder")
    return versioned([*made[:first], Segment(path, spark.read.parquet(f"{path}/documents").count())], version, spark)


def followed(changed: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Stream of changed notes (path, raw; raw null: deleted) into an index below root: a segment for each batch, in version batch-<number>. A path stands once in a batch.
    A batch that runs again writes its version again, from the one before it."""

    def write(batch: DataFrame, number: int) -> None:
        notes = batch.persist()
        added(notes.where("raw is not null"), notes, f"{root}/batch-{number - 1}" if number else None, f"{root}/batch-{number}", root)
        notes.unpersist()

    return changed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def searchable(version: str, spark: SparkSession) -> search.Index:
    return search.Index(read(version, "catalog", spark), read(version, "postings", spark))


def changes(plan: DataFrame) -> DataFrame:
    """How many notes a build added, updated, left and deleted."""
    return plan.groupBy("action").agg(F.count("*").alias("notes"))


def described(docs: DataFrame, resolved: DataFrame, tasks: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """what, name, count: documents by type, links and how many are broken, tasks and how many are open, and documents that have vectors."""
    long = lambda c: c.cast("long").alias("count")
    by_type = docs.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("count")).select(F.lit("documents").alias("what"), "name", long(F.col("count")))
    pair = lambda what, df, test: df.agg(F.count("*").alias("all"), F.count_if(test).alias("some")).select(
        F.lit(what).alias("what"),
        F.expr("stack(2, 'all', all, 'open', some)").alias("name", "count"),
    )
    out = by_type.unionByName(pair("links", resolved, F.col("is_broken"))).unionByName(pair("tasks", tasks, ~F.col("completed")))
    if vectors is None:
        return out
    return out.unionByName(
        vectors.agg(F.countDistinct("path").alias("count")).select(F.lit("vectors").alias("what"), F.lit("documents").alias("name"), "count")
    )


def status(version: str, spark: SparkSession) -> DataFrame:
    """Rows of each table."""
    parts = [read(version, t, spark).agg(F.lit(t).alias("table_name"), F.count("*").alias("row_count")) for t in TABLES]
    return functools.reduce(DataFrame.unionByName, parts)
