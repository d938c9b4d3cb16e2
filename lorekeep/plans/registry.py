"""Registration of queries, and the derived tables that they share: made once in a session from the given tables, kept as Parquet, and read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import extract, fulltext, inverted, ranked, search
from lorekeep.sources import store, vault

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
CTE = "WITH "


def tidy(df: DataFrame) -> DataFrame:
    """Whole numbers as long, doubles rounded to six places: one form for every engine."""
    whole, real = ("int", "smallint", "tinyint"), ("double", "float")
    return df.select(*[F.col(c).cast("long").alias(c) if t in whole else F.round(c, 6).alias(c) if t in real else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def question_vector(s: SparkSession, d: str) -> list[float]:
    """The question of the vector searches is a parameter of their plans: one row."""
    row = vault.table(s, d, "embeddings").where("vec_id = 0").select("embedding").head()
    return list(row[0]) if row else []


def written(df: DataFrame) -> Callable[[str], None]:
    return lambda path: df.write.parquet(path)


def places(catalog: DataFrame) -> DataFrame:
    tasks = int(catalog.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranked.places(ranked.numbered(catalog), ranked.size(catalog.count(), tasks))


def derived(s: SparkSession, d: str, name: str) -> DataFrame:
    """documents (without content), links (resolved), tasks, tags, catalog and postings of the archive, terms (the dictionary), and what ranked searches read: places, blocks or stem_blocks and their terms; positions: of words in content and title."""
    makers: dict[str, Callable[[], Callable[[str], None]]] = {
        "documents": lambda: written(extract.documents(vault.notes(s, d)).drop("content")),
        "links": lambda: written(extract.resolved(extract.links(vault.notes(s, d)), derived(s, d, "documents"))),
        "tasks": lambda: written(extract.tasks(vault.notes(s, d))),
        "tags": lambda: written(extract.tags(derived(s, d, "documents"))),
        "catalog": lambda: written(search.catalog(vault.archive(s, d))),
        "postings": lambda: lambda path: search.write_postings(search.postings(inverted.dealt(vault.archive(s, d))), path),
        "positions": lambda: lambda path: fulltext.write_positions(fulltext.positions(inverted.dealt(vault.archive(s, d)), "content", "title"), path),
        "places": lambda: written(places(derived(s, d, "catalog"))),
        "blocks": lambda: written(search.text_blocks(vault.archive(s, d), derived(s, d, "places"))),
        "terms": lambda: lambda path: fulltext.write_terms(ranked.terms(derived(s, d, "postings")), path),
        "stem_blocks": lambda: written(search.text_blocks(vault.archive(s, d), derived(s, d, "places"), stemmed=True)),
        "block_terms": lambda: written(ranked.block_terms(derived(s, d, "blocks"))),
        "stem_terms": lambda: written(ranked.block_terms(derived(s, d, "stem_blocks"))),
    }
    return store.kept(s, f"{d}:{name}", lambda path: makers[name]()(path), of=f"{d}/documents.parquet")


def graph_tables(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """notes, documents, resolved links, tasks."""
    return vault.notes(s, d), derived(s, d, "documents"), derived(s, d, "links"), derived(s, d, "tasks")


def keyword_index(s: SparkSession, d: str) -> search.Index:
    return search.Index(derived(s, d, "catalog"), derived(s, d, "postings"))


def ranked_index(s: SparkSession, d: str, stemmed: bool = False) -> search.Index:
    """Blocks of words or stems; its postings are those of the blocks."""
    blocks, terms = (derived(s, d, n) for n in (("stem_blocks", "stem_terms") if stemmed else ("blocks", "block_terms")))
    places = derived(s, d, "places")
    return search.Index(derived(s, d, "catalog"), ranked.postings(blocks, places), ranked.Ranked(places, blocks, terms))
