"""Keyword, vector and fused search."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from lorekeep.functions.words import folded, stems
from lorekeep.operators import fulltext, inverted, ranked
from lorekeep.sources import store

#: Words that a keyword query leaves out.
STOPWORDS = (
    "why", "what", "how", "when", "where", "who", "which",
    "did", "do", "does", "is", "are", "was", "were", "have", "has", "had",
    "can", "could", "would", "should", "will", "shall", "be", "been", "being",
    "get", "got", "make", "made", "go", "went",
    "we", "you", "i", "they", "he", "she", "it", "me", "us", "them",
    "the", "a", "an", "of", "to", "for", "with", "on", "at", "by", "from",
    "in", "out", "about", "into", "through", "during", "before", "after",
    "that", "this", "these", "those", "there", "here",
)


def keywords(query: str, most: int = 7) -> list[str]:
    words = re.sub(r"[^\w\s]", " ", query.lower()).split()
    kept = [w for w in words if w not in STOPWORDS and len(w) > 2] or [w for w in words if len(w) > 2][:5] or [query]
    return kept[:most]


def keywords_of(text: Column, most: int = 7) -> Column:
    """The same for a column of queries, as an array."""
    words = F.filter(F.split(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", " ")), r"\s+"), lambda w: F.length(w) > 2)
    return F.slice(F.filter(words, lambda w: ~w.isin(*STOPWORDS)), 1, most)


WORDS, BETWEEN = r"[\p{L}\p{N}]+", r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased words; empty ones at the ends of the text."""
    return F.split(F.lower(F.regexp_replace(text, BETWEEN, " ")), " ")


def length(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORDS))


def spaced(text: Column) -> Column:
    """Lower-cased words, each between two spaces of its own."""
    return F.concat(F.lit(" "), F.lower(F.regexp_replace(text, BETWEEN, "  ")), F.lit(" "))


def occurrences(words: Column, term: str) -> Column:
    """How often the term stands among spaced() words: by string functions, which stay in generated code."""
    return ((F.length(words) - F.length(F.replace(words, F.lit(f" {term} "), F.lit("")))) / (len(term) + 2)).cast("long")


class Index(NamedTuple):
    """What a keyword search reads: a row for each document, and a row for each of its words."""

    catalog: DataFrame  # path, title, type, project, date, length
    postings: DataFrame  # term, path, tf, length; stored by term in parts of documents
    ranked: ranked.Ranked | None = None  # the same in blocks, for many queries; made anew for each search if it isn't stored


def text_of(docs: DataFrame, stemmed: bool) -> Column:
    return folded(F.col("content")) if stemmed else F.col("content")


def catalog(docs: DataFrame) -> DataFrame:
    """path, title, type, project, date (those that docs has) and the number of words of each document."""
    return docs.select("path", *[c for c in ("title", "type", "project", "date") if c in docs.columns], length(F.col("content")).alias("length"))


def joined(text: Column) -> Column:
    """Lower-cased words between single spaces."""
    return F.lower(F.regexp_replace(text, BETWEEN, " "))


def postings(docs: DataFrame, stemmed: bool = False) -> DataFrame:
    """term, path, tf, length: the inverted index of docs, in which a path stands once. stemmed: terms are stems of words without accents."""
    return inverted.postings(docs, joined(text_of(docs, stemmed)), stemmed)


def write_postings(made: DataFrame, to: str) -> None:
    """Each task's postings sorted by term, in small row groups, so a search reads those of its terms only, and a hot term is in many files. made: of documents that are dealt (inverted.dealt)."""
    made.sortWithinPartitions("term", "path").write.option("parquet.block.size", 8 << 20).parquet(to)


def text_blocks(docs: DataFrame, placed: DataFrame, stemmed: bool = False) -> DataFrame:
    """ranked.text_blocks() of the words that postings() has."""
    return ranked.text_blocks(docs.select("path", "content"), joined(text_of(docs, stemmed)), placed, stemmed)


def indexed(docs: DataFrame, stemmed: bool = False) -> Index:
    """An index that isn't stored: made anew for each search."""
    return Index(catalog(docs), postings(docs, stemmed))


def weight(k1: float, b: float) -> Column:
    """A posting's part of the score, from tf, length, df, n and avg."""
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    return idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avg")))


def statistics(catalog: DataFrame) -> DataFrame:
    return F.broadcast(catalog.agg(F.count("*").alias("n"), F.avg("length").alias("avg")))  # one row


def bm25(index: Index, terms: list[str], among: Column | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """path, score of each document that has one of the terms. Reads the terms' postings only; among narrows the documents, and the statistics to them."""
    terms = list(dict.fromkeys(terms))
    hits = index.postings.where(F.col("term").isin(*terms))
    known = index.catalog
    if among is not None:
        known = known.where(among)
        hits = hits.join(known.select("path"), "path", "left_semi")
    df = F.broadcast(hits.groupBy("term").agg(F.count("*").alias("df")))  # a row for each term
    return hits.join(df, "term").crossJoin(statistics(known)).groupBy("path").agg(F.sum(weight(k1, b)).alias("score"))


def bm25_scan(docs: DataFrame, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The same without an index: one pass over the texts for the statistics, a second for the scores; no rows for each word."""
    terms = list(dict.fromkeys(terms))
    # The spaced text is bound once in the lambda, and the generator keeps Spark from inlining it into each use of a count.
    found = lambda w: F.struct(length(w).alias("length"), *[occurrences(w, x).alias(f"tf{i}") for i, x in enumerate(terms)])
    counts = F.transform(F.array(spaced(F.col("content"))), found)
    tf = docs.select("path", F.explode(counts).alias("c")).select("path", "c.*")
    of = range(len(terms))
    stats = tf.agg(F.count("*").alias("n"), F.avg("length").alias("avg"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in of])
    hits = tf.where(sum((F.col(f"tf{i}") for i in of), F.lit(0)) > 0).crossJoin(F.broadcast(stats))  # one row of statistics
    rows = F.array(*[F.struct(F.col(f"tf{i}").alias("tf"), F.col(f"df{i}").alias("df")) for i in of])
    each = hits.select("path", "length", "n", "avg", F.explode(rows).alias("x")).select("path", "length", "n", "avg", "x.tf", "x.df").where("tf > 0")
    return each.groupBy("path").agg(F.sum(weight(k1, b)).alias("score"))


def bm25_batch(index: Index, queries: DataFrame, k: int, query_key: str = "item_id", k1: float = 1.2, b: float = 0.75, stemmed: bool = False) -> DataFrame:
    """Best k documents of each query (query_key, terms), with score and rank, by blocks of postings that are skipped where their bound is too low."""
    asked = queries.select(F.col(query_key).alias("query"), F.explode(F.array_distinct("terms")).alias("term"))
    if stemmed:
        asked = asked.withColumn("term", stems(folded(F.col("term")))).distinct()
    by = index.ranked or ranked.built(index.catalog, index.postings)
    sets = store.written(asked.groupBy("query").agg(F.sort_array(F.collect_set("term")).alias("terms")), "sets")
    firsts = sets.groupBy("terms").agg(F.min("query").alias("first"))  # one query of those that ask the same is searched
    found = ranked.topk(by, firsts.select(F.col("first").alias("query"), F.explode("terms").alias("term")), statistics(index.catalog), k, k1, b)
    best = ranked.merged(found, by, k).withColumnRenamed("query", "first")
    return sets.join(firsts, "terms").select("query", "first").join(best, "first").drop("first").withColumnRenamed("query", query_key)


#: Words of a title that a keyword query would read as operators.
RESERVED = ("and", "or", "not", "near")


def related(index: Index, asking: DataFrame, most: int = 5) -> DataFrame:
    """path, rank, related for each asking note (path, title): of the best most + 2 other documents by the title's first eight words of three letters or more, those that aren't transcripts."""
    words = F.filter(F.regexp_extract_all(F.lower("title"), F.lit("[a-z]{3,}"), F.lit(0)), lambda w: ~w.isin(*RESERVED))
    q = asking.select(F.col("path").alias("asks"), F.slice(words, 1, 8).alias("terms"))
    near = bm25_batch(index, q, most + 3, query_key="asks").where("asks <> path")
    w = Window.partitionBy("asks").orderBy("rank")
    near = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most + 2)
    kept = near.join(index.catalog.where("type <> 'transcript'").select("path"), "path", "left_semi")
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select(
        F.col("asks").alias("path"),
        "rank",
        F.col("path").alias("related"),
    )


def matches(docs: DataFrame, query: str, *columns: str) -> DataFrame:
    """Documents that a query of words, "phrases", word*, column:, NEAR(a b, n), AND, OR, NOT and parentheses holds for; see fulltext.Parser. For stored documents use fulltext.matching."""
    return docs.join(fulltext.matching(fulltext.positions(docs, *(columns or ("content",))), query, columns or ("content",)), "path", "left_semi")


def text_search(
    index: Index | Callable[[], Index], stored: DataFrame | Callable[[], DataFrame], docs: DataFrame, query: str, columns: tuple[str, ...] = ("content",)
) -> DataFrame:
    """path, score, snippet of the documents that a query holds for, scored by its words; a query that can't be parsed is looked for as it is.

    docs gives the first characters only; stored: fulltext.positions of the documents. Both it and the index may be functions, called only if the query is one that needs them.
    """
    try:
        tree = fulltext.parse(query, columns)
    except fulltext.QueryError:
        return contains(docs, query).select("path", "score", "snippet")
    index, stored = index() if callable(index) else index, stored() if callable(stored) else stored
    found = fulltext.matching(stored, query, columns)
    words = [w for p in fulltext.phrases(tree, wanted=True) for i, w in enumerate(p.words) if not (p.prefix and i == len(p.words) - 1)]
    scored = found.join(bm25(index, words), "path", "left") if words else found.withColumn("score", F.lit(None).cast("double"))
    scored = scored.withColumn("score", F.coalesce("score", F.lit(0.0)))
    return scored.join(docs.select("path", F.left("content", F.lit(200)).alias("snippet")), "path")


def contains(docs: DataFrame, text: str, column: str = "content") -> DataFrame:
    """Fallback for queries that can't be parsed: plain substring, letter case ignored, score -1."""
    return docs.where(F.lower(column).contains(text.lower())).withColumn("score", F.lit(-1.0)).withColumn("snippet", F.left(column, F.lit(200)))


def nearest_many(
    chunks: DataFrame,
    queries: list[tuple[int, list[float]]],
    k: int,
    metric: str = "l2",
    vec: str = "embedding",
    key: str = "vec_id",
) -> DataFrame:
    """query, the columns of chunks but vec, distance: the exact k nearest chunks of each query (number, vector), ties by key.

    The distances of an Arrow batch are one product with the queries' matrix; a batch gives on no more than its k nearest and their ties, and a
    window merges these.
    """
    q = np.array([v for _, v in queries], np.float64).reshape(len(queries), -1)
    names = np.array([n for n, _ in queries], np.int64)
    rest = [f for f in chunks.schema.fields if f.name != vec]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.and_(batch[vec].is_valid(), pc.equal(pc.list_value_length(batch[vec]), q.shape[1])))
            if not len(batch):
                continue
            x = batch[vec].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1)
            if metric == "cosine":
                d = np.stack([1 - (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum()) for y in q])
            else:
                d = np.stack([np.sqrt(((x - y) ** 2).sum(1)) for y in q])
            last = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if k < d.shape[1] else np.full((len(q), 1), np.inf)
            which, row = np.nonzero(d <= last + 1e-8)
            out = batch.select([f.name for f in rest]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(names[which]), *out.columns, pa.array(d[which, row])], names=["query", *out.schema.names, "distance"])

    near = chunks.select(*[f.name for f in rest], vec).mapInArrow(
        run,
        StructType([StructField("query", LongType()), *rest, StructField("distance", DoubleType())]),
    )
    if len(queries) == 1:
        return near.orderBy(F.round("distance", 9), key).limit(k)
    w = Window.partitionBy("query").orderBy(F.round("distance", 9), key)
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(chunks: DataFrame, query: list[float], k: int, metric: str = "l2", vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Exact k nearest chunks with their distance."""
    return nearest_many(chunks, [(0, query)], k, metric, vec, key).drop("query")


def nearest_of_all(
    chunks: DataFrame,
    queries: DataFrame,
    k: int,
    vec: str = "embedding",
    key: str = "vec_id",
    query: str = "query",
    block: int = 1024,
    part: int = 65_536,
) -> DataFrame:
    """query, key, distance, rank: the exact k nearest chunks of each row of queries (query, v), ties by key: blocks of queries against parts of the chunks.

    A product tells which rows may be among the nearest, differences tell the distance of these.
    """
    n, m = chunks.count(), queries.count()
    parts, blocks = max(1, -(-n // part)), max(1, -(-m // block))
    of = lambda c, size: F.pmod(F.xxhash64(c), F.lit(size)).cast("int")
    every = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    dealt = chunks.select(F.col(key).alias("key"), F.col(vec).alias("v"), of(key, parts).alias("p")).withColumn("b", every(blocks))
    asked = queries.select(F.col(query).alias("query"), F.col("v"), of(query, blocks).alias("b")).withColumn("p", every(parts))
    fields = pa.schema([("query", pa.int64()), ("key", pa.int64()), ("distance", pa.float64())])

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)

    def compare(rows: pa.Table, these: pa.Table) -> pa.Table:
        if not rows.num_rows or not these.num_rows:
            return fields.empty_table()
        x, q = matrix(rows["v"]), matrix(these["v"])
        keys, names, out = rows["key"].to_numpy(), these["query"].to_numpy(), []
        for at in range(0, len(q), 64):
            y = q[at : at + 64]
            d = (y * y).sum(1)[:, None] + (x * x).sum(1) - 2 * (y @ x.T)
            last = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if k < len(x) else np.full((len(y), 1), np.inf)
            i, j = np.nonzero(d <= last + 1e-6 * (1 + np.abs(last)))
            out.append((names[at + i], keys[j], np.sqrt(((x[j] - y[i]) ** 2).sum(1))))
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], schema=fields)

    near = dealt.groupBy("p", "b").cogroup(asked.groupBy("p", "b")).applyInArrow(compare, "query long, key long, distance double")
    w = Window.partitionBy("query").orderBy(F.round("distance", 9), "key")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumnRenamed("key", key)


def best_chunk(found: DataFrame, doc: str = "path", key: str = "vec_id") -> DataFrame:
    return found.withColumn("nth", F.row_number().over(Window.partitionBy(doc).orderBy(F.round("distance", 9), key))).where("nth = 1").drop("nth")


def normalized(scores: DataFrame) -> DataFrame:
    """score scaled to 0..1 by the extremes of a bounded result list; all 0.5 if they differ by less than 0.1."""
    w = Window.partitionBy()
    low, high = F.min("score").over(w), F.max("score").over(w)
    return scores.withColumn("score", F.when(high - low < 0.1, 0.5).otherwise((F.col("score") - low) / (high - low)))


def rrf(words: DataFrame, vectors: DataFrame, k: int = 60, key: str = "path") -> DataFrame:
    """Reciprocal-rank fusion of two bounded lists (key, score) and (key, distance)."""
    a = words.select(key, (F.row_number().over(Window.orderBy(F.round("score", 6).desc(), key)) - 1).alias("word_rank"))
    b = vectors.select(key, (F.row_number().over(Window.orderBy(F.round("distance", 9), key)) - 1).alias("vector_rank"))
    one = lambda c: F.coalesce(F.lit(1.0) / (k + 1 + F.col(c)), F.lit(0.0))
    return a.join(b, key, "full_outer").select(
        key,
        (one("word_rank") + one("vector_rank")).alias("score"),
        kind("word_rank", "vector_rank").alias("match_type"),
    )


def kind(a: str, b: str) -> Column:
    return F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), "hybrid").when(F.col(a).isNull(), "vector_only").otherwise("fts_only")


def linear(words: DataFrame, vectors: DataFrame, w_vector: float = 0.7, w_word: float = 0.3, key: str = "path") -> DataFrame:
    """Weighted sum where both lists have the document, else the single score as it is."""
    a = normalized(words).select(key, F.col("score").alias("w"))
    b = vectors.select(key, (1 - F.col("distance") / 2).alias("v"))
    both = F.col("v") * w_vector + F.col("w") * w_word
    return a.join(b, key, "full_outer").select(
        key,
        F.when(F.col("w").isNotNull() & F.col("v").isNotNull(), both).otherwise(F.coalesce("v", "w")).alias("score"),
        kind("w", "v").alias("match_type"),
    )


def diverse(found: DataFrame, most: int, limit: int, key: str = "path") -> DataFrame:
    """At most `most` rows of one document (the part of the key before #)."""
    w = Window.partitionBy(F.substring_index(key, "#", 1)).orderBy(F.round("score", 9).desc(), key)
    return found.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most).drop("nth").orderBy(F.round("score", 9).desc(), key).limit(limit)


def hybrid(
    index: Index,
    chunks: DataFrame,
    query: str,
    vector: list[float],
    limit: int = 20,
    scoring: str = "rrf",
    mode: str = "hybrid",
    metric: str = "l2",
    **filters: str | None,
) -> DataFrame:
    """path, score, match_type, title, type, project of the best documents. Each side gives three times the limit; type, project and since narrow the word side before and the vector side after its top list."""
    tests = [
        F.col(c) == v for c, v in filters.items() if v is not None and c != "since"
    ] + ([F.col("date") >= filters["since"]] if filters.get("since") else [])
    among = functools.reduce(lambda a, b: a & b, tests) if tests else None
    words = bm25(index, keywords(query), among).orderBy(F.round("score", 6).desc(), "path").limit(3 * limit)
    vectors = best_chunk(nearest(chunks, vector, 3 * limit, metric)).select("path", "distance")
    if tests:
        vectors = vectors.join(index.catalog.where(among).select("path"), "path", "left_semi")
    if mode != "hybrid":
        words, vectors = (words, vectors.limit(0)) if mode == "fts" else (words.limit(0), vectors)
    fused = rrf(words, vectors) if scoring == "rrf" else linear(words, vectors)
    top = diverse(fused, 3, limit)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    named = top.join(index.catalog.select("path", "title", "type", "project"), "path", "left")
    return named.select(
        "path",
        "score",
        "match_type",
        F.coalesce("title", stem).alias("title"),
        F.coalesce("type", F.lit("unknown")).alias("type"),
        F.coalesce("project", F.lit("")).alias("project"),
    )


def displayed(found: DataFrame, scoring: str = "rrf") -> DataFrame:
    """found (path, score, match_type) with vector_score and keyword_score as a result list shows them: where ranks were fused, 0.5 for each side that has the document, else 0."""
    side = lambda *kinds: F.when(F.col("match_type").isin(*kinds), 0.5 if scoring == "rrf" else F.col("score")).otherwise(0.0)
    return found.withColumn("vector_score", side("hybrid", "vector_only")).withColumn("keyword_score", side("hybrid", "fts_only"))


def as_json(found: DataFrame, *columns: str) -> DataFrame:
    """path and json: each result as a JSON object, numbers rounded to four places."""
    rounded = [F.round(c, 4).alias(c) if t in ("double", "float") else F.col(c) for c, t in found.dtypes if not columns or c in columns]
    return found.select("path", F.to_json(F.struct(*rounded)).alias("json"))


def as_text(found: DataFrame) -> DataFrame:
    """path and line: each result (path, score, match_type, title) as a line of text."""
    return found.select("path", F.format_string("%.4f  %-11s  %s (%s)", "score", "match_type", "title", "path").alias("line"))


def best_windows(docs: DataFrame, terms: list[str], width: int = 50) -> DataFrame:
    """path, snippet: of each document the first window of `width` words that holds the most words which are terms, terms between >>> and <<<; the start if there is none."""
    bare = lambda w: F.lower(F.regexp_replace(w, BETWEEN, ""))
    listed = docs.select("path", F.filter(F.split("content", r"\s+"), lambda w: w != "").alias("words"))
    each = listed.select("path", F.posexplode("words").alias("at", "word")).withColumn("hit", bare(F.col("word")).isin(*terms).cast("int"))
    ahead = Window.partitionBy("path").orderBy("at").rowsBetween(0, width - 1)
    counted = each.withColumn("hits", F.sum("hit").over(ahead))
    best = counted.groupBy("path").agg(F.max_by("at", F.struct("hits", -F.col("at"))).alias("at"))
    shown = F.transform(
        F.slice("words", F.col("at") + 1, F.lit(width)),
        lambda w: F.when(bare(w).isin(*terms), F.concat(F.lit(">>>"), w, F.lit("<<<"))).otherwise(w),
    )
    before, after = F.when(F.col("at") > 0, "...").otherwise(""), F.when(F.col("at") + width < F.size("words"), "...").otherwise("")
    found = listed.join(best, "path", "left").withColumn("at", F.coalesce("at", F.lit(0)))
    return found.select("path", F.concat(before, F.array_join(shown, " "), after).alias("snippet"))
