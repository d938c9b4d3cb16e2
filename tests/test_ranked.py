"""Block-skipping keyword search against a scan of all postings."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lorekeep.operators import ranked, search
from lorekeep.plans import registry


def archive(spark, n, seed=1):
    draw = random.Random(seed)
    words = ["the"] * 30 + ["of"] * 12 + [f"w{i}" for i in range(60)]
    rows = [(f"d{draw.randrange(10**9):09d}", " ".join(draw.choices(words, k=draw.randrange(1, 60)))) for _ in range(n)]
    return spark.createDataFrame([*rows, *[(f"same{i:04d}", "the w1 w2") for i in range(n // 4)]], "path string, content string")


def scanned(index, asked, k):
    """Every posting of the asked terms scored."""
    asked = asked.select("query", F.explode("terms").alias("term")).distinct()
    df = index.postings.groupBy("term").agg(F.count("*").alias("df"))
    hits = index.postings.join(asked, "term").join(df, "term").crossJoin(search.statistics(index.catalog))
    scored = hits.groupBy("query", "path").agg(F.sum(search.weight(1.2, 0.75)).alias("score"))
    w = Window.partitionBy("query").orderBy(F.round("score", 6).desc(), "path")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


@pytest.mark.parametrize("shard", [128, 16_384])
def test_best_of_many(spark, shard):
    """Over one shard and over several, with ties of a quarter of all documents, unknown words and queries without a document."""
    docs = archive(spark, 700)
    index = search.indexed(docs)
    index = search.Index(index.catalog.cache(), index.postings.cache())
    draw = random.Random(5)
    asked = [(f"q{i}", draw.choices(["the", "of", "nowhere", *[f"w{i}" for i in range(60)]], k=draw.randrange(1, 6))) for i in range(80)]
    asked = spark.createDataFrame([*asked, ("none", ["nowhere"]), ("all", ["the", "w1", "w2"])], "query string, terms array<string>")
    index = index._replace(ranked=ranked.built(index.catalog, index.postings, shard))
    of = lambda df: sorted((r["query"], r["rank"], r["path"], round(r["score"], 6)) for r in df.collect())
    for k in (1, 5, 50):
        assert of(search.bm25_batch(index, asked, k, query_key="query")) == of(scanned(index, asked, k))
    assert search.bm25_batch(index, asked.limit(0), 5, query_key="query").count() == 0
    empty = search.Index(index.catalog.limit(0), index.postings.limit(0))
    assert search.bm25_batch(empty, asked, 5, query_key="query").count() == 0


def made(docs, tf, length):
    """A term's list in blocks."""
    ranges, first = np.unique(docs // ranked.RANGE, return_index=True)
    ends = np.append(first, len(docs))
    of = lambda f, x: np.array([f(x[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)])
    return ranked.List(ranges, of(max, tf), of(min, length), ends, docs, tf, length)


def test_common_words_are_skipped():
    """As the documents grow in number, the postings read of a common word, asked beside a rare one, grow slower than its document frequency."""
    draw = np.random.default_rng(3)
    reads = []
    for n in (1_000, 4_000, 16_000):
        rare, docs = (np.sort(draw.choice(n, x, replace=False)) for x in (40, n * 3 // 4))
        rare = made(rare, np.ones(40, int), np.full(40, 20))
        common = made(docs, draw.integers(1, 4, len(docs)), draw.integers(10, 80, len(docs)))
        weights = ranked.Weights(40.0, 1.2, 0.75)
        found, scores, read = ranked.best([("rare", 5.0), ("common", 0.4)], {"rare": rare, "common": common}, weights, 10)
        every = np.zeros(n)
        for x, idf in ((rare, 5.0), (common, 0.4)):
            every[x.docs] += idf * weights.of(x.tf, x.length)
        assert found.tolist() == np.lexsort((np.arange(n), -np.round(every, 6)))[:10].tolist() and np.allclose(scores, every[found])
        reads.append((read, len(docs)))
    (r1, d1), _, (r3, d3) = reads
    assert r3 / r1 < 0.5 * d3 / d1 and r3 < 0.15 * d3


def test_blocks_are_read_by_term(spark, small):
    """Only the asked terms' rows reach the search."""
    index = registry.ranked_index(spark, small)
    asked = spark.createDataFrame([(1, ["thing"])], "query long, terms array<string>").select("query", F.explode("terms").alias("term"))
    found = ranked.topk(index.ranked, asked, search.statistics(index.catalog), 3)
    df = index.ranked.terms.where("term = 'thing'").head()
    assert sum(r.read for r in found.groupBy("shard").agg(F.max("read").alias("read")).collect()) <= (df.df if df else 0)
