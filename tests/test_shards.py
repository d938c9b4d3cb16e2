"""What many keyword searches move: a block once, a text once, equal questions once, and no k documents of every shard."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lorekeep.operators import ranked, search

DOCS, QUERIES = 900, 300


@pytest.fixture(scope="module")
def docs(spark):
    draw = random.Random(7)
    words = ["the"] * 30 + ["of"] * 12 + [f"w{i}" for i in range(300)]
    rows = [(f"d{draw.randrange(10**9):09d}", " ".join(draw.choices(words, k=draw.randrange(1, 60)))) for _ in range(DOCS)]
    rows += [(f"same{i:04d}", "the w1 w2") for i in range(DOCS // 4)]
    return spark.createDataFrame(rows, "path string, content string").repartition(3).cache()


@pytest.fixture(scope="module")
def index(spark, docs):
    """Over 12 shards or so."""
    made = search.indexed(docs)
    made = search.Index(made.catalog.cache(), made.postings.cache())
    return made._replace(ranked=ranked.built(made.catalog, made.postings, 96))


@pytest.fixture(scope="module")
def asked(spark):
    draw = random.Random(9)
    own = [(f"q{i:03d}", draw.choices(["the", "of", "nowhere", *[f"w{i}" for i in range(300)]], k=draw.randrange(1, 8))) for i in range(QUERIES)]
    return spark.createDataFrame([*own, ("none", ["nowhere"]), ("all", ["the", "w1", "w2"])], "query string, terms array<string>").cache()


def scanned(index, asked, k):
    """Every posting of the asked terms scored."""
    asked = asked.select("query", F.explode("terms").alias("term")).distinct()
    df = index.postings.groupBy("term").agg(F.count("*").alias("df"))
    hits = index.postings.join(asked, "term").join(df, "term").crossJoin(search.statistics(index.catalog))
    scored = hits.groupBy("query", "path").agg(F.sum(search.weight(1.2, 0.75)).alias("score"))
    w = Window.partitionBy("query").orderBy(F.round("score", 6).desc(), "path")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def of(df):
    return sorted((r["query"], r["rank"], r["path"], round(r["score"], 6)) for r in df.collect())


@pytest.mark.parametrize("k", [1, 5, 40, 400])
def test_scores_of_the_first_shards_bound_the_others(index, asked, k, monkeypatch):
    """The same rows, with ties of a fifth of all documents; the shards together give on fewer than k each."""
    monkeypatch.setattr(ranked, "HELD", 16)
    assert of(search.bm25_batch(index, asked, k, query_key="query")) == of(scanned(index, asked, k))
    if k == 5:
        terms = asked.select("query", F.explode(F.array_distinct("terms")).alias("term"))
        shards = index.ranked.places.agg(F.max("shard")).head()[0] + 1
        assert shards > 9 and ranked.topk(index.ranked, terms, search.statistics(index.catalog), k).count() < 0.6 * k * shards * QUERIES


def test_blocks_are_moved_once(spark, index, asked):
    """However many tasks there are: no stage shuffles more rows than there are blocks, packs and questions."""
    terms = asked.select("query", F.explode(F.array_distinct("terms")).alias("term"))
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    list_of = lambda seq: [seq.apply(i) for i in range(seq.size())]
    seen = {s.stageId() for s in list_of(stages())}
    tasks = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        ranked.topk(index.ranked, terms, search.statistics(index.catalog), 3).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
    moved = [s.shuffleWriteRecords() for s in list_of(stages()) if s.stageId() not in seen]
    assert 0 < max(moved) <= index.ranked.blocks.count() + 2 * QUERIES


def test_equal_questions_are_searched_once(index, asked, monkeypatch):
    searched, topk = [], ranked.topk
    monkeypatch.setattr(ranked, "topk", lambda by, asked, *a: searched.append(asked.select("query").distinct().count()) or topk(by, asked, *a))
    twice = asked.unionByName(asked.select(F.concat(F.lit("again-"), "query").alias("query"), F.reverse("terms").alias("terms")))
    got = of(search.bm25_batch(index, twice, 5, query_key="query"))
    assert got == of(scanned(index, twice, 5)) and searched[0] <= QUERIES + 2


def test_texts_are_moved_once(spark, docs, index):
    """Also where their numbers are too many to be sent to every task."""
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = search.text_blocks(docs, index.ranked.places)
        plan = made._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert len(re.findall(r"Exchange ", plan)) == 1
    numbers = lambda df: {(r.shard, r.term, d, t, n) for r in df.collect() for d, t, n in zip(r.docs, r.tf, r.length, strict=True)}
    assert numbers(made) == numbers(index.ranked.blocks)


def test_shards_grow_until_they_are_full():
    assert [ranked.size(n, 24) for n in (10, 24_000, 240_000, 10**7)] == [1_024, 1_024, 10_000, ranked.SHARD]


def test_no_document_reaches_the_floor():
    import numpy as np

    docs = np.arange(0, 64, 2)
    x = ranked.List(docs[:0], docs[:0], docs[:0], docs[:0], docs, np.ones(32, int), np.full(32, 9))
    shard = ranked.Shard({"a": x, "b": x}, ranked.Weights(9.0, 1.2, 0.75), 64)
    parts = [shard.part("a", 2.0), shard.part("b", 1.0)]
    assert [len(shard.best(parts, 3, floor)[0]) for floor in (0.0, 3.0, 3.1)] == [3, 3, 0] and shard.best([], 3)[2] == 0
