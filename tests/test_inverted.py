"""Postings, positions and blocks counted in the documents' rows against plain counts, and what is shuffled for them."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorekeep.functions.words import stem
from lorekeep.operators import fulltext, inverted, ranked, search

TEXTS = {"a": "The end, the END; café été", "b": "", "c": None, "d": " -- ", "e": "connected connections x1 2024", "f": "naïve\nlines\tthe", "g": "İstanbul ﬁne"}


@pytest.fixture(scope="module")
def docs(spark):
    draw = random.Random(4)
    more = {f"m{i:03d}": " ".join(draw.choices([f"w{i}" for i in range(40)], k=draw.randrange(0, 60))) for i in range(300)}
    return spark.createDataFrame([(p, t, f"doc-{p}") for p, t in (TEXTS | more).items()], "path string, content string, title string").repartition(3).cache()


def words(text):
    return re.sub(r"[\W_]+", " ", text or "").lower().split()


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    return re.findall(r"Exchange (\w+)", plan)


def test_postings_move_no_words(spark, docs):
    made = search.postings(docs)
    got = {(r.term, r.path): (r.tf, r.length) for r in made.collect()}
    known = {r.path: words(r.content) for r in docs.collect() if r.path != "g"}
    want = {(w, p): (n, len(ws)) for p, ws in known.items() for w, n in Counter(ws).items()}
    assert {k: v for k, v in got.items() if k[1] != "g"} == want
    assert made.count() == len(got) and exchanges(made) == []
    assert exchanges(search.postings(inverted.dealt(docs))) == ["hashpartitioning"]  # texts, once


def test_stemmed_postings(docs):
    got = {(r.term, r.path): r.tf for r in search.postings(docs.where("path < 'g'"), stemmed=True).collect()}
    plain = str.maketrans("éï", "ei")
    want = Counter((stem(w), p) for p, t in TEXTS.items() if p < "g" for w in words((t or "").translate(plain)))
    assert got == want and got["connect", "e"] == 2
    assert exchanges(search.postings(docs, stemmed=True)) == []


def test_positions_move_no_words(docs):
    made = fulltext.positions(docs, "content", "title")
    got = {(r.term, r.path, r.column): r.positions for r in made.collect() if r.path != "g"}
    want = {}
    for r in docs.collect():
        for c in ("content", "title"):
            for i, w in enumerate(words(r[c]) if r.path != "g" else ()):
                want.setdefault((w, r.path, c), []).append(i)
    assert got == want and exchanges(made) == []


def test_blocks_of_texts(spark, docs):
    """Those of postings, whether a term has a row or several in a shard; only texts are shuffled."""
    placed = ranked.places(ranked.numbered(search.catalog(docs)).cache(), shard=100).cache()
    of = lambda df: {(r.shard, r.term) for r in df.collect()}
    one, other = ranked.blocks(search.postings(docs), placed).cache(), search.text_blocks(docs, placed).cache()
    assert of(one) == of(other)
    half = lambda k: F.struct(*[F.filter(c, lambda _, i: i % 2 == k).alias(c) for c in ("docs", "tf", "length")])
    cut = other.select("shard", "term", F.explode(F.array(half(0), half(1))).alias("x"))
    cut = cut.select("shard", "term", "x.*").where(F.size("docs") > 0)
    for shard in range(4):
        a, b, c = (ranked.lists(df.where(F.col("shard") == shard).drop("shard").toArrow()) for df in (one, other, cut))
        assert a.keys() == b.keys() == c.keys()
        for t in a:
            assert all(np.array_equal(x, y) and np.array_equal(x, z) for x, y, z in zip(a[t], b[t], c[t], strict=True))
    df = {r.term: r.df for r in ranked.block_terms(cut).collect()}
    assert df == {r.term: r.df for r in ranked.terms(search.postings(docs)).collect()}
    back = ranked.postings(cut, placed)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, search.postings(docs).collect()))
    assert sum(x == "hashpartitioning" for x in exchanges(search.text_blocks(docs, placed))) <= 3


def test_parts_grow_with_documents():
    assert [inverted.parts(n, 24) for n in (0, 1, 300, 10_000, 10**6)] == [1, 1, 2, 24, 245]
