"""Queries that can't be parsed, and what is made for them."""

from lorekeep.operators import fulltext, search
from lorekeep.plans.queries import QUERIES
from lorekeep.sources import store


def test_fallback_makes_no_index(spark):
    """A query that can't be parsed needs neither postings nor positions."""

    def never():
        raise AssertionError

    docs = spark.createDataFrame([("a", "The end, the END"), ("b", ""), ("c", None)], "path string, content string")
    got = search.text_search(never, never, docs, "end,").collect()
    assert [(r.path, r.score) for r in got] == [("a", -1.0)]
    assert {r.path for r in search.text_search(lambda: search.indexed(docs), lambda: fulltext.positions(docs, "content"), docs, '"the end"').collect()} == {"a"}


def test_fallback_query_stores_nothing(spark, small, monkeypatch):
    made = []
    monkeypatch.setattr(store, "kept", lambda *a, **_: made.append(a))
    assert QUERIES["like_fallback"](spark, small).count() > 0 and not made
