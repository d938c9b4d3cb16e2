"""Queries over positional postings against a plain evaluation of their trees, errors, and what is read."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import fulltext, search
from lorekeep.operators.fulltext import Both, Either, Near, Phrase, Without

COLUMNS = ("content", "title")


def words_of(text):
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def starts(phrase, words):
    def fits(i, w):
        return i < len(words) and (words[i].startswith(w) if phrase.prefix and w is phrase.words[-1] else words[i] == w)

    last = len(phrase.words) - 1
    fits = lambda i, n: i < len(words) and (words[i].startswith(phrase.words[n]) if phrase.prefix and n == last else words[i] == phrase.words[n])
    return [i for i in range(len(words)) if phrase.words and all(fits(i + n, n) for n in range(last + 1))]


def holds(node, doc):
    """By definition, over the words of each column."""
    if isinstance(node, Both):
        return holds(node.left, doc) and holds(node.right, doc)
    if isinstance(node, Either):
        return holds(node.left, doc) or holds(node.right, doc)
    if isinstance(node, Without):
        return holds(node.left, doc) and not holds(node.right, doc)
    for c in node.columns or COLUMNS:
        words = words_of(doc.get(c, ""))
        if isinstance(node, Phrase):
            if starts(node, words):
                return True
        elif any(
            all(p + len(x.words) + node.gap >= max(picked) for p, x in zip(picked, node.phrases, strict=True))
            for picked in itertools.product(*[starts(x, words) for x in node.phrases])
        ):
            return True
    return False


WORDS = "ab abc b cd x yy".split()


def drawn(draw, depth=0):
    kind = draw.random()
    phrase = lambda: draw.choice([draw.choice(WORDS), f'"{" ".join(draw.choices(WORDS, k=draw.randint(1, 3)))}"', draw.choice(WORDS)[0] + "*", f'"{draw.choice(WORDS)} {draw.choice(WORDS)[0]}"*'])
    if depth > 2 or kind < 0.4:
        return draw.choice(["", "", "title:", "content:"]) + phrase()
    if kind < 0.55:
        return draw.choice(["", "title:"]) + f"NEAR({' '.join(phrase() for _ in range(draw.randint(1, 4)))}{draw.choice(['', ', 0', ', 1', ', 3'])})"
    op = draw.choice([" ", " AND ", " OR ", " NOT "])
    made = drawn(draw, depth + 1) + op + drawn(draw, depth + 1)
    return f"({made})" if draw.random() < 0.5 else made


def test_drawn_queries(spark, tmp_path):
    draw = random.Random(8)
    docs = {f"d{i}": {c: " ".join(draw.choices([*WORDS, "A,B", "é-x"], k=draw.randrange(0, 9))) for c in COLUMNS} for i in range(60)}
    made = spark.createDataFrame([(p, d["content"], d["title"]) for p, d in docs.items()], "path string, content string, title string")
    fulltext.write_positions(fulltext.positions(made, *COLUMNS), str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p")).cache()
    queries = [drawn(draw) for _ in range(36)]
    met = 0
    for query in queries:
        tree = fulltext.parse(query, COLUMNS)
        got = {r.path for r in fulltext.matching(stored, query, COLUMNS).collect()}
        want = {p for p, d in docs.items() if holds(tree, d)}
        assert got == want, query
        met += bool(want)
    assert met > 12


@pytest.mark.parametrize(
    "query",
    ["", "  ", "a1 AND", "AND a1", "(a1", "a1)", "a1 OR", "NOT a1", '"a1', "a1,", "c++", "a-b", "NEAR(a1", "NEAR(a1, x)", "NEAR()", "nowhere:a1", "a1 +", "*", "a.b", "(" * 4000 + "a", ":", "title:"],
)
def test_errors_go_to_the_fallback(spark, query):
    with pytest.raises(fulltext.QueryError):
        fulltext.parse(query, COLUMNS)
    docs = spark.createDataFrame([("p", f"x {query} y"), ("q", "zz")], "path string, content string")
    got = search.text_search(search.indexed(docs), fulltext.positions(docs, "content"), docs, query)
    assert {(r.path, r.score) for r in got.collect()} == ({("p", -1.0)} if query.strip() else {("p", -1.0)} | ({("q", -1.0)} if not query else set()))


def test_precedence():
    p = lambda w: Phrase((w,), False, ())
    a, b, c = p("a"), p("b"), p("c")
    assert fulltext.parse("a OR b c") == Either(a, Both(b, c))
    assert fulltext.parse("a NOT b c") == Without(a, Both(b, c))
    assert fulltext.parse("a AND b NOT c") == Both(a, Without(b, c))
    assert fulltext.parse("(a OR b) AND c") == Both(Either(a, b), c)
    assert fulltext.parse("a + b") == Phrase(("a", "b"), False, ())
    assert fulltext.parse("NEAR(a b, 3)") == Near((a, b), 3, ())
    assert fulltext.parse('"and" or OR "x""y"') == Either(Both(p("and"), p("or")), Phrase(("x", "y"), False, ()))


def test_near_of_many_words(spark):
    """Eight words are one pass, not an expression for each order."""
    docs = spark.createDataFrame([("a", "h g f e d c b a"), ("b", "a b c d e f g x x x x h")], "path string, content string")
    stored = fulltext.positions(docs, "content")
    assert [r.path for r in fulltext.matching(stored, "NEAR(a b c d e f g h, 6)").collect()] == ["a"]
    assert {r.path for r in fulltext.matching(stored, "NEAR(a b c d e f g h, 10)").collect()} == {"a", "b"}


def test_scores_and_reads(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", f"alpha w{i} {'beta ' * (i % 3)}") for i in range(200)], "path string, content string")
    fulltext.write_positions(fulltext.positions(docs, "content"), str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    got = {r.path: r.score for r in search.text_search(search.indexed(docs), stored, docs, "alpha NOT beta").collect()}
    assert set(got) == {f"d{i}" for i in range(0, 200, 3)}
    want = {r.path: r.score for r in search.bm25(search.indexed(docs), ["alpha"]).collect()}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)
    plan = fulltext.matching(stored, "alpha be*")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed = next(x for x in plan.splitlines() if "PushedFilters" in x)
    assert "StringStartsWith(term,be)" in pushed and "alpha" in pushed
    fulltext.write_terms(docs.select(F.explode(F.split("content", " ")).alias("term")).groupBy("term").agg(F.count("*").alias("df")), str(tmp_path / "t"))
    assert {r.term for r in spark.read.parquet(str(tmp_path / "t")).where("startswith(term, 'w19')").collect()} == {"w19", *[f"w19{i}" for i in range(10)]}
