"""Filter interaction audit: what each of five filters removes in each order, and each filter's share by Shapley values.

Each document gets a mask of the filters that it fails; documents are counted by part and mask (at most 32 rows a part, combined on the map side), and
from these counts the removals of all 32 coalitions of filters are tabulated. Every figure of a step is a difference of coalitions: what a filter removes
after others is the removal of both together less that of the others. The Shapley values are the exact solution of a constrained least squares
problem: over all coalitions but the empty and the full one, weighted by the Shapley kernel, the squared distance of a coalition's removal from the sum of its
members' values is least, under the condition that all values add up to what all filters remove; the normal equations are solved in rationals.

Texts are read once, by built-in functions. Equal texts are told by SHA-256: the smallest doc_id of each digest is an aggregate, and rows are joined with it
by digest and doc_id together, so a text that a third of all rows hold is spread. Nothing else grows with the input but the table of marks, which is written.

Defined cases: null text: empty (0 words, fails A); null lang: part ''; null doc_id: neither repeats nor is repeated, has no labels; rows that repeat both doc_id and text
don't fail E by each other; repeated labels: a 1 in any of them counts, null is not 1; extra columns don't matter; empty table: empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Sequence
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FILTERS = "ABCDE"
SPACES = r"[\x20\x09-\x0D]+"
MEASURES = ("removed", "good", "toxic")


def failures(text: Column) -> Column:
    """Bits of the filters A to D (1, 2, 4, 8) that a text fails."""
    words = F.array_remove(F.split(text, SPACES), "")
    found = F.struct(F.size(words).alias("all"), F.size(F.array_distinct(words)).alias("distinct"), F.regexp_count(text, F.lit("[A-Z]")).alias("capitals"))
    tests = lambda x: (
        x["all"] < 100,
        100 * x["distinct"].cast("long") < 80 * x["all"].cast("long"),
        100 * x["capitals"].cast("long") > 10 * F.length(text).cast("long"),
        text.rlike("[#$%&*|]"),
    )
    # The counts are bound once in the lambda.
    return F.get(F.transform(F.array(found), lambda x: sum(((t.cast("int") * (1 << i)) for i, t in enumerate(tests(x))), F.lit(0))), F.lit(0))


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, part, mask (bits of the filters A to E that it fails), good, toxic of each document."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    marks = rows.select("doc_id", "part", failures(F.col("text")).alias("own"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    marks = common.written(marks, "audit-marks")
    first = marks.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    is_one = lambda c: F.max((F.coalesce(c, F.lit(0)) == 1).cast("int"))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    joined = marks.join(known, "doc_id", "left").join(first, ["digest", "doc_id"], "left")
    repeats = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    return joined.select(
        "doc_id",
        "part",
        (F.col("own") + F.when(repeats, 16).otherwise(0)).alias("mask"),
        F.coalesce("good", F.lit(0)).alias("good"),
        F.coalesce("toxic", F.lit(0)).alias("toxic"),
    )


def coalitions(marks: DataFrame, players: int = len(FILTERS)) -> DataFrame:
    """part, coalition (bits), documents (of the part), and of those that fail any filter of the coalition: removed, good and toxic. All coalitions of each part."""
    by_mask = marks.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    every = by_mask.withColumn("coalition", F.explode(F.sequence(F.lit(0), F.lit((1 << players) - 1))))
    fails = F.col("mask").bitwiseAND(F.col("coalition")) != 0
    of = lambda c: F.sum(F.when(fails, F.col(c)).otherwise(0))
    return every.groupBy("part", "coalition").agg(F.sum("n").alias("documents"), of("n").alias("removed"), of("good").alias("good"), of("toxic").alias("toxic"))


def solved(matrix: Iterable[Sequence[Fraction]], right: Sequence[Fraction]) -> list[Fraction]:
    """The solution of a regular system of linear equations, by elimination in rationals."""
    rows = [[*row, b] for row, b in zip(matrix, right, strict=True)]
    for i in range(len(rows)):
        pivot = next(k for k in range(i, len(rows)) if rows[k][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for k, row in enumerate(rows):
            if k != i and row[i]:
                rows[k] = [x - row[i] * y for x, y in zip(row, rows[i], strict=True)]
    return [row[-1] for row in rows]


def shapley(values: Sequence[int], players: int) -> list[Fraction]:
    """Shapley values of a game, values by coalition (bits): kernel-weighted least squares under the condition that they add up to the full coalition's value."""
    n = players
    normal = [[Fraction(0)] * (n + 1) for _ in range(n + 1)]
    right = [Fraction(0)] * n + [Fraction(values[-1] - values[0])]
    for s in range(1, (1 << n) - 1):
        members = [i for i in range(n) if s >> i & 1]
        weight = Fraction(n - 1, math.comb(n, len(members)) * len(members) * (n - len(members)))
        for i in members:
            right[i] += weight * (values[s] - values[0])
            for j in members:
                normal[i][j] += weight
    for i in range(n):
        normal[i][n] = normal[n][i] = Fraction(1)  # the multiplier of the condition
    return solved(normal, right)[:n]


STEPS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def steps_of(table: pa.Table) -> pa.Table:
    """All steps of all orders in one part, from its coalitions."""
    rows = sorted(table.to_pylist(), key=lambda r: r["coalition"])
    removed, good, toxic = ([r[c] for r in rows] for c in MEASURES)
    documents, n = rows[0]["documents"], len(FILTERS)
    orders = math.factorial(n)
    shares = [x * orders for x in shapley(removed, n)]
    out = []
    for order in itertools.permutations(range(n)):
        before = 0
        for nth, i in enumerate(order, 1):
            after = before | 1 << i
            here = removed[after] - removed[before]
            out.append(
                (
                    rows[0]["part"],
                    "".join(FILTERS[x] for x in order),
                    nth,
                    documents - removed[after],
                    here,
                    removed[1 << i] - here,
                    removed[-1] - removed[~(1 << i) & (1 << n) - 1],
                    good[after] - good[before],
                    toxic[after] - toxic[before],
                    int(shares[i]),
                )
            )
            before = after
    kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
    names = [x.split()[0] for x in STEPS.split(", ")]
    return pa.table({name: pa.array(c, k) for name, c, k in zip(names, zip(*out, strict=True), kinds, strict=True)})


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every part, order of the five filters and step, with its counts and the filter's Shapley value times the number of orders."""
    # A group is the 32 coalitions of a part.
    return coalitions(marked(docs, labels)).groupBy("part").applyInArrow(steps_of, STEPS)


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return audited(docs, common.table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT w.part, [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words), 100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text),
  regexp_matches(text, '[#$%&*|]'), coalesce(w.doc_id > first, false)] AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
t AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS ord FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT ord, x.i AS step, ord[x.i] AS flt, ord[1:x.i - 1] AS before FROM o, x),
r AS (SELECT t.*, s.*, fails[flt] AS own, len(list_filter(before, lambda i: fails[i])) > 0 AS gone, len(list_filter(fails, lambda y: y)) AS many FROM t, s),
g AS (SELECT part, ord, step, flt, sum(CASE WHEN NOT own AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN own AND NOT gone THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN own AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN own AND many = 1 THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN own AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN own AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM r GROUP BY part, ord, step, flt)
SELECT part, array_to_string(list_transform(ord, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed,
  redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, flt))::BIGINT AS shapley FROM g
"""
