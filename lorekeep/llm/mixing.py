"""Mixing sources to target weights.

Words are added up by source, each source gets a target, and each document is emitted floor(target / source size) times
plus once more with the remaining fraction as probability, drawn by a hash of its id and a seed.

Only DataFrame operations. The one shuffle is the aggregate by source, combined on the map side, so a source that holds a
third of all rows is one row of each map task. The table of targets has a row for each source; it is broadcast only if
counted as small, else joined. Sources are numbered and summed up in order by common.numbered, by ranges if they are many.

Defined cases: null or empty text: size 0, still emitted as often as its source's rate says; null source: a source of its
own, last in order; a source without words: target 0, no copies; null or repeated doc_id: allowed, rows of the same id share their
draw; empty table: empty result. Extra columns stay; those named like the added ones (ADDED, copy_no) are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"
ADDED = ("size", "source_size", "target", "copies", "taken")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """sizes: source, source_size. Adds target: all words shared by weight (weights repeat in the order of the sources), none above cap times its size, the excess shared again by weight.

    Sorted by cap / weight the sources that stop at their cap come first. The level of the others is what these leave,
    by the weight that they leave; the first source below its cap at that level sets it.
    """
    by_name = common.numbered(sizes, [F.col("source").asc_nulls_last()])
    picked = F.element_at(F.array(*map(F.lit, weights)), ((F.col("nth") - 1) % len(weights) + 1).cast("int")).cast("long")
    t = by_name.select("source", "source_size", picked.alias("weight"), (F.col("source_size") * cap).alias("most"))
    t = common.written(t, "mix-weights")
    level = (F.col("most") / F.col("weight")).asc()
    t = common.written(common.numbered(t, [level, F.col("source").asc_nulls_last()], ("most", "weight")), "mix-levels")
    every = t.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).head()
    exact = lambda c: c.cast("decimal(19,0)")
    left_words, left_weight = F.lit(every[0]) - F.col("most_before"), F.lit(every[1]) - F.col("weight_before")
    below = exact(F.col("most")) * exact(left_weight).cast("decimal(18,0)") > exact(left_words) * F.col("weight").cast("decimal(18,0)")
    first = t.where(below).agg(F.min(F.struct("nth", left_words.alias("words"), left_weight.alias("weight")))).head()[0]
    most = F.col("most").cast("double")
    if first is None:
        return t.select("source", "source_size", most.alias("target"))
    shared = F.lit(float(first.words)) * F.col("weight") / F.lit(first.weight)
    return t.select("source", "source_size", F.when(F.col("nth") >= first.nth, shared).otherwise(most).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: str = "mix") -> DataFrame:
    """docs (doc_id, text, source and any others) with size, source_size, target, copies and taken (size times copies)."""
    sized = docs.drop(*ADDED).withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    totals = common.written(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    of_source = common.free("of_source", sized)
    goals = common.written(source_targets(totals, weights, cap), "mix-targets").withColumnRenamed("source", of_source)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")), 1, 12)
    draw = F.conv(digits, 16, 10).cast("double") / F.lit(float(16**12))
    mixed = sized.join(common.small_side(goals), F.col("source").eqNullSafe(F.col(of_source)), "inner").drop(of_source)
    copies = F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)
    return mixed.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("size") * F.col("copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """Each row of mix() as often as its copies say, with copy_no from 1 (a column of that name is replaced); rows without copies go, an empty table stays one."""
    return mixed.where(F.col("copies") > 0).withColumn("copy_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, source_size * 3 AS most, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS weight FROM s),
l AS (SELECT *, row_number() OVER o AS nth, sum(source_size) OVER () - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_words,
  sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_weight
  FROM w WINDOW o AS (ORDER BY most / weight, source NULLS LAST)),
f AS (SELECT *, min(CASE WHEN most * left_weight > left_words * weight THEN nth END) OVER () AS first FROM l),
g AS (SELECT *, max(CASE WHEN nth = first THEN left_words END) OVER () AS words, max(CASE WHEN nth = first THEN left_weight END) OVER () AS of_weight FROM f),
t AS (SELECT source, source_size, CASE WHEN nth >= first THEN CAST(words AS DOUBLE) * CAST(weight AS DOUBLE) / CAST(of_weight AS DOUBLE) ELSE CAST(most AS DOUBLE) END AS target FROM g),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
  CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0 AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies FROM r)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM c
"""
