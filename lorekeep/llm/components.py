"""Connected components of a table of links, by alternating large-star and small-star steps.

Each round links every node's larger neighbours to its smallest one, then its smaller ones likewise; the number of rounds
grows with the logarithm of the longest path. Only nodes with links take part. All steps are joins and aggregates; the
table of links is written after each round. A hub with very many links is one side of a plain join, which Spark splits.

Defined cases: loops and repeated links don't matter; null ends are dropped; no links: empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 64) -> DataFrame:
    """id, component (its smallest id) of every node that has a link to another."""
    e = common.written(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    seen = None
    for _ in range(rounds):
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if state == seen or not state[0]:
            return e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionByName(
                e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            )
        seen = state
        # Large star: u, larger than v, is linked to the smallest of v's neighbours (v itself if that is the smallest).
        least = common.written(e.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m")), "least")
        large = e.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        e = common.written(large, "links")
        # Small star: u and its smaller neighbours are linked to the smallest of them.
        least = common.written(e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).where("n > 1").drop("n"), "least")
        small = e.join(least, "u", "left").select(
            F.explode(
                F.array(F.struct("u", F.coalesce("m", "v").alias("v")), F.struct(F.col("v").alias("u"), F.coalesce("m", "v").alias("v")))
            ).alias("x")
        ).select("x.u", "x.v").where("u != v").distinct()
        e = common.written(small, "links")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
