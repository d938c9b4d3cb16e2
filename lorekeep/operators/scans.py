"""Running values over keys of any size, as a prefix scan in two levels.

Rows are dealt by ranges of (key, order), so a key that holds a third of all rows is many ranges. Each range is summed up by itself; a row for each range and key says what stands before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.sources import store


def running(df: DataFrame, key: list[str], order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """df with running values by key, in an order without ties: sums up to and with each row (nulls are 0), and lasts, the last value that isn't null of the rows before."""
    sums, lasts = sums or {}, lasts or {}
    own = {f"_{name}": value for name, value in (sums | lasts).items()}
    dealt = df.withColumns(own).repartitionByRange(*key, *order).withColumn("_range", F.spark_partition_id())
    dealt = store.written(dealt, "scan")
    within = Window.partitionBy("_range", *key).orderBy(*order)
    up_to, before = within.rowsBetween(Window.unboundedPreceding, Window.currentRow), within.rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumns({n: F.sum(f"_{n}").over(up_to) for n in sums} | {n: F.last(f"_{n}", ignorenulls=True).over(before) for n in lasts})
    place = F.struct(*order)
    totals = [F.sum(f"_{n}").alias(n) for n in sums] + [F.max_by(f"_{n}", F.when(F.col(f"_{n}").isNotNull(), place)).alias(n) for n in lasts]
    per = dealt.groupBy("_range", *key).agg(*totals)
    ranges = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a key
    ahead = [F.sum(n).over(ranges).alias(f"_ahead_{n}") for n in sums] + [F.last(n, ignorenulls=True).over(ranges).alias(f"_ahead_{n}") for n in lasts]
    moved = per.select(F.col("_range").alias("_of"), *[F.col(k).alias(f"_key_{k}") for k in key], *ahead)
    same = F.col("_range") == F.col("_of")
    for k in key:
        same &= F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    joined = inside.join(store.small_side(moved), same)
    made = {n: F.coalesce(f"_ahead_{n}", F.lit(0)) + F.coalesce(n, F.lit(0)) for n in sums} | {n: F.coalesce(n, f"_ahead_{n}") for n in lasts}
    return joined.select(*df.columns, *[c.alias(n) for n, c in made.items()])
