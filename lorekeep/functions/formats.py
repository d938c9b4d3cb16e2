"""Sizes and durations as people read them; ties of the one decimal go to the even digit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_decimal(value: Column, unit: str) -> Column:
    return F.format_string(f"%.1f{unit}", F.bround(value.cast("double"), 1))


def size(of: Column) -> Column:
    """Bytes as 12B, 3.4KB or 5.6MB."""
    return F.when(of < 1 << 10, F.concat(of.cast("string"), F.lit("B"))).when(of < 1 << 20, one_decimal(of / (1 << 10), "KB")).otherwise(one_decimal(of / (1 << 20), "MB"))


def duration(ms: Column) -> Column:
    """Milliseconds as 12.3s or, from a minute on, 4.5m; null or 0: null."""
    return F.when(ms >= 60_000, one_decimal(ms / 60_000, "m")).when(ms > 0, one_decimal(ms / 1000, "s"))


def titled(name: Column, ms: Column) -> Column:
    """A tool's heading, with how long it took if that is known."""
    return F.concat(F.lit("#### Tool: "), name, F.coalesce(F.concat(F.lit(" ("), duration(ms), F.lit(")")), F.lit("")))
