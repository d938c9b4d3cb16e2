"""Running values in two levels against windows, on hot and null keys, and the session operators that use them."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lorekeep.operators import scans, transcripts
from lorekeep.sources import store


def messages(spark, n=600):
    """A third of all rows in one session, a session without a name, nulls in every value."""
    draw = random.Random(9)
    rows = [
        (draw.choice(["hot", "hot", "a", "b", None, f"s{i}"]), i, draw.choice(["user", "assistant", "assistant", "system"]), draw.choice([None, "", "x", "yy"]), draw.choice([None, None, "p", "q"]), draw.choice([None, True, False, False, False]))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "session string, seq long, role string, text string, agent string, compact boolean").repartition(5)


@pytest.fixture(params=["true", "false"])
def many(request, spark):
    """With all ranges in a task, and with each in its own."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", request.param)
    yield request.param == "false"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def rows(df):
    return sorted(map(str, df.collect()))


def test_running_equals_windows(spark, many, monkeypatch):
    m, ranges = messages(spark), []
    keep = store.written
    monkeypatch.setattr(store, "written", lambda df, name: (ranges.append(keep(df, name)), ranges[-1])[1])
    got = scans.running(m, ["session"], ["seq"], {"chars": F.length("text"), "nth": F.lit(1)}, {"agent_before": F.col("agent")})
    w = Window.partitionBy("session").orderBy("seq")
    up_to = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = m.select(
        "*",
        F.coalesce(F.sum(F.length("text")).over(up_to), F.lit(0)).alias("chars"),
        F.count("*").over(up_to).alias("nth"),
        F.last("agent", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("agent_before"),
    )
    assert rows(got.withColumn("chars", F.coalesce("chars", F.lit(0)))) == rows(want)
    if many:
        assert ranges[0].where("session = 'hot'").select("_range").distinct().count() > 1
    assert scans.running(m.limit(0), ["session"], ["seq"], {"nth": F.lit(1)}).count() == 0


def test_turns_and_marks_equal_windows(spark, many):
    m = messages(spark)
    said = m.where(~F.col("role").isin(*transcripts.SKIPPED) & (F.coalesce("text", F.lit("")) != ""))
    w = Window.partitionBy("session").orderBy("seq")
    up_to = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turn = lambda begins: F.greatest(F.lit(1), F.sum(F.when(begins, 1).otherwise(0)).over(up_to)).cast("int")
    assert rows(transcripts.turns(m)) == rows(said.withColumn("turn", turn(F.col("role") == "user")))
    before = F.last("agent", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    other = F.col("agent").isNotNull() & before.isNotNull() & (F.col("agent") != before)
    want = said.withColumn("marker", F.when(F.coalesce("compact", F.lit(False)), "compaction").when(other, "agent"))
    assert rows(transcripts.marked(m)) == rows(want.withColumn("turn", turn(F.col("marker").isNotNull() | (F.col("role") == "user"))))


def test_repeated_messages(spark):
    data = [("k", 1, "t", "ab"), ("k", 2, "t", "abcd"), ("k", 3, "t", "wxyz"), ("k", 4, None, "n"), ("k", 5, None, "n"), ("l", 6, "t", None), (None, 7, "t", "z"), (None, 8, "t", "zz")]
    m = spark.createDataFrame(data, "id string, seq long, ts string, text string")
    got = sorted((r.seq, r.text) for r in transcripts.deduplicated(m, ["id", "ts"]).collect())
    assert got == [(1, "abcd"), (4, "n"), (5, "n"), (6, None), (7, "zz")]
