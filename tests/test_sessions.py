"""Sessions in keyed state: archived once, at their end, however many batches they span."""

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import transcripts
from lorekeep.streaming import hooks, sessions

SCHEMA = "session string, seq long, role string, text string, at long"


@pytest.fixture
def state_store(spark):
    before = spark.conf.get(sessions.PROVIDER, None)
    yield
    spark.conf.set(sessions.PROVIDER, before) if before else spark.conf.unset(sessions.PROVIDER)


def test_a_session_over_batches(spark, tmp_path, state_store):
    of = lambda s, seqs, start: [(s, i, ("user", "assistant")[i % 2], f"t{i}", 100_000 + start + i * 60) for i in seqs]
    batches = [
        of("s1", range(4), 0),  # four lines alone wouldn't be worth archiving
        [*of("s1", range(4, 8), 0)[::-1], *of("s2", range(2), 200)],
        of("s3", range(7), 4000),
        of("late", range(1), 9000),
    ]
    seen = []
    for nth, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in")).withColumn("ts", F.timestamp_seconds("at"))
        query = sessions.archived(stream, str(tmp_path / "out"), str(tmp_path / "ck"), "20 minutes", "1 minute")
        assert query.awaitTermination(180)
        found = list((tmp_path / "out").glob("batch=*"))
        seen.append({r.session for r in spark.read.parquet(str(tmp_path / "out")).select("session").distinct().collect()} if found else set())
    assert seen == [set(), set(), {"s1"}, {"s1", "s3"}]  # s2 is too short, the last one hasn't ended
    notes = spark.read.parquet(str(tmp_path / "out")).where("session = 's1'").orderBy("part").collect()
    whole = spark.createDataFrame(of("s1", range(8), 0), SCHEMA).withColumn("ts", F.timestamp_seconds("at")).drop("at")
    want = transcripts.notes(transcripts.turns(whole)).orderBy("part").collect()
    assert [r.raw for r in notes] == [r.raw for r in want]
    assert hooks.viable(whole.select(F.col("session").alias("session_id"), "text")).count() == 1
