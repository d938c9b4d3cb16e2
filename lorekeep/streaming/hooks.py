"""Session events as streams: nudges, phases marked once, queues."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorekeep.operators import scans, transcripts
from lorekeep.sources import archives, store

FIRST, AGAIN = 20, 15


def nudges(events: DataFrame, first: int = FIRST, again: int = AGAIN) -> DataFrame:
    """Stream of (session_id, count) at which a session without a saved memo is nudged: at `first` events and every `again` after it. events: session_id,
    memo_saved (boolean). State: a count and a flag for each session; what a batch has of a session is counted at once."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, saved = state.get if state.exists else (0, False)
        for frame in frames:
            counts = count + np.arange(1, len(frame) + 1)
            unsaved = ~np.logical_or.accumulate(frame["memo_saved"].fillna(False).to_numpy(bool)) & (not saved)
            fired = counts[unsaved & (counts >= first) & ((counts - first) % again == 0)]
            count, saved = count + len(frame), bool(saved or not unsaved.all())
            yield pd.DataFrame({"session_id": [key[0]] * len(fired), "count": fired})
        state.update((count, saved))

    made = events.select("session_id", "memo_saved").groupBy("session_id")
    return made.applyInPandasWithState(step, "session_id string, count long", "count long, saved boolean", "append", GroupStateTimeout.NoTimeout)


def nudges_batch(events: DataFrame, first: int = FIRST, again: int = AGAIN, *order: str) -> DataFrame:
    """The same over stored events, by their order (ts if none is given; without ties, else these decide at random)."""
    saved = F.coalesce(F.col("memo_saved").cast("int"), F.lit(0))
    e = scans.running(events, ["session_id"], list(order or ("ts",)), {"count": F.lit(1), "saved": saved})
    return e.where((F.col("saved") == 0) & (F.col("count") >= first) & ((F.col("count") - first) % again == 0)).select("session_id", "count")


def phases_once(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Stream of the first mark of each session and phase; state older than the watermark goes."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["session_id", "phase"])


def phases_first(events: DataFrame, *order: str) -> DataFrame:
    """The same over stored events: one aggregate, combined before the shuffle."""
    rest = F.struct(*[c for c in events.columns if c not in ("session_id", "phase")])
    return events.groupBy("session_id", "phase").agg(F.min_by(rest, F.struct(*order)).alias("x")).select("session_id", "phase", "x.*")


def archived(messages: DataFrame, to: str, checkpoint: str) -> StreamingQuery:
    """Stream of ended sessions' messages (session, seq, role, text, ts), whole sessions in a batch: those worth archiving are written as notes below `to`,
    a folder for each batch, which is written again if the batch is."""

    def write(batch: DataFrame, number: int) -> None:
        kept = viable(batch.select(F.col("session").alias("session_id"), "text")).select(F.col("session_id").alias("session"))
        notes = transcripts.notes(transcripts.turns(batch.join(kept, "session", "left_semi")))
        notes.write.mode("overwrite").parquet(f"{to}/batch={number}")

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def queue_state(marks: DataFrame) -> DataFrame:
    """Attempts and latest attempt of each pending session, from an append log."""
    return marks.groupBy("session_id").agg(F.count("*").alias("attempts"), F.max("at").alias("last_attempt"))


def upserted(marks: DataFrame, to: str, checkpoint: str) -> StreamingQuery:
    """Stream of marks (session_id, at) into a queue of pending sessions: attempts and latest attempt of each, a version of the queue for each batch below `to`.
    A batch adds to the version before it, so one that runs again writes the same."""

    def write(batch: DataFrame, number: int) -> None:
        now = queue_state(batch)
        if number:
            before = batch.sparkSession.read.parquet(f"{to}/v={number - 1}")
            both = before.unionByName(now).groupBy("session_id")
            now = both.agg(F.sum("attempts").alias("attempts"), F.max("last_attempt").alias("last_attempt"))
        now.write.mode("overwrite").parquet(f"{to}/v={number}")

    return marks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pending(queue: DataFrame, done: DataFrame) -> DataFrame:
    """path and enqueued_at (its first) of the jobs that aren't done."""
    return queue.join(done.select("path"), "path", "left_anti").groupBy("path").agg(F.min("enqueued_at").alias("enqueued_at"))


def drained(queue: DataFrame, done: DataFrame, most: int) -> DataFrame:
    """The oldest `most` jobs that aren't done, first in first out."""
    return pending(queue, done).orderBy("enqueued_at", "path").limit(most)


def remaining(queue: DataFrame, done: DataFrame, most: int) -> DataFrame:
    """What the queue keeps once the oldest `most` jobs are taken."""
    return pending(queue, done).join(drained(queue, done, most).select("path"), "path", "left_anti")


def enqueued(jobs: DataFrame, root: str) -> None:
    """Appends jobs to the stored queue at root, all of them or none."""
    archives.registered(jobs.sparkSession)
    jobs.write.format(archives.QUEUE).mode("append").save(root)


def stored(spark: SparkSession, root: str, schema: str | None = None) -> DataFrame:
    """The stored queue; a queue that nothing was written to needs a schema."""
    read = archives.registered(spark).read.format(archives.QUEUE)
    return (read.schema(schema) if schema else read).load(root)


def taken(spark: SparkSession, root: str, done: DataFrame, most: int) -> DataFrame:
    """Takes the oldest `most` jobs that aren't done from the stored queue: it is replaced by what remains. Parts of the queue as it was stay readable until archives.swept()."""
    queue = stored(spark, root)
    first = store.written(drained(queue, done, most), "taken")  # what is taken is fixed before the queue changes
    left = pending(queue, done).join(F.broadcast(first.select("path")), "path", "left_anti")  # at most `most` rows
    left.write.format(archives.QUEUE).mode("overwrite").save(root)
    return first


def appended(marks: DataFrame, root: str, checkpoint: str, writer: str = "") -> StreamingQuery:
    """Stream of marks appended to the stored queue at root, each batch once; queue_state(stored()) tells its state."""
    archives.registered(marks.sparkSession)
    out = marks.writeStream.format(archives.QUEUE).option("path", root).option("writer", writer).option("checkpointLocation", checkpoint)
    return out.trigger(availableNow=True).start()


def viable(lines: DataFrame, least: int = 6) -> DataFrame:
    """Sessions worth archiving: enough lines, or a tool in use."""
    return lines.groupBy("session_id").agg(
        F.count("*").alias("lines"),
        F.count_if(F.col("text").contains("tool_use")).alias("tools"),
    ).where((F.col("lines") >= least) | (F.col("tools") > 0))
