"""Sessions that end: messages kept in keyed state until a session has been silent for a while, by event time.

The state of a session is a list that grows batch by batch, and one timer, moved on with each later message. When the watermark passes the timer the messages are given on together and the state goes,
so a session that spans batches is archived once. Needs the RocksDB state store, which keeps lists outside the memory of the workers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from lorekeep.operators import transcripts
from lorekeep.streaming import hooks

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a frame that an ended session is given on in.
FRAME = 10_000


class Ended(StatefulProcessor):
    """Keeps a session's messages (seq, role, text, ms) and gives them on once nothing came for `silence` milliseconds of event time."""

    def __init__(self, silence: int) -> None:
        self.silence = silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("messages", "seq long, role string, text string, ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = 0
        for frame in rows:
            last = max(last, int(frame["ms"].max()))
            self.kept.appendList([(int(a), b, c, int(d)) for a, b, c, d in frame[["seq", "role", "text", "ms"]].itertuples(index=False)])
        timers = list(self.handle.listTimers())
        if not timers or max(timers) < last + self.silence:
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(last + self.silence)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held: list[tuple] = []
        for row in self.kept.get():
            held.append((key[0], *row))
            if len(held) == FRAME:
                yield self.frame(held)
                held = []
        if held:
            yield self.frame(held)
        self.kept.clear()

    @staticmethod
    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["session", "seq", "role", "text", "ms"])

    def close(self) -> None:
        pass


def ended(messages: DataFrame, silence: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Stream of the messages (session, seq, role, text, ts) of ended sessions, each session once and whole in a batch, in no order. A message that comes after its session's end begins another."""
    spark = SparkSession.active()
    spark.conf.set(PROVIDER, ROCKS)
    ms = int(pd.Timedelta(silence).total_seconds() * 1000)
    rows = messages.withColumn("ms", F.unix_millis("ts")).withWatermark("ts", delay).groupBy("session")
    kind = messages.schema["session"].dataType.simpleString()
    out = rows.transformWithStateInPandas(Ended(ms), f"session {kind}, seq long, role string, text string, ms long", "Append", "EventTime")
    return out.select("session", "seq", "role", "text", F.timestamp_millis("ms").alias("ts"))


def archived(messages: DataFrame, to: str, checkpoint: str, silence: str = "30 minutes", delay: str = "10 minutes") -> StreamingQuery:
    """Ended sessions worth archiving as notes below `to`; a session may span any number of batches."""
    return hooks.archived(ended(messages, silence, delay), to, checkpoint)
