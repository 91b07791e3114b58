"""Edits of running texts as a stream whose state is bounded in time.

An edit waits, in a map by its sequence number, until the watermark has passed its time: by
then all that may come before it has come, so edits that arrive out of order are put in order, and one
that comes twice is one.  Edits behind the watermark, and those at or before the last one applied, are late
and passed over.  A document that is idle for longer than ``idle_ms`` after its last edit gives
up its state; what comes later starts from an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.edit import apply_edit

RESULT = "doc_id long, seq long, text string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Replay(StatefulProcessor):
    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done = handle.getValueState("done", "text string, last long, until long")
        self.waiting = handle.getMapState("waiting", "seq long", "at long, op string, start long, end long, piece string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.done.get()[1] if self.done.exists() else None
        now = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            for seq, at, op, start, end, piece in zip(frame["seq"].tolist(), frame["at_ms"].tolist(), frame["op"], frame["start"].tolist(), frame["end"].tolist(), frame["piece"]):
                if (last is None or seq > last) and at >= now and not self.waiting.containsKey((seq,)):
                    self.waiting.updateValue((seq,), (at, op, start, end, piece))
                    self.handle.registerTimer(max(at - 1, 1))
        yield pd.DataFrame({"doc_id": [], "seq": [], "text": []}).astype({"doc_id": "int64", "seq": "int64", "text": "object"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        text, last, until = self.done.get() if self.done.exists() else ("", -1, 0)
        due = sorted((k[0], v) for k, v in self.waiting.iterator() if v[0] <= now)
        for seq, (at, op, start, end, piece) in due:
            if seq > last:
                text, last, until = apply_edit(text, op, start, end, piece or ""), seq, max(until, at + self.idle_ms)
            self.waiting.removeKey((seq,))
        if due:
            self.done.update((text, last, until))
            self.handle.registerTimer(until)
            yield pd.DataFrame({"doc_id": [key[0]], "seq": [last], "text": [text]})
        elif self.done.exists() and until <= now and not any(True for _ in self.waiting.iterator()):
            self.done.clear()


def replayed(edits: DataFrame, delay: str = "10 minutes", idle_ms: int = 86_400_000) -> DataFrame:
    """(doc_id, seq, text) whenever the watermark, ``delay`` behind the latest time seen, lets edits (doc_id, seq, at, op, start, end, piece) take place; at: timestamp."""
    timed = edits.withWatermark("at", delay).withColumn("at_ms", F.unix_millis("at"))
    return timed.groupBy("doc_id").transformWithStateInPandas(Replay(idle_ms), StructType.fromDDL(RESULT), "Append", "EventTime")


def with_state_store(spark: SparkSession) -> SparkSession:
    """State by key and map needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark
