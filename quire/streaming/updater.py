"""Updaters as a stream: states held by key, events applied in the order of their times, checks that fall due by timers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quire.functions.shipping import ship
from quire.operators.release import MOVES

#: State stores that stateful processors need.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Updater(StatefulProcessor):
    """Events wait until the watermark has passed them, then move the state in the order of time and id."""

    def __init__(self, every_ms: int | None):
        self.every = every_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # a state and when the next check is due (-1: never)
        self.now = handle.getValueState("now", "state string, due long")
        # by time and id, so that an event that comes twice waits once
        self.waiting = handle.getMapState("waiting", "at long, id string", "event string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for r in rows:
            self.waiting.updateValue((r.at, r.id), (r.event,))
            self.handle.registerTimer(r.at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # everything up to the watermark is known; what is due in between comes in its turn
        until = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        state, due = self.now.get() if self.now.exists() else ("idle", -1)
        ready = sorted((k[0], k[1], v[0]) for k, v in self.waiting.iterator() if k[0] <= until)
        out = []
        for at, i, event in [*ready, (until + 1, None, None)]:
            while 0 <= due < at:
                state = MOVES[state].get("check", state)
                out.append(Row(key=key[0], at=due, id=None, event="due", state=state))
                due += self.every
            if i is None:
                break
            state = MOVES[state].get(event, state)
            out.append(Row(key=key[0], at=at, id=i, event=event, state=state))
            self.waiting.removeKey((at, i))
            if event == "check" and self.every:
                # an attempt, whatever comes of it, puts the next one off
                due = at + self.every
        before = self.now.get()[1] if self.now.exists() else -1
        self.now.update((state, due))
        if due >= 0 and due != before:
            self.handle.registerTimer(due)
        return iter(out)

    def close(self) -> None:
        pass


def updater_stream(events: DataFrame, key: str, ts: str, id: str, event: str, late: str = "1 hour", every: str | None = "24 hours") -> DataFrame:
    """(key, at, id, event, state) of a stream of events: where each updater is after each of them.

    Events up to late out of order are put in order; those later than that are dropped, and repeated ones (key, time,
    id) count once. every: an updater without a check for so long after its last one is checked by itself: an event
    "due" without an id at that time, which moves its state as a check does; None: never. Events wait for the watermark,
    so a state is told late by as much. Null keys are one key; events without a time are left out. The session needs
    PROVIDER.
    """
    spark = events.sparkSession
    ship(spark)
    every_ms = None if every is None else int(spark.sql(f"select unix_millis(timestamp '1970-01-01 00:00:00Z' + interval {every})").first()[0])
    kind = events.schema[key].dataType.simpleString()
    rows = events.where(F.col(ts).isNotNull()).withWatermark(ts, late)
    rows = rows.select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.unix_millis(F.col(ts).cast("timestamp")).alias("at"), F.coalesce(F.col(id).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(event), F.lit("")).alias("event"))
    out = rows.groupBy("key").transformWithState(Updater(every_ms), f"key {kind}, at long, id string, event string, state string", "Append", "EventTime")
    return out.select(F.col("key").alias(key), F.timestamp_millis("at").alias("at"), "id", "event", "state")
