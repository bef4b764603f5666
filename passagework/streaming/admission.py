"""Admission as state of a stream: a sliding log of each key, and a gauge of what is in flight.

Both decide an event when its batch comes, in order of time inside a batch, and give what the batch forms
of ``operators.limits`` give if the batches come in order of time.  The session needs
``spark.sql.streaming.stateStore.providerClass`` = ``status.ROCKS``.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.limits import admit


class SlidingLog(StatefulProcessor):
    """At most ``most`` admitted stamps of a key; a timer drops the key when the watermark has passed the last one's window."""

    def __init__(self, most: int, seconds: float):
        self.most, self.seconds = most, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.log = handle.getValueState("log", "stamps array<double>, until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        stamps, until = self.log.get() if self.log.exists() else ([], None)
        stamps = deque(stamps)
        for row in sorted(rows, key=lambda r: (r["at"], r["id"])):
            yield Row(key=key[0], id=row["id"], at=row["at"], admitted=admit(stamps, row["at"], self.most, self.seconds))
        if not stamps:
            return
        if until is not None:
            self.handle.deleteTimer(until)
        until = int((stamps[-1] + self.seconds) * 1000) + 1
        self.handle.registerTimer(until)
        self.log.update((list(stamps), until))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.log.clear()
        return iter(())

    def close(self) -> None:
        pass


def sliding_log(attempts: DataFrame, key: str, at: str, order: str, most: int, seconds: float, delay: str = "1 minute") -> DataFrame:
    """(key, id, at, admitted) of a stream of attempts; ``at`` is a timestamp, ``order`` tells attempts of one instant apart.

    What comes more than ``delay`` behind the newest attempt is not decided; a key is forgotten ``delay`` after its window.
    Null times are not decided.
    """
    kinds = {c: attempts.schema[c].dataType.simpleString() for c in (key, order)}
    given = attempts.where(F.col(at).isNotNull()).select(F.col(key).alias("key"), F.col(order).alias("id"), F.col(at).cast("timestamp").alias("_ts")).withWatermark("_ts", delay)
    given = given.withColumn("at", F.unix_micros("_ts") / 1e6)
    return given.groupBy("key").transformWithState(statefulProcessor=SlidingLog(most, seconds), outputStructType=f"key {kinds[key]}, id {kinds[order]}, at double, admitted boolean", outputMode="Append", timeMode="EventTime")


class Gauge(StatefulProcessor):
    """Ids that hold a slot of a key, at most ``most``; a slot whose end is lost is free after ``ttl_ms``."""

    def __init__(self, most: int, ttl_ms: int):
        self.most, self.ttl_ms = most, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "id string", "at double", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = {k[0] for k in self.held.keys()}
        held = dict.fromkeys(before)
        # at one instant slots are freed before they are taken
        for row in sorted(rows, key=lambda r: (r["at"], r["kind"] != "end", r["id"])):
            slot = str(row["id"])
            if row["kind"] == "end":
                held.pop(slot, None)
                continue
            free = len(held) < self.most
            if free and slot not in held:
                held[slot] = row["at"]
            yield Row(key=key[0], id=row["id"], at=row["at"], admitted=free)
        # a slot that is freed in the batch that took it never comes to the store
        for slot in before - held.keys():
            self.held.removeKey((slot,))
        for slot, at in held.items():
            if at is not None:
                self.held.updateValue((slot,), (at,))

    def close(self) -> None:
        pass


def gauge(events: DataFrame, key: str, order: str, kind: str, at: str, most: int = 5, ttl_ms: int = 3_600_000) -> DataFrame:
    """(key, id, at, admitted) of the starts in a stream of ``start`` and ``end`` events; ``at`` is in seconds.

    An end of what was not admitted, or is not known, changes nothing; null times and kinds take no part.  With the trigger
    ``availableNow``, turn ``spark.sql.streaming.noDataMicroBatches.enabled`` off.
    """
    kinds = {c: events.schema[c].dataType.simpleString() for c in (key, order)}
    given = events.where(F.col(kind).isin("start", "end") & F.col(at).isNotNull()).select(F.col(key).alias("key"), F.col(order).alias("id"), F.col(kind).alias("kind"), F.col(at).cast("double").alias("at"))
    return given.groupBy("key").transformWithState(statefulProcessor=Gauge(most, ttl_ms), outputStructType=f"key {kinds[key]}, id {kinds[order]}, at double, admitted boolean", outputMode="Append", timeMode="ProcessingTime")
