"""The life of a document as a state machine over its status events."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: From a status (None: nothing is known yet) to those that may follow; a failed document may be uploaded again.
MOVES = {
    None: ("Uploaded",),
    "Uploaded": ("Extracting", "Failed"),
    "Extracting": ("Graphing", "Failed"),
    "Graphing": ("Ready", "Failed"),
    "Ready": (),
    "Failed": ("Uploaded",),
}
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Keys of the state.  Each costs its task calls to the state store, whatever its rows; documents have an event or two in a batch, so many share a key.
BUCKETS = 4096
OUT = "document_id string, round long, seq int, status string, reason string, verdict string, current string"


def judged(events: list[tuple[int, int, str]], last: tuple[int, int] | None, current: str | None) -> Iterator[tuple[str, tuple[int, int] | None, str | None]]:
    """(verdict, last accepted place, status) of each event (round, seq, status), in the order given.

    ``repeated`` is an event at the place accepted last with the status accepted there, ``late`` any other that is
    not after it, ``illegal`` a move that the life of a document does not have; none of these changes anything.
    """
    for r, s, status in events:
        place = (r, s)
        if last is not None and place <= last:
            verdict = "repeated" if place == last and status == current else "late"
        elif status not in MOVES.get(current, ()):
            verdict = "illegal"
        else:
            verdict, last, current = "accepted", place, status
        yield verdict, last, current


class Lives(StatefulProcessor):
    """State of the documents of a bucket: the place and status accepted last of each; events of a batch go by document and place."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.states = handle.getMapState("lives", "document_id string", "round long, seq int, status string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        out = Row("document_id", "round", "seq", "status", "reason", "verdict", "current")
        columns = itemgetter("document_id", "round", "seq", "status", "reason")
        events = sorted((columns(r) for r in rows), key=lambda e: (e[0] is not None, e[0] or "", e[1], e[2], e[3] or ""))
        known = self.states.exists()
        for document, given in groupby(events, itemgetter(0)):
            given = list(given)
            now = self.states.getValue((document,)) if known else None
            last, current = ((now[0], now[1]), now[2]) if now else (None, None)
            before = last
            for event, (verdict, last, current) in zip(given, judged([e[1:4] for e in given], last, current)):
                yield out(*event, verdict, current)
            if last != before:
                self.states.updateValue((document,), (*last, current))

    def close(self) -> None:
        pass


def lives(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Each event (document_id, round, seq, status, reason) of a stream with its verdict and the status that the document then has.

    Events may come in any order and more than once; ``ttl_ms`` bounds how long a document that is heard of no
    more is remembered (its next event is then judged as its first).  Null places count as 0.  The events of a batch in one of
    ``BUCKETS`` are sorted in a task: bound a batch by the source's limits.  The session
    needs ``spark.sql.streaming.stateStore.providerClass`` = ``ROCKS``.
    """
    given = events.select(F.col("document_id").cast("string").alias("document_id"), F.coalesce(F.col("round").cast("long"), F.lit(0)).alias("round"), F.coalesce(F.col("seq").cast("int"), F.lit(0)).alias("seq"), "status", "reason")
    given = given.withColumn("bucket", F.pmod(F.xxhash64("document_id"), F.lit(BUCKETS)).cast("int"))
    return given.groupBy("bucket").transformWithState(statefulProcessor=Lives(ttl_ms), outputStructType=OUT, outputMode="Append", timeMode="None" if ttl_ms is None else "ProcessingTime")
