"""Admission limits: a sliding log for each key, and the number in flight."""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def admit(stamps: deque, at: float, most: int, seconds: float) -> bool:
    """Whether an attempt is admitted; rejected attempts leave no stamp."""
    while stamps and stamps[0] <= at - seconds:
        stamps.popleft()
    if len(stamps) >= most:
        return False
    stamps.append(at)
    return True


def sliding_log(attempts: DataFrame, key: str, at: str, order: str, most: int, seconds: float, width: int | None = None) -> DataFrame:
    """``attempts`` with ``admitted``, decided in order of (at, order) for each key; ``at`` is in seconds.

    What is admitted depends on all that was before, so a key is one sequence.
    The rows come sorted from Spark and pass a task as a stream; what it holds
    is at most ``most`` stamps of the key at hand.
    """

    def log():
        stamps: deque = deque()
        return lambda t: admit(stamps, t, most, seconds)

    return _decided(attempts, key, [at], [at, order], log, width)


def _decided(rows: DataFrame, key: str, columns: list[str], order: list[str], decide, width: int | None) -> DataFrame:
    """``rows`` with ``admitted``, a key at a time in order; ``decide()`` makes the state of a key."""
    width = width or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), None
        for frame in frames:
            out = []
            for k, *values in zip(*(frame[c].tolist() for c in (key, *columns))):
                if k != now:
                    now, state = k, decide()
                out.append(state(*values))
            yield frame.assign(admitted=out)

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rows.columns)
    return rows.repartition(width, key).sortWithinPartitions(key, *order).mapInPandas(run, f"{schema}, admitted boolean")


def concurrent(spans: DataFrame, key: str, start: str, end: str, order: str, most: int = 5, width: int | None = None) -> DataFrame:
    """``spans`` with ``admitted``: at most ``most`` admitted ones of a key are open at once.

    A span that ends as another starts has left its slot; rejected ones take none.  A task
    holds the ends of at most ``most`` spans.
    """

    def gauge():
        open_until: list[float] = []

        def decide(at: float, until: float) -> bool:
            while open_until and open_until[0] <= at:
                heapq.heappop(open_until)
            if len(open_until) >= most:
                return False
            heapq.heappush(open_until, until)
            return True

        return decide

    return _decided(spans, key, [start, end], [start, order], gauge, width)


def in_flight(spans: DataFrame, key: str, start: str, end: str, window: float = 86_400.0) -> DataFrame:
    """(key, peak): most spans open at once; a span that ends as another starts is not open with it.

    Instants are summed in windows of ``window``: what is open at a window's start comes from
    the windows' totals, so a key's instants are never sorted as one.
    """
    steps = spans.select(key, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))).alias("s"))
    net = steps.groupBy(key, "s.at").agg(F.sum("s.d").alias("d")).withColumn("_w", F.floor(F.col("at") / window))
    running = F.sum("d").over(Window.partitionBy(key, "_w").orderBy("at"))
    parts = net.withColumn("open", running).groupBy(key, "_w").agg(F.max("open").alias("most"), F.sum("d").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.partitionBy(key).orderBy("_w").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("open", F.col("most") + before).groupBy(key).agg(F.max("open").alias("peak"))
