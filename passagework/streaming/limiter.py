"""The sliding-log limiter over a stream of attempts."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.limits import admit


def limited(attempts: DataFrame, key: str, at: str, most: int, seconds: float, idle_ms: int = 3_600_000) -> DataFrame:
    """(key, at, admitted) for a stream of attempts; ``at`` is in seconds.

    Attempts of a batch are decided in order of time; the state of a key is at
    most ``most`` stamps, and is dropped after ``idle_ms`` without an attempt.
    A key's attempts of one batch meet in one task: bound a batch by the source's
    limits (``maxFilesPerTrigger``, ``maxBytesPerTrigger``).  With the trigger
    ``availableNow``, turn ``spark.sql.streaming.noDataMicroBatches.enabled`` off,
    or batches for timeouts follow each other without end.
    """
    kind = attempts.schema[key].dataType.simpleString()

    def decide(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        stamps = deque(state.get[0]) if state.exists else deque()
        rows = pd.concat(list(frames)).sort_values("at")
        rows["admitted"] = [admit(stamps, t, most, seconds) for t in rows["at"]]
        state.update((list(stamps),))
        state.setTimeoutDuration(idle_ms)
        yield rows[["key", "at", "admitted"]]

    given = attempts.select(F.col(key).alias("key"), F.col(at).cast("double").alias("at"))
    return given.groupBy("key").applyInPandasWithState(decide, f"key {kind}, at double, admitted boolean", "stamps array<double>", "append", "ProcessingTimeTimeout")
