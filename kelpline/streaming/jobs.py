"""The stateful operators as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.state import step


def live_queue(events: DataFrame) -> DataFrame:
    """ST1 as a stream: each job's state after every batch that has events of it (job_key, event, ts, seq)."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = tuple(state.get) if state.exists else None
        if own is not None:
            own = (own[0], own[1], own[2], None if own[3] < 0 else own[3])
        arrived = pd.concat(list(batches))  # what one trigger brought for one job, in all its chunks
        for event, ts in arrived.sort_values(["t", "seq"])[["event", "t"]].itertuples(index=False):
            own = step(own, event, ts)
        state.update((own[0], own[1], own[2], -1.0 if own[3] is None else own[3]))
        yield pd.DataFrame({"job_key": [key[0]], "status": [own[0]], "failure_count": [own[1]], "requests": [own[2]]})

    rows = events.select("job_key", "event", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "seq")
    return rows.groupBy("job_key").applyInPandasWithState(fold, "job_key long, status string, failure_count int, requests int", "status string, failures int, requests int, lease double", "update", GroupStateTimeout.NoTimeout)


def budget_use(events: DataFrame, kind: str, ts: str, late: str = "1 hour") -> DataFrame:
    """ST3 as a stream: events of each kind and day, closed once no late ones can come."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 day"), kind).agg(F.count("*").alias("n"))


def once(events: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    """ST7 as a stream: the first event of each key."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
