"""State machines over event logs: rows of a key are read in order, with a state of fixed size, never a whole group."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Seconds of a lease, failures after which a job isn't tried again.
LEASE, RETRIES = 900, 10
#: What an event does: enqueue, claim, complete, fail, requeue, ignore.
JOB = "job_key long, status string, failure_count int, requests int, claim_expires double"


def step(state: tuple | None, event: str, ts: float) -> tuple:
    """(status, failures, requests, lease end) after an event (MG6 to MG14)."""
    status, failures, requests, lease = state or ("new", 0, 0, None)
    if status == "processing" and lease is not None and lease <= ts:
        status, lease = "pending", None  # the lease ran out
    if event == "enqueue":
        requests += 1
        if status in ("new", "failed"):
            status, failures = "pending", 0
    elif event == "claim" and status == "pending":
        status, lease = "processing", ts + LEASE
    elif event == "complete" and status == "processing":
        status, lease = "completed", None
    elif event == "fail" and status == "processing":
        failures += 1
        status, lease = ("pending" if failures < RETRIES else "failed"), None
    elif event == "requeue" and status != "ignored":
        status, failures, lease = "pending", 0, None
    elif event == "ignore":
        status, lease = "ignored", None
    return status, failures, requests, lease


def queue_fold(events: DataFrame) -> DataFrame:
    """ST1: the last state of each job from (job_key, event, ts, seq); a key's state is four values."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            out = []
            for k, event, ts in zip(batch["job_key"], batch["event"], batch["t"], strict=True):
                if k != key:
                    if state is not None:
                        out.append((key, *state))
                    key, state = k, None
                state = step(state, event, ts)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in JOB.split(", ")])
        if state is not None:
            yield pd.DataFrame([(key, *state)], columns=[c.split()[0] for c in JOB.split(", ")])

    rows = events.where("job_key is not null").select("job_key", "event", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"), "seq")
    rows = rows.select("job_key", "event", (F.col("us") / 1e6).alias("t"), "seq")
    return rows.repartition("job_key").sortWithinPartitions("job_key", "t", "seq").mapInPandas(fold, JOB)


def limited(events: DataFrame, key: str, ts: str, seq: str, limit: int, window: float) -> DataFrame:
    """ST2: (seq, allowed): at most `limit` accepted events of a key within `window` seconds; rejected ones don't count.

    A key's state is its last `limit` accepted times. limit 0 allows everything.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, hits = None, deque()
        for batch in batches:
            allowed = []
            for k, t in zip(batch["k"], batch["t"], strict=True):
                if k != own:
                    own, hits = k, deque()
                while hits and hits[0] < t - window:
                    hits.popleft()
                ok = limit <= 0 or len(hits) < limit
                if ok and limit > 0:
                    hits.append(t)
                allowed.append(ok)
            yield pd.DataFrame({"seq": batch["seq"], "allowed": allowed})

    rows = events.select(F.col(key).cast("long").alias("k"), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("t"), F.col(seq).cast("long").alias("seq"))
    return rows.where("k is not null").repartition("k").sortWithinPartitions("k", "t", "seq").mapInPandas(fold, "seq long, allowed boolean")


def daily_budget(events: DataFrame, kind: str, ts: str, seq: str, cap: int) -> DataFrame:
    """ST3, AG37: the first `cap` events of each kind and UTC day."""
    day = F.to_date(F.col(ts))
    rank = F.row_number().over(W.partitionBy(kind, "day").orderBy(ts, seq))
    return events.withColumn("day", day).withColumn("used", rank).where(F.col("used") <= cap).withColumn("used", F.col("used").cast("long"))
