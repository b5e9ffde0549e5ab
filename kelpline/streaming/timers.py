"""Jobs with clocks: leases that run out, completed jobs that are asked for again, records that are forgotten; as a stream with event-time timers and as a batch.

Both read a job's events in the order of their time and apply what falls due in between, so they give the same states. The
stream holds an event back until the watermark has passed it, which is what makes its order that of time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.state import step

#: Seconds until a completed job with missing facts is asked for again, how often that is done, and seconds after which a job that nobody asks for is forgotten.
SWEEP, MOST_REQUESTS, FORGOTTEN = 1800, 8, 168 * 3600
#: What a job's clock shows: its state, when it is swept, when it is forgotten; times are seconds, -1 for none.
STATE = "status string, failures int, requests int, lease double, sweep double, forget double"
OUT = "job_key long, status string, failure_count int, requests int, at double"


def due(own: tuple | None) -> float:
    """When the next thing falls due by itself; infinite for a job without a state."""
    return math.inf if own is None else min((x for x in own[3:] if x >= 0), default=math.inf)


def elapsed(own: tuple, at: float) -> tuple | None:
    """A job after what falls due at `at`: its lease ends, it is swept (asked for again while it was not too often), or it is forgotten."""
    status, failures, requests, lease, sweep, forget = own
    if forget == at:
        return None
    if lease == at:
        return "pending", failures, requests, -1.0, sweep, forget
    if requests < MOST_REQUESTS:
        return "pending", failures, requests + 1, -1.0, -1.0, forget
    return status, failures, requests, lease, -1.0, forget


def after(own: tuple | None, event: str, at: float) -> tuple:
    """A job after an event; "partial" is a completion that leaves facts missing, others as in operators.state."""
    known = None if own is None else (*own[:3], None if own[3] < 0 else own[3])
    status, failures, requests, lease = step(known, "complete" if event == "partial" else event, at)
    sweep = at + SWEEP if event == "partial" and status == "completed" else own[4] if own is not None and status == own[0] == "completed" else -1.0
    return status, failures, requests, -1.0 if lease is None else lease, sweep, at + FORGOTTEN


def advanced(own: tuple | None, until: float) -> Iterator[tuple[tuple | None, float]]:
    """The states that a job goes through by itself up to a time, with their times."""
    while (at := due(own)) <= until:
        own = elapsed(own, at)
        yield own, at


def _row(key: int, own: tuple | None, at: float) -> tuple:
    return (key, "forgotten", None, None, at) if own is None else (key, *own[:3], at)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    made = pd.DataFrame(rows, columns=["job_key", "status", "failure_count", "requests", "at"])
    return made.astype({"job_key": "int64", "failure_count": "Int32", "requests": "Int32", "at": "float64"})


def _events(events: DataFrame) -> DataFrame:
    """job_key, event, t (seconds), seq of the events with a key and a time; a time without zone is one of the session."""
    ts = F.col("ts").cast("timestamp")
    return events.where("job_key is not null and ts is not null").select(F.col("job_key").cast("long").alias("job_key"), F.col("event").cast("string").alias("event"), (F.unix_millis(ts) / 1e3).alias("t"), F.col("seq").cast("long").alias("seq"), ts.alias("ts"))


def timed_states(events: DataFrame, until: str) -> DataFrame:
    """ST4, ST9: each job's state at a time (UTC), and when it was reached, from (job_key, event, ts, seq); a job's rows are read in order, with a state of six values.

    Forgotten jobs have that for their status, and no counts. Events after `until` don't count; those without key or time
    neither; times count in whole milliseconds. An empty table gives no rows.
    """
    end = pd.Timestamp(until, tz="UTC").timestamp()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, own, at, out = None, None, 0.0, []

        def closed() -> None:
            nonlocal own, at
            for own, at in advanced(own, end):
                pass
            if key is not None:
                out.append(_row(key, own, at))

        for batch in batches:
            for k, event, t in zip(batch["job_key"], batch["event"], batch["t"], strict=True):
                if k != key:
                    closed()
                    key, own, at = k, None, 0.0
                for own, at in advanced(own, t):
                    pass
                own, at = after(own, event, t), t
            if len(out) > 10_000:
                yield _frame(out)
                out = []
        closed()
        yield _frame(out)

    rows = _events(events).where(F.col("t") <= end).drop("ts")
    return rows.repartition("job_key").sortWithinPartitions("job_key", "t", "seq").mapInPandas(fold, OUT)


class _Clock(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", STATE)
        self.waiting = handle.getListState("waiting", "t double, seq long, event string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for t, seq, event in zip(batch["t"], batch["seq"], batch["event"], strict=True):
                self.waiting.appendValue((float(t), int(seq), str(event)))
                self.handle.registerTimer(math.ceil(t * 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        own = tuple(self.job.get()) if self.job.exists() else None
        held = sorted(tuple(w) for w in self.waiting.get())
        ready, out = [w for w in held if math.ceil(w[0] * 1000) <= now], []
        for t, _, event in ready:
            for own, at in advanced(own, t):
                out.append(_row(key[0], own, at))
            own = after(own, event, t)
            out.append(_row(key[0], own, t))
        for own, at in advanced(own, now / 1000):
            out.append(_row(key[0], own, at))
        if ready:
            self.waiting.put([w for w in held if w not in ready]) if len(ready) < len(held) else self.waiting.clear()
        if own is None:
            self.job.clear()
        else:
            self.job.update(own)
            if (at := due(own)) < math.inf:
                self.handle.registerTimer(math.ceil(at * 1000))
        if out:
            yield _frame(out)

    def close(self) -> None:
        pass


def timed_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """ST4, ST9 as a stream: every state that a job reaches, from (job_key, event, ts, seq), once the watermark has passed it.

    Events that come later than `late` are dropped. Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    rows = _events(events).withWatermark("ts", late)
    return rows.groupBy("job_key").transformWithStateInPandas(statefulProcessor=_Clock(), outputStructType=OUT, outputMode="append", timeMode="EventTime")
