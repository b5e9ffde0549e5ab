"""Streams against their batches: late events, timers, a restart from the checkpoint; a batch that is run again."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from kelpline.streaming import timers

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def _log(n, seed, hours=10):
    rng = random.Random(seed)
    return [(rng.randrange(9), rng.choice(["enqueue", "claim", "claim", "complete", "partial", "fail", "requeue"]), START + dt.timedelta(seconds=rng.randrange(hours * 3600)), i) for i in range(n)]


SCHEMA = "job_key long, event string, ts timestamp, seq long"


def plain(log, until):
    """States by walking over all times second by second is the same as jumping to what falls due."""
    out = {}
    for key in {r[0] for r in log}:
        own, at = None, 0.0
        for _, event, ts, _ in sorted((r for r in log if r[0] == key and r[2] <= until), key=lambda r: (r[2], r[3])):
            t = ts.timestamp()
            while own is not None:
                times = [(own["forget"], 0), (own["lease"], 1), (own["sweep"], 2)]
                when, what = min((x for x in times if x[0] is not None), default=(None, 0))
                if when is None or when > t:
                    break
                own, at = _fall(own, what), when
            own, at = _take(own, event, t), t
        t = until.timestamp()
        while own is not None:
            when, what = min((x for x in [(own["forget"], 0), (own["lease"], 1), (own["sweep"], 2)] if x[0] is not None), default=(None, 0))
            if when is None or when > t:
                break
            own, at = _fall(own, what), when
        out[key] = (("forgotten", None, None, at) if own is None else (own["status"], own["failures"], own["requests"], at))
    return out


def _fall(own, what):
    if what == 0:
        return None
    if what == 1:
        return own | {"status": "pending", "lease": None}
    return own | {"sweep": None} | ({"status": "pending", "requests": own["requests"] + 1} if own["requests"] < 8 else {})


def _take(own, event, t):
    own = dict(own or {"status": "new", "failures": 0, "requests": 0, "lease": None, "sweep": None})
    was = own["status"]
    if event == "enqueue":
        own["requests"] += 1
        if was in ("new", "failed"):
            own |= {"status": "pending", "failures": 0}
    elif event == "claim" and was == "pending":
        own |= {"status": "processing", "lease": t + 900}
    elif event in ("complete", "partial") and was == "processing":
        own |= {"status": "completed", "lease": None, "sweep": t + 1800 if event == "partial" else None}
    elif event == "partial" and was == "completed":
        own["sweep"] = t + 1800
    elif event == "fail" and was == "processing":
        own |= {"failures": own["failures"] + 1, "status": "pending" if own["failures"] + 1 < 10 else "failed", "lease": None}
    elif event == "requeue":
        own |= {"status": "pending", "failures": 0, "lease": None}
    if own["status"] != "completed":
        own["sweep"] = None
    return own | {"forget": t + 168 * 3600}


@pytest.mark.parametrize("until", [dt.timedelta(hours=9), dt.timedelta(days=5), dt.timedelta(days=9)])
def test_timed_states(spark, until):
    log = _log(400, 1)
    end = START + until
    rows = spark.createDataFrame([*log, (None, "claim", START, 900), (3, "claim", None, 901)], SCHEMA)
    got = {r["job_key"]: (r["status"], r["failure_count"], r["requests"], r["at"]) for r in timers.timed_states(rows, end.strftime("%Y-%m-%d %H:%M:%S")).collect()}
    assert got == plain(log, end)
    assert timers.timed_states(rows.limit(0), "2024-01-02").collect() == []


def test_timed_stream(spark, tmp_path):
    """Out of order within the delay, restarted from the checkpoint twice: the same states as the batch's."""
    log = sorted(_log(200, 2), key=lambda r: r[2] + dt.timedelta(seconds=random.Random(r[3]).randrange(500)))
    closing = [(99, "enqueue", START + dt.timedelta(days=d), 1000 + d) for d in (3, 4, 5)]
    parts = [log[:70], log[70:140], log[140:], *[[c] for c in closing]]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, name = str(tmp_path / "in"), f"t{uuid.uuid4().hex}"
    out = []
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = timers.timed_stream(spark.readStream.schema(SCHEMA).parquet(source))
        query = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "checkpoint")).foreachBatch(lambda df, i: out.extend(df.collect())).trigger(availableNow=True).start()
        query.awaitTermination()
    last = {}
    for r in out:
        if r["at"] >= last.get(r["job_key"], (0,))[0]:
            last[r["job_key"]] = (r["at"], r["status"], r["failure_count"], r["requests"])
    want = plain(log, START + dt.timedelta(days=4))
    assert {k: v for k, v in last.items() if k != 99} == {k: (v[3], *v[:3]) for k, v in want.items()}
    assert len({(r["job_key"], r["at"], r["status"], r["requests"], r["failure_count"]) for r in out}) <= len(out)


def test_timed_jobs_of_events(spark):
    """The query on all events equals the plain walk."""
    from kelpline.plans.jobs import timed_jobs

    sf = "/root/testdata/sf0.001"
    names = {"view": "enqueue", "click": "claim", "signup": "complete", "purchase": "partial"}
    log = [(r["user_id"], names.get(r["event_type"], "fail"), r["ts"].replace(microsecond=r["ts"].microsecond // 1000 * 1000, tzinfo=dt.timezone.utc), r["event_id"]) for r in spark.read.parquet(f"{sf}/events.parquet").collect()]
    want = plain(log, dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc))
    got = {r["job_key"]: (r["status"], r["failure_count"], r["requests"], r["at"]) for r in timed_jobs(spark, sf).collect()}
    assert got.keys() == want.keys()
    for k, (status, failures, requests, at) in want.items():
        assert got[k][:3] == (status, failures, requests) and abs(got[k][3] - at) < 2e-3
