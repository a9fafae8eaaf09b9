import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from siftline.operators.quota import quota_schedule, retry_plan
from siftline.operators.screen import EPOCH

SCHEMA = "quota_key STRING, arrival TIMESTAMP_NTZ, channel_id BIGINT, msg_id BIGINT"


def plain_loop(rows, step_us):
    free, starts = {}, {}
    for key, arrival, channel, msg in sorted(rows):
        at = (arrival - EPOCH) // dt.timedelta(microseconds=1)
        start = max(at, free.get(key, at))
        free[key] = start + step_us
        starts[(key, channel, msg)] = start - at
    return starts


@pytest.mark.parametrize("partitions", [1, 3, 16])
@pytest.mark.parametrize("batch", [7, 10000])
def test_schedule_equals_plain_loop(spark, partitions, batch):
    rng = random.Random(partitions)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(900):
        # One key has most calls, and many of those arrive in the same second.
        key = rng.choice(["hot", "hot", "hot", "b", "c", f"rare{i}"])
        gap = 0 if rng.random() < 0.5 else rng.randrange(4000)
        rows.append((key, base + dt.timedelta(seconds=gap), i % 3, i))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        frame = spark.createDataFrame(rows, SCHEMA)
        got = quota_schedule(frame, rpm=25, partitions=partitions).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {(r.quota_key, r.channel_id, r.msg_id): r.wait_us for r in got} == plain_loop(
        rows, 2_400_000
    )
    assert all(r.start - r.arrival == dt.timedelta(microseconds=r.wait_us) for r in got)


def test_schedule_off(spark):
    frame = spark.createDataFrame([("a", EPOCH, 1, 1), ("a", EPOCH, 1, 2)], SCHEMA)
    assert [r.wait_us for r in quota_schedule(frame, rpm=0).collect()] == [0, 0]


def test_retry_plan(spark):
    rows = [
        (1, 1, 0, 429, "retry in 2s"), (1, 1, 1, 0, None),
        (1, 2, 0, 429, ""), (1, 2, 1, 429, ""), (1, 2, 2, 429, ""), (1, 2, 3, 429, ""),
        (1, 3, 0, 503, "down"),
        (1, 4, 0, 0, None), (1, 4, 1, 429, "never made"),
        (1, 5, 0, 500, "RESOURCE_EXHAUSTED"), (1, 5, 1, 503, "down"),
    ]
    log = spark.createDataFrame(
        rows, "channel_id BIGINT, msg_id BIGINT, attempt INT, code INT, message STRING"
    )
    got = {r.msg_id: (r.calls, r.total_wait_us, r.status) for r in retry_plan(log).collect()}
    second = 1_000_000
    assert got == {
        1: (2, 3 * second, "ok"),
        2: (4, 73 * second, "quota"),
        3: (1, 0, "call_failed"),
        4: (1, 0, "ok"),
        5: (2, 11 * second, "call_failed"),
    }
    assert log.select(F.count("*")).first()[0] == len(rows)
