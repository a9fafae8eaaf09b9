"""Request quota: when each call may start, and what retries cost."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from siftline import constants as K
from siftline.functions.quota import is_quota_error, retry_wait_us
from siftline.session import cut_lineage

MINUTE_US = 60_000_000


class _RunningStarts:
    """Start times of one sorted partition, batch by batch.

    The start of call k of a key is ``k * step + max(arrival_j - j * step)``
    over ``j <= k``. Between batches only the open key's rank and maximum stay.
    """

    def __init__(self, step: int) -> None:
        self.step, self.key, self.rank, self.peak = step, None, 0, None

    def resume(self, key, rank: int, peak: int) -> None:
        self.key, self.rank, self.peak = key, rank, peak

    def feed(self, keys: pd.Series, arrivals: np.ndarray):
        """Ranks, running maxima and key-start flags of a batch."""
        first = keys.ne(keys.shift()).to_numpy()
        goes_on = self.key is not None and keys.iloc[0] == self.key
        segment = first.cumsum() - 1
        rank = np.arange(len(keys)) - np.flatnonzero(first)[segment]
        if goes_on:
            first[0] = False
            rank = rank + np.where(segment == 0, self.rank, 0)
        slack = pd.Series(arrivals - rank * self.step)
        if goes_on:
            slack.iloc[0] = max(slack.iloc[0], self.peak)
        peak = slack.groupby(segment).cummax().to_numpy()
        self.key, self.rank, self.peak = keys.iloc[-1], int(rank[-1]) + 1, int(peak[-1])
        return rank, peak, first


def _micros(moments: pd.Series) -> np.ndarray:
    return moments.to_numpy().astype("datetime64[us]").astype(np.int64)


def _edge_keys(key: str, arrival: str, step: int):
    """Per partition, count and peak of its first and its last key."""

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, found, part, opened = _RunningStarts(step), [], None, None
        for batch in batches:
            if batch.empty:
                continue
            part = int(batch["_part"].iloc[0])
            keys = batch[key].reset_index(drop=True)
            before = (run.key, run.rank, run.peak)
            rank, peak, first = run.feed(keys, _micros(batch[arrival]))
            if opened is None:
                opened = keys.iloc[0]
                starts = np.flatnonzero(first)[1:]
            else:
                starts = np.flatnonzero(first)
            if not found and len(starts):
                # The partition's first key ends here.
                at = int(starts[0])
                ended = (opened, int(rank[at - 1]) + 1, int(peak[at - 1])) if at else before
                found.append((part, *ended))
        if part is not None:
            found.append((part, run.key, run.rank, run.peak))
        yield pd.DataFrame(found, columns=["_part", key, "_calls", "_peak"])

    return edges


def _start_times(key: str, arrival: str, step: int, columns: list[str]):
    def starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, opened = _RunningStarts(step), False
        for batch in batches:
            if batch.empty:
                continue
            keys = batch[key].reset_index(drop=True)
            if not opened:
                opened = True
                if pd.notna(batch["_before"].iloc[0]):
                    run.resume(
                        keys.iloc[0], int(batch["_before"].iloc[0]), int(batch["_limit"].iloc[0])
                    )
            arrivals = _micros(batch[arrival])
            rank, peak, _ = run.feed(keys, arrivals)
            start = rank * step + peak
            out = batch[columns].reset_index(drop=True)
            out["start"] = start.astype("datetime64[us]")
            out["wait_us"] = start - arrivals
            yield out

    return starts


def quota_schedule(
    calls: DataFrame,
    rpm: int,
    key: str = "quota_key",
    arrival: str = "arrival",
    ties: tuple[str, ...] = ("channel_id", "msg_id"),
    partitions: int | None = None,
) -> DataFrame:
    """When each call starts under a token bucket of one, ``rpm`` calls a minute.

    Calls are range partitioned by key and time, so a key of any size covers
    several partitions. The layout is checkpointed; one pass takes the count
    and peak of each partition's first and last key, a prefix over that table
    (at most two rows per partition) tells what earlier partitions left, and
    a second pass adds it. ``arrival`` is a time without zone; ``key`` and
    ``arrival`` are not null. ``rpm=0`` is off.
    """
    columns = [key, arrival, *ties]
    slots = calls.select(*columns)
    if rpm == 0:
        return slots.withColumn("start", F.col(arrival)).withColumn("wait_us", F.lit(0).cast("bigint"))
    step = MINUTE_US // rpm
    ranged = (
        slots.repartitionByRange(partitions, *columns)
        if partitions
        else slots.repartitionByRange(*columns)
    )
    laid = cut_lineage(
        ranged.sortWithinPartitions(*columns).withColumn("_part", F.spark_partition_id())
    )

    key_type = slots.schema[key].dataType
    edge_schema = T.StructType(
        [
            T.StructField("_part", T.IntegerType()),
            T.StructField(key, key_type),
            T.StructField("_calls", T.LongType()),
            T.StructField("_peak", T.LongType()),
        ]
    )
    edges = laid.select("_part", key, arrival).mapInPandas(
        _edge_keys(key, arrival, step), edge_schema
    )
    earlier = (
        Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        edges.withColumn("_before", F.sum("_calls").over(earlier))
        .withColumn("_shifted", F.col("_peak") - F.coalesce("_before", F.lit(0)) * F.lit(step))
        .withColumn("_limit", F.max("_shifted").over(earlier))
        .where(F.col("_before").isNotNull())
        .select("_part", key, "_before", "_limit")
    )
    out_schema = T.StructType(
        [
            *slots.schema.fields,
            T.StructField("start", T.TimestampNTZType()),
            T.StructField("wait_us", T.LongType()),
        ]
    )
    return laid.join(F.broadcast(carried), ["_part", key], "left").mapInPandas(
        _start_times(key, arrival, step, columns), out_schema
    )


def retry_plan(call_log: DataFrame, max_retries: int = K.MAX_RETRIES) -> DataFrame:
    """Per post: calls made, total wait and final status.

    The log has one row per post and attempt. Calls end at the first attempt
    that is no quota error, or after ``max_retries`` retries. Attempts fold
    into plain number columns before the shuffle: no list of calls is built
    and the aggregation stays a hash aggregation.
    """
    attempt = F.col("attempt")
    quota = is_quota_error(F.col("code"), F.col("message"))
    ok = F.coalesce("code", F.lit(0)) == 0
    outcome = F.when(quota, 2).when(ok, 0).otherwise(1)
    attempts = range(max_retries + 1)
    judged = call_log.where(attempt <= max_retries).select(
        "channel_id",
        "msg_id",
        "attempt",
        outcome.alias("outcome"),
        F.when(quota, retry_wait_us(attempt, F.col("message"))).otherwise(0).alias("wait_us"),
    )
    folded = judged.groupBy("channel_id", "msg_id").agg(
        *(F.max(F.when(attempt == i, F.col("outcome"))).alias(f"o{i}") for i in attempts),
        *(F.max(F.when(attempt == i, F.col("wait_us"))).alias(f"w{i}") for i in attempts),
    )
    going = F.lit(True)
    made, wait, last = F.lit(0), F.lit(0).cast("bigint"), F.lit(None).cast("int")
    for i in attempts:
        here = going & F.col(f"o{i}").isNotNull()
        made = made + here.cast("int")
        retried = here & (F.col(f"o{i}") == 2)
        if i < max_retries:
            wait = wait + F.when(retried, F.col(f"w{i}")).otherwise(0)
        last = F.when(here, F.col(f"o{i}")).otherwise(last)
        going = retried
    status = F.when(last == 0, "ok").when(last == 2, K.ERR_QUOTA).otherwise(K.ERR_CALL_FAILED)
    return folded.select(
        "channel_id",
        "msg_id",
        made.alias("calls"),
        wait.alias("total_wait_us"),
        status.alias("status"),
    )
