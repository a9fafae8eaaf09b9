"""Posts whose calls failed, held in keyed state until their wait is over and then tried again.

The live flow writes failed posts to a table of their own; a second stream reads
it. Each post is a key of that stream: its row starts a processing-time timer,
and when the timer fires the post goes to the scorer once more. What fails
again is written to the same table with the next attempt, so it comes back by
itself. State and timers are part of the stream's checkpoint: a wait outlives
a restart.
"""

from __future__ import annotations

import time as clock
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from siftline import constants as K, schemas
from siftline.functions.quota import retry_wait_us
from siftline.operators.scoring import CallPolicy, Scorer, score_posts
from siftline.operators.verdicts import KEY, failed_calls, store_verdicts
from siftline.params import ScreeningParams, SinkPaths
from siftline.session import path_exists, stream_settings
from siftline.sinks.deliver import deliver
from siftline.sinks.tables import write_part

#: Seconds until a post is tried again whose call failed for another reason than the quota.
PAUSE_S = 60
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def failed_table(sinks: SinkPaths) -> str:
    return f"{sinks.state}/failed"


def failed_rows(verdicts: DataFrame, attempt: Column, pause_s: int = PAUSE_S) -> DataFrame:
    """Failed posts of stored verdicts with the wait that their last call asks for (schema ``FAILED``)."""
    last = F.get("calls", F.size("calls") - 1)
    quota = retry_wait_us(F.lit(K.MAX_RETRIES), last["message"])
    wait = F.when(F.col("error") == K.ERR_QUOTA, quota).otherwise(pause_s * 1_000_000)
    return verdicts.where(failed_calls()).select(
        *KEY, "message", attempt.cast("int").alias("attempt"), wait.cast("bigint").alias("wait_us")
    )


def write_failed_once(verdicts: DataFrame, sinks: SinkPaths, part: str) -> None:
    """The failed posts of a batch, unless they are there: a stream reads every file once."""
    if not path_exists(verdicts.sparkSession, f"{failed_table(sinks)}/{part}/_SUCCESS"):
        write_part(failed_rows(verdicts, F.lit(1)), failed_table(sinks), part)


class WaitingPosts(StatefulProcessor):
    """One failed post per key: kept from its failure to the end of its wait."""

    def __init__(self, wait_scale: float) -> None:
        self._scale = wait_scale

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._post = handle.getValueState("post", "message string, attempt int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = pd.concat(list(rows)).sort_values("attempt").iloc[-1]
        # A repeated row of a batch that was done again finds the post waiting.
        if not self._post.exists() or self._post.get()[1] < newest["attempt"]:
            self._post.update((newest["message"], int(newest["attempt"])))
            wait_ms = int(newest["wait_us"] * self._scale / 1000)
            self._handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + max(wait_ms, 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self._post.exists():
            return
        message, attempt = self._post.get()
        self._post.clear()
        yield pd.DataFrame({"channel_id": [key[0]], "msg_id": [key[1]], "message": [message], "attempt": [attempt]})

    def close(self) -> None:
        pass


def due_again(failed: DataFrame, wait_scale: float = 1.0) -> DataFrame:
    """A stream of failed posts (schema ``FAILED``) to the posts whose wait is over, once per failure."""
    return failed.groupBy(*KEY).transformWithStateInPandas(
        WaitingPosts(wait_scale), "channel_id BIGINT, msg_id BIGINT, message STRING, attempt INT", "Append", "ProcessingTime"
    )


def start_retries(
    spark: SparkSession,
    channels: DataFrame | Callable[[], DataFrame],
    params: ScreeningParams,
    sinks: SinkPaths,
    make_scorer: Callable[[str], Scorer],
    checkpoint: str,
    name: str,
    policy: CallPolicy | None = None,
    trigger: dict | None = None,
    time: Column | None = None,
    attempts: int = 3,
    wait_scale: float = 1.0,
    pause_s: int = PAUSE_S,
) -> StreamingQuery:
    """Start the stream that tries failed posts of a live flow again, ``attempts`` times at most.

    A post's wait is what its last quota error asks for, or ``pause_s``, times
    ``wait_scale``. A batch repeated after a failure replaces its own parts;
    its calls are made again, as more waits may be over by then.
    """
    policy = policy or CallPolicy(rpm=params.rpm)

    def sink(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        stream = session.sparkContext.getLocalProperty("sql.streaming.queryId")
        part = f"retries={stream}/batch={batch_id}"
        # The batch is what timers gave out: it is read once and stored.
        due = f"{sinks.state}/due/{part}"
        batch.write.mode("overwrite").parquet(due)
        posts = session.read.schema(batch.schema).parquet(due)
        if posts.isEmpty():
            return
        scored = score_posts(posts, make_scorer, params.model, policy, params.rules, keep_post=True)
        verdicts = store_verdicts(scored, f"{sinks.verdicts}/{part}")
        deliver(verdicts, channels() if callable(channels) else channels, params, sinks, K.SOURCE_LIVE, part, time)
        tried = posts.where(F.col("attempt") < attempts).select(*KEY, "attempt")
        again = verdicts.join(tried, KEY)
        write_part(failed_rows(again, F.col("attempt") + 1, pause_s), failed_table(sinks), part)

    # A file source lists a folder that exists.
    if not path_exists(spark, failed_table(sinks)):
        spark.createDataFrame([], schemas.FAILED).write.mode("append").parquet(f"{failed_table(sinks)}/none")
    failed = (
        spark.readStream.schema(schemas.FAILED)
        .option("recursiveFileLookup", "true")
        .parquet(failed_table(sinks))
    )
    # Keyed state with timers needs this store; a query keeps what it starts with.
    with stream_settings(spark, **{_PROVIDER: _ROCKS}):
        writer = (
            due_again(failed, wait_scale)
            .writeStream.queryName(name)
            .option("checkpointLocation", checkpoint)
            .foreachBatch(sink)
        )
        return writer.trigger(**(trigger or {"processingTime": "5 seconds"})).start()


def settle(query: StreamingQuery, seconds: float) -> bool:
    """Wait until no post is waiting and no row is new, then stop the stream; False after ``seconds``."""
    end, quiet = clock.time() + seconds, 0
    seen = -1
    while clock.time() < end and query.isActive:
        progress = query.lastProgress
        if progress is not None and progress.batchId != seen:
            seen = progress.batchId
            waiting = sum(s.numRowsTotal for s in progress.stateOperators)
            quiet = quiet + 1 if waiting == 0 and progress.numInputRows == 0 else 0
            if quiet >= 3:
                break
        clock.sleep(0.1)
    done = quiet >= 3
    query.stop()
    if query.exception() is not None:
        raise query.exception()
    return done
