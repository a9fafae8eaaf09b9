"""The model call as a distributed scorer.

A scorer is any callable ``scorer(text) -> str`` that raises ``CallFailed``.
It is built once per task, by a factory that gets the system text (empty for
models with one text input). Every row ends as a reply or an error class.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from siftline import constants as K
from siftline import schemas
from siftline.functions.prompts import system_text, text_frame
from siftline.functions.text import utrim

Scorer = Callable[[str], str | None]
MINUTE_US = 60_000_000
#: Posts, and bytes of their text, whose replies a task holds at a time, beside the Arrow batch itself.
PIECE_ROWS, PIECE_BYTES = 1000, 1 << 20
_CALLS = pa.list_(
    pa.struct([("attempt", pa.int32()), ("code", pa.int32()), ("message", pa.string()), ("wait_us", pa.int64())])
)


class CallFailed(Exception):
    """A failed model call with the service's status code."""

    def __init__(self, code: int, message: str) -> None:
        super().__init__(code, message)
        self.code = code
        self.message = message


@dataclass(frozen=True)
class CallPolicy:
    """Request rate over all tasks together (0 = off), and the retry limit.

    ``clock`` is the time all machines share, in seconds.
    """

    rpm: int = K.DEFAULT_RPM
    tasks: int | None = None
    max_retries: int = K.MAX_RETRIES
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.time


class _Pacer:
    """Slots of one task on a grid that all tasks share.

    The grid has a slot every ``step_us`` since the epoch, and lane ``i`` of
    ``lanes`` owns every ``lanes``-th of them. So no two calls share a slot,
    whichever task, batch, sweep, stream or restart they belong to, and nothing has
    to be carried from one to the next.
    """

    def __init__(self, step_us: int, lane: int, lanes: int, policy: CallPolicy) -> None:
        self._step, self._lane, self._lanes, self._policy = step_us, lane, lanes, policy
        self._next = 0

    def wait(self) -> None:
        if not self._step:
            return
        now = int(self._policy.clock() * 1e6)
        slot = max(self._next, -(-now // self._step))
        slot += (self._lane - slot) % self._lanes
        self._next = slot + 1
        if slot * self._step > now:
            self._policy.sleep((slot * self._step - now) / 1e6)


def _hint_seconds(message: str) -> float:
    """Seconds a hint asks for; 0 without one, or for more than 64 bits of nanoseconds."""
    hint = re.search(K.RETRY_HINT, message)
    seconds = float(hint.group(1)) if hint else 0.0
    return seconds if seconds * 1e9 < 1 << 63 else 0.0


def _call(scorer: Scorer, text: str, pacer: _Pacer, policy: CallPolicy):
    """One post: ``(raw, error, failed calls)``."""
    calls = []
    for attempt in range(policy.max_retries + 1):
        pacer.wait()
        try:
            return scorer(text), None, calls
        except CallFailed as failure:
            code, message = failure.code, failure.message
        except Exception as failure:  # a bad row must not fail the job
            code, message = 0, str(failure)
        if not (code == K.QUOTA_CODE or any(p in message for p in K.QUOTA_PHRASES)):
            calls.append((attempt, code, message, 0))
            return None, K.ERR_CALL_FAILED, calls
        if attempt == policy.max_retries:
            calls.append((attempt, code, message, 0))
            break
        seconds = (_hint_seconds(message) or K.BACKOFF_BASE_S * 2**attempt) + K.RETRY_MARGIN_S
        calls.append((attempt, code, message, int(seconds * 1_000_000)))
        policy.sleep(seconds)
    return None, K.ERR_QUOTA, calls


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows within ``PIECE_ROWS`` and ``PIECE_BYTES``, or one longer post; nothing is copied."""
    begin, held = 0, 0
    for at, size in enumerate(pc.binary_length(batch.column("post")).to_pylist()):
        size = size or 0
        if at - begin == PIECE_ROWS or held and held + size > PIECE_BYTES:
            yield batch.slice(begin, at - begin)
            begin, held = at, 0
        held += size
    if begin < batch.num_rows:
        yield batch.slice(begin)


def score_posts(
    posts: DataFrame,
    make_scorer: Callable[[str], Scorer],
    model: str = K.DEFAULT_MODEL,
    policy: CallPolicy = CallPolicy(),
    rules: str | None = None,
    keep_post: bool = False,
) -> DataFrame:
    """One reply or error per post (schema ``SCORED``, plus the trimmed ``post`` if kept).

    Put every filter before this call: Spark moves none past it. With a rate
    limit the posts are spread over ``tasks`` tasks that each own an equal
    share of the slots of one grid, so the rate is a ceiling over all of them
    and over whatever runs before or after. Without one nothing is shuffled.
    Blank posts become ``empty_post`` and are not sent. A task hands on its
    replies piece by piece, so its Python holds one Arrow batch and little more.
    """
    is_text = model.lower().startswith(K.TEXT_FAMILY_PREFIX)
    before, after = text_frame(rules) if is_text else ("", "")
    system = "" if is_text else system_text(rules)
    narrow = posts.select(
        F.col("channel_id").cast("bigint"), F.col("msg_id").cast("bigint"), utrim(F.col("message")).alias("post")
    )
    step_us, tasks = 0, 1
    if policy.rpm > 0:
        tasks = policy.tasks or min(posts.sparkSession.sparkContext.defaultParallelism, policy.rpm)
        narrow = narrow.repartition(tasks)
        step_us = -(-MINUTE_US // policy.rpm)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = make_scorer(system)
        pacer = _Pacer(step_us, TaskContext.get().partitionId() % tasks, tasks, policy)
        for batch in batches:
            for piece in _pieces(batch):
                texts = (post.as_py() for post in piece.column("post"))
                outcomes = [
                    _call(scorer, f"{before}{post}{after}", pacer, policy)
                    if post
                    else (None, K.ERR_EMPTY_POST, [])
                    for post in texts
                ]
                columns = {
                    "channel_id": piece.column("channel_id"),
                    "msg_id": piece.column("msg_id"),
                    "model": pa.repeat(pa.scalar(model), piece.num_rows),
                    "raw": pa.array([raw for raw, _, _ in outcomes], pa.string()),
                    "error": pa.array([error for _, error, _ in outcomes], pa.string()),
                    "calls": pa.array([calls for _, _, calls in outcomes], _CALLS),
                }
                yield pa.RecordBatch.from_pydict(columns | {"post": piece.column("post")} if keep_post else columns)

    schema = f"{schemas.SCORED}, post STRING" if keep_post else schemas.SCORED
    return narrow.mapInArrow(score, schema)


def call_log(scored: DataFrame) -> DataFrame:
    """Failed calls of the scored posts as rows."""
    return scored.select("channel_id", "msg_id", F.explode("calls").alias("c")).select(
        "channel_id", "msg_id", "c.attempt", "c.code", "c.message", "c.wait_us"
    )


def store_replies(scored: DataFrame, path: str) -> DataFrame:
    """Write scored posts once and read them back, so no call is made twice."""
    scored.write.mode("overwrite").parquet(path)
    return scored.sparkSession.read.schema(schemas.SCORED).parquet(path)
