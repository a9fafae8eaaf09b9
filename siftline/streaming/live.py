"""The live flow: a stream of posts through the filters, the scorer and the sinks."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from siftline import constants as K
from siftline.operators.scoring import CallPolicy, Scorer, score_posts
from siftline.operators.screen import (
    channel_peer_only,
    cutover,
    max_age,
    non_blank,
    ordinary_only,
    utc_now,
    watched_only,
)
from siftline.operators.verdicts import KEY, verdicts_once
from siftline.params import ScreeningParams, SinkPaths
from siftline.session import stream_settings
from siftline.sinks.deliver import deliver
from siftline.sinks.packs import FAN
from siftline.sinks.tables import compact_batches, write_part
from siftline.sources.progress import Span
from siftline.streaming.retries import write_failed_once


def live_posts(
    posts: DataFrame,
    watch: DataFrame,
    params: ScreeningParams,
    as_of: Column | None = None,
    until: dt.datetime | None = None,
    catch_up: Span | None = None,
) -> DataFrame:
    """Posts the live flow scores. Works on a stream or a table.

    Lateness is measured against processing time, post by post: no watermark.
    ``until`` is where a sweep over history ended; older posts belong to it.
    Posts dated within ``catch_up``, while the sweep ran, are not late.
    """
    fresh = channel_peer_only(ordinary_only(posts))
    if until is not None:
        _, fresh = cutover(fresh, until)
    fresh = max_age(fresh, utc_now() if as_of is None else as_of, params.max_age_s, catch_up)
    return non_blank(watched_only(fresh, watch))


def malformed_table(sinks: SinkPaths) -> str:
    return f"{sinks.state}/malformed"


def start_live(
    posts: DataFrame,
    channels: DataFrame | Callable[[], DataFrame],
    watch: DataFrame,
    params: ScreeningParams,
    sinks: SinkPaths,
    make_scorer: Callable[[str], Scorer],
    checkpoint: str,
    name: str,
    policy: CallPolicy | None = None,
    trigger: dict | None = None,
    as_of: Column | None = None,
    until: dt.datetime | None = None,
    time: Column | None = None,
    catch_up: Span | None = None,
    swept: DataFrame | None = None,
    swept_until: dt.datetime | None = None,
    keep_failed: bool = False,
    compact_every: int | None = None,
    fan: int = FAN,
) -> StreamingQuery:
    """Start the stream, to be restarted from the same ``checkpoint``.

    Posts dated before ``swept_until`` are left out if ``swept`` has their key.
    ``channels`` may be a function that opens the table, so that a batch sees
    rows added since the start.

    Each batch scores its posts once into the verdict table and reads them
    back; a batch repeated after a failure replaces its own parts. With
    ``keep_failed`` failed posts are left for ``streaming.retries``. Where
    ``posts`` has ``malformed`` (of ``parse_posts``), such texts go to
    ``malformed_table``; a batch is read a second time for them. Every
    ``compact_every`` batches the outputs of earlier ones become packs of
    ``sinks.packs``, joined ``fan`` at a time; set it only where all readers of
    the outputs are those of ``sinks.tables``.
    """
    policy = policy or CallPolicy(rpm=params.rpm)
    raw = "malformed" in posts.columns

    def fresh(rows: DataFrame) -> DataFrame:
        return live_posts(rows, watch, params, as_of, until, catch_up)

    def unswept(batch: DataFrame) -> DataFrame:
        if swept is None:
            return batch
        old, new = cutover(batch, swept_until)
        if old.isEmpty():
            return batch
        return new.unionByName(old.join(swept, KEY, "left_anti"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        # Spark's id of the query: the same after a restart from one checkpoint.
        stream = session.sparkContext.getLocalProperty("sql.streaming.queryId")
        part = f"stream={stream}/batch={batch_id}"
        if raw:
            bad = batch.where(F.col("malformed").isNotNull()).select("malformed")
            write_part(bad, malformed_table(sinks), part)
            batch = fresh(batch.where(F.col("malformed").isNull()).drop("malformed"))

        def score() -> DataFrame:
            return score_posts(
                unswept(batch), make_scorer, params.model, policy, params.rules, keep_post=True
            )

        verdicts = verdicts_once(session, f"{sinks.verdicts}/{part}", score)
        dim = channels() if callable(channels) else channels
        deliver(verdicts, dim, params, sinks, K.SOURCE_LIVE, part, time)
        if keep_failed:
            write_failed_once(verdicts, sinks, part)
        if compact_every and (batch_id + 1) % compact_every == 0:
            compact_batches(session, sinks, f"stream={stream}", batch_id, fan)

    writer = (
        (posts if raw else fresh(posts))
        .writeStream.queryName(name)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(sink)
    )
    with stream_settings(posts.sparkSession):
        return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()
