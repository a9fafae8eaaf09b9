"""The whole job: report the watch list, sweep history once, then go live."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from siftline.operators.reports import run_summary, watch_coverage
from siftline.operators.scoring import CallPolicy, Scorer
from siftline.operators.screen import missing_channels
from siftline.params import ScreeningParams, SinkPaths
from siftline.plans.backfill import backfill, swept_since
from siftline.sources.channels import watch_list
from siftline.sources.progress import Sweep, SweepState
from siftline.streaming.live import start_live


@dataclass(frozen=True)
class Running:
    """A started job: watched and missing channels, the sweep and its totals, the stream."""

    watched: int
    missing: int
    sweep: Sweep | None
    live: StreamingQuery
    analysed: int = 0
    matched: int = 0


def run_job(
    spark: SparkSession,
    history: DataFrame,
    stream: DataFrame,
    channels: DataFrame | Callable[[], DataFrame],
    params: ScreeningParams,
    sinks: SinkPaths,
    make_scorer: Callable[[str], Scorer],
    checkpoint: str,
    name: str,
    policy: CallPolicy | None = None,
    trigger: dict | None = None,
    clock: Callable[[], dt.datetime] | None = None,
    as_of: Column | None = None,
    compact_every: int | None = None,
) -> Running:
    """Sweep ``history`` up to now if a cut-off date is set, then screen ``stream``.

    The sweep takes posts dated before its end, the stream those after it, and
    those from ``overlap_s`` before it that the sweep has no verdict for, as
    their file came late. Both share one quota. Missing channels are reported,
    not fatal.
    """
    clock = clock or (lambda: dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))
    watch = watch_list(spark, params.watch_csv)
    known = channels() if callable(channels) else channels
    coverage = watch_coverage(watch, missing_channels(watch, known)).first()
    sweep = backfill(
        spark, history, known, params, sinks, make_scorer, policy, clock(), watch=watch, clock=clock
    )
    until = sweep.until if sweep else None
    overlap = catch_up = swept = None
    totals = (0, 0)
    if sweep:
        total = run_summary(SweepState(spark, sinks.state).totals(sweep)).first()
        totals = (total.analysed or 0, total.matched or 0)
        # What arrived while the sweep ran is no old backlog, also after a restart; nor are
        # files that came too late for the sweep.
        overlap = until - dt.timedelta(seconds=params.overlap_s)
        catch_up = (overlap, sweep.finished)
        swept = swept_since(spark, sinks, sweep, overlap)
    live = start_live(
        stream,
        channels,
        watch,
        params,
        sinks,
        make_scorer,
        checkpoint,
        name,
        policy,
        trigger,
        as_of,
        overlap,
        catch_up=catch_up,
        swept=swept,
        swept_until=until,
        compact_every=compact_every,
    )
    return Running(coverage.watched, coverage.missing, sweep, live, *totals)
