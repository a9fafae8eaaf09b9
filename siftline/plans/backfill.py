"""One sweep over history: all channels at once, in rounds over slices of time."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftline import constants as K, schemas
from siftline.operators.lookup import one_per_key
from siftline.operators.scoring import CallPolicy, Scorer, score_posts
from siftline.operators.screen import (
    after_high_water,
    date_range,
    ordinary_only,
    resolve_channels,
    resolved_history,
    whole_second,
)
from siftline.operators.verdicts import failed_calls, read_verdicts, verdicts_once
from siftline.params import ScreeningParams, SinkPaths
from siftline.session import drop_path, path_exists, store
from siftline.sinks.deliver import deliver
from siftline.sources.channels import watch_list
from siftline.sources.progress import BUCKETS, Round, Sweep, SweepState

#: Minutes of calls under the rate limit that a cut may cost.
ROUND_MINUTES = 10


def round_part(sweep: Sweep, round_: Round) -> str:
    return f"sweep={sweep.generation}/round={round_.number}"


def unit_of(sweep: Sweep) -> Column:
    """A post's place on the sweep's axis: its slice, and within it a hash of its key."""
    bucket = F.pmod(F.xxhash64("channel_id", "msg_id"), F.lit(BUCKETS))
    if not sweep.slice_days:
        return bucket
    passed = F.date_diff(F.col("date").cast("date"), F.lit(sweep.since))
    return F.floor(passed / F.lit(sweep.slice_days)) * BUCKETS + bucket


def round_ranges(gaps: list[tuple[int, int]], posts: dict[int, int], most: int | None) -> list[tuple[int, int]]:
    """Ranges of units of about ``most`` posts each, in the order of time; ``posts`` are per slice.

    Small slices share a round, a large one is cut into several.
    """
    if most is None:
        return gaps
    out = []
    for first, stop in gaps:
        begin, held = first, 0.0
        at = first
        while at < stop:
            end = min((at // BUCKETS + 1) * BUCKETS, stop)
            per_unit = posts.get(at // BUCKETS, 0) / BUCKETS
            whole = held + per_unit * (end - at)
            if whole <= most:
                at, held = end, whole
                continue
            at = min(end, max(at + int((most - held) / per_unit), begin + 1))
            out.append((begin, at))
            begin, held = at, 0.0
        if begin < stop:
            out.append((begin, stop))
    return out


def backfill(
    spark: SparkSession,
    posts: DataFrame,
    channels: DataFrame,
    params: ScreeningParams,
    sinks: SinkPaths,
    make_scorer: Callable[[str], Scorer],
    policy: CallPolicy | None = None,
    now: dt.datetime | None = None,
    slice_days: int | None = 1,
    time: Column | None = None,
    watch: DataFrame | None = None,
    clock: Callable[[], dt.datetime] | None = None,
    round_posts: int | None = None,
    passes: int = 3,
    most_rounds: int | None = None,
) -> Sweep | None:
    """Run or resume the sweep from ``params.since``; None where no sweep is set.

    Work goes in rounds over the axis of time slices and key buckets, oldest
    slices first. A round is one parallel job over all channels, planned before
    it begins and committed when its outputs stand: verdicts, log, outbox, then
    marks and totals. A cut costs the calls of one round at most, and none if
    its verdicts stood. Without ``round_posts`` a round has ``ROUND_MINUTES`` of
    calls under the rate limit, and without a limit it is the whole sweep. After
    ``most_rounds`` rounds the run ends and leaves the others to the next one.

    The posts are scanned once: by the only round, or, where there are several,
    by one pass that stores what is left, sorted by unit, for all of them.

    Posts are held against the marks the sweep started with, so ids need not
    rise with dates. A post that fails is an error value in the verdicts and
    stops nothing. While calls of posts have failed the sweep stays open, and a
    later run tries those posts again, ``passes`` times in all. A finished
    sweep with the same cut-off is left alone; another cut-off starts over.
    """
    if params.since is None:
        return None
    now = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    if whole_second(now) < whole_second(params.since):
        raise ValueError(f"history range: until ({now}) before since ({params.since})")
    state = SweepState(spark, sinks.state)
    sweep = state.open(params.since, whole_second(now), slice_days)
    if sweep.done:
        return sweep
    watch = watch_list(spark, params.watch_csv) if watch is None else watch
    names = resolve_channels(watch, channels).select("channel_id", "title", "username")
    resolved = store(one_per_key(names), "resolved")
    policy = policy or CallPolicy(rpm=params.rpm)
    if round_posts is None and policy.rpm > 0:
        round_posts = policy.rpm * ROUND_MINUTES

    def run(sweep: Sweep, round_: Round, source: Callable[[], DataFrame]) -> Sweep:
        def score() -> DataFrame:
            return score_posts(source(), make_scorer, params.model, policy, params.rules, keep_post=True)

        part = round_part(sweep, round_)
        verdicts = verdicts_once(spark, f"{sinks.verdicts}/{part}", score)
        deliver(verdicts, resolved, params, sinks, K.SOURCE_BACKFILL, part, time, stored=True)
        return state.commit(sweep, round_, round_partials(verdicts))

    if sweep.finished:
        if not any(r.retry for r in sweep.cut_off()):
            sweep, _ = state.plan(sweep, retry=True)
        (again,) = (r for r in sweep.cut_off() if r.retry)
        sweep = run(sweep, again, lambda: failed_posts(spark, sinks, sweep))
    else:
        source = _PostSource(spark, posts, resolved, state.start_marks(sweep), sweep, f"{sinks.state}/staged")
        gaps = sweep.gaps(planned=True)
        counts = source.per_slice(gaps) if round_posts is not None and gaps else {}
        ranges = round_ranges(gaps, counts, round_posts)
        if len(ranges) + len(sweep.cut_off()) > 1:
            source.stage()
        todo = [*sweep.cut_off(), *(Round(0, *r) for r in ranges)]
        for round_ in todo[:most_rounds]:
            if not round_.number:
                sweep, round_ = state.plan(sweep, round_.first, round_.stop)
            sweep = run(sweep, round_, lambda: source.units(round_.first, round_.stop))
        if sweep.gaps():
            return sweep
        sweep = state.cover(sweep, clock() if clock else None)
        source.drop()
    tried = 1 + sum(r.retry for r in sweep.rounds)
    if tried >= passes or not state.failures(sweep):
        sweep = state.finish(sweep)
    return sweep


class _PostSource:
    """The posts of a sweep by unit: from the table itself, or from what one pass stored of it."""

    def __init__(
        self, spark: SparkSession, posts: DataFrame, resolved: DataFrame, marks: DataFrame | None, sweep: Sweep, root: str
    ) -> None:
        self._spark, self._posts, self._resolved, self._marks, self._sweep = spark, posts, resolved, marks, sweep
        self._path = f"{root}/sweep={sweep.generation}"
        self._staged = path_exists(spark, f"{self._path}/_SUCCESS")

    def _located(self, first: int, stop: int) -> DataFrame:
        times = self._sweep.times(Round(0, first, stop))
        kept = date_range(ordinary_only(self._posts), *times)
        return kept.withColumn("unit", unit_of(self._sweep)).where(F.col("unit").between(first, stop - 1))

    def _pending(self, first: int, stop: int) -> DataFrame:
        history = resolved_history(self._located(first, stop), self._resolved, stored=True)
        return after_high_water(history, self._marks)

    def per_slice(self, gaps: list[tuple[int, int]]) -> dict[int, int]:
        """Posts of each slice in a range of units, whatever their channel: keys and dates alone are read."""
        located = self._located(gaps[0][0], gaps[-1][1]).select(F.floor(F.col("unit") / BUCKETS).alias("slice"))
        return {r[0]: r[1] for r in located.groupBy("slice").count().collect()}  # a number per slice

    def stage(self) -> None:
        """Store all that is not committed, sorted by unit, so that a round reads its own part only."""
        if self._staged:
            return
        gaps = self._sweep.gaps()
        kept = self._pending(gaps[0][0], gaps[-1][1]).select("unit", "channel_id", "msg_id", "message")
        order = ["unit", "channel_id", "msg_id"]
        kept.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(self._path)
        self._staged = True

    def units(self, first: int, stop: int) -> DataFrame:
        if not self._staged:
            return self._pending(first, stop)
        schema = "unit BIGINT, channel_id BIGINT, msg_id BIGINT, message STRING"
        stored = self._spark.read.schema(schema).parquet(self._path)
        return stored.where(F.col("unit").between(first, stop - 1))

    def drop(self) -> None:
        if self._staged:
            drop_path(self._spark, self._path)


def _parts(spark: SparkSession, sinks: SinkPaths, sweep: Sweep, rounds: list[Round]) -> DataFrame:
    """Verdicts of some rounds; those without any post have no part that holds rows."""
    paths = [f"{sinks.verdicts}/{round_part(sweep, r)}" for r in rounds]
    stored = [p for p in paths if path_exists(spark, p)]
    if not stored:
        return spark.createDataFrame([], schemas.VERDICTS)
    return spark.read.schema(schemas.VERDICTS).parquet(*stored)


def swept_since(spark: SparkSession, sinks: SinkPaths, sweep: Sweep, since: dt.datetime) -> DataFrame:
    """Keys of the posts that the sweep's slices from ``since`` on have verdicts for."""
    rounds = [r for r in sweep.rounds if r.number in sweep.committed and not r.retry and sweep.times(r)[1] > since]
    return _parts(spark, sinks, sweep, rounds).select("channel_id", "msg_id")


def failed_posts(spark: SparkSession, sinks: SinkPaths, sweep: Sweep) -> DataFrame:
    """Posts whose last call failed, with their text."""
    last = sweep.last_retry()
    rounds = [last] if last else [r for r in sweep.rounds if r.number in sweep.committed]
    return _parts(spark, sinks, sweep, rounds).where(failed_calls()).select("channel_id", "msg_id", "message")


def round_partials(verdicts: DataFrame) -> DataFrame:
    """What a round adds to marks and totals, per channel. Blank posts raise marks, failed ones do not."""
    error = F.col("error")
    scored = error.isNull() | (error == K.ERR_EMPTY_POST)
    return verdicts.groupBy("channel_id").agg(
        F.max(F.when(scored, F.col("msg_id"))).alias("last_msg_id"),
        F.count_if(error.isNull()).alias("analysed"),
        F.count_if(F.coalesce("match", F.lit(False))).alias("matched"),
        F.count_if(failed_calls()).alias("failed"),
    )


def sweep_verdicts(spark: SparkSession, sinks: SinkPaths, sweep: Sweep) -> DataFrame:
    """The last verdict of each post of a sweep: a failed call counts only if no retry followed."""
    last = sweep.last_retry()
    if not sweep.committed & {r.number for r in sweep.rounds}:
        return spark.createDataFrame([], schemas.VERDICTS)
    verdicts = read_verdicts(spark, f"{sinks.verdicts}/sweep={sweep.generation}")
    if last is None:
        return verdicts
    return verdicts.where(~failed_calls()).unionByName(_parts(spark, sinks, sweep, [last]).where(failed_calls()))
