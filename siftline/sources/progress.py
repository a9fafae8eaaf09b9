"""Resume state of sweeps over history.

A sweep is an axis of units: every time slice has ``BUCKETS`` of them, and a
post belongs to the unit of its slice and the hash of its key. Work is done in
rounds, each a range of that axis, whatever part of a slice or number of
slices that is. ``runs`` is the commit log (start, planned rounds, committed
rounds, covered, done); ``progress`` holds what each round adds to marks and
totals.

A round counts once its commit is in ``runs``: rows of a round cut off before
that are ignored, and the round, which was planned before it began, is done
again and replaces its own output. So a restart repeats one round at most.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftline import schemas
from siftline.session import path_exists

Span = tuple[dt.datetime, dt.datetime]

#: Units of one slice.
BUCKETS = 4096
#: The round of marks taken over from a state file.
ADOPTED = 0


@dataclass(frozen=True)
class Round:
    """A range of units; a retry takes the failed posts of the rounds before it instead."""

    number: int
    first: int = 0
    stop: int = 0
    retry: bool = False


@dataclass(frozen=True)
class Sweep:
    """One sweep: its number, cut-off, frozen end, slices, and its rounds.

    ``finished`` is when the last unit was committed. Failed posts may keep the sweep open after that.
    """

    generation: int
    since: dt.date
    until: dt.datetime
    slice_days: int | None = None
    done: bool = False
    finished: dt.datetime | None = None
    rounds: tuple[Round, ...] = ()
    committed: frozenset[int] = frozenset()

    @property
    def start(self) -> dt.datetime:
        return dt.datetime(self.since.year, self.since.month, self.since.day)

    @property
    def slices(self) -> int:
        length = self.until - self.start
        return -(-length // dt.timedelta(days=self.slice_days)) if self.slice_days else int(length > dt.timedelta(0))

    def span(self, number: int) -> Span:
        """The times of a slice."""
        if not self.slice_days:
            return self.start, self.until
        begin = self.start + dt.timedelta(days=number * self.slice_days)
        return begin, min(begin + dt.timedelta(days=self.slice_days), self.until)

    def times(self, round_: Round) -> Span:
        """First and last time of the slices a round touches."""
        return self.span(round_.first // BUCKETS)[0], self.span((round_.stop - 1) // BUCKETS)[1]

    def gaps(self, planned: bool = False) -> list[tuple[int, int]]:
        """Ranges of units that no committed round covers, or no planned one."""
        done = sorted(
            (r.first, r.stop) for r in self.rounds if not r.retry and (planned or r.number in self.committed)
        )
        at, out = 0, []
        for first, stop in [*done, (self.slices * BUCKETS,) * 2]:
            if at < first:
                out.append((at, first))
            at = max(at, stop)
        return out

    def cut_off(self) -> list[Round]:
        """Rounds that were planned and not committed."""
        return [r for r in self.rounds if r.number not in self.committed]

    def complete_rounds(self) -> list[int]:
        """Committed rounds all of whose slices are committed."""
        gaps = self.gaps()

        def whole(r: Round) -> bool:
            first, stop = r.first // BUCKETS * BUCKETS, -(-r.stop // BUCKETS) * BUCKETS
            return all(b <= first or stop <= a for a, b in gaps)

        return [r.number for r in self.rounds if r.number in self.committed and (r.retry or whole(r))]

    def last_retry(self) -> Round | None:
        return max((r for r in self.rounds if r.retry and r.number in self.committed), key=lambda r: r.number, default=None)


class SweepState:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self._spark, self._root = spark, root.rstrip("/")

    def _read(self, table: str, schema: str) -> DataFrame:
        path = f"{self._root}/{table}"
        if path_exists(self._spark, path):
            return self._spark.read.schema(schema).parquet(path)
        return self._spark.createDataFrame([], schema)

    def _append(self, table: str, rows: DataFrame) -> None:
        rows.write.mode("append").partitionBy("generation").parquet(f"{self._root}/{table}")

    def _event(self, sweep: Sweep, event: str, round_: Round | None = None, at: dt.datetime | None = None) -> None:
        now = at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)

        def time(moment: dt.datetime) -> Column:
            return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")

        def number(value: int | None) -> Column:
            return F.lit(value).cast("bigint")

        row = self._spark.range(0, 1, 1, 1).select(
            F.lit(sweep.generation).alias("generation"),
            F.lit(sweep.since).alias("since"),
            time(sweep.until).alias("until"),
            F.lit(event).alias("event"),
            F.lit(sweep.slice_days).cast("int").alias("slice_days"),
            number(round_ and round_.number).alias("round"),
            number(round_ and round_.first).alias("unit_from"),
            number(round_ and round_.stop).alias("unit_to"),
            time(now).alias("at"),
        )
        self._append("runs", row)

    def newest(self) -> Sweep | None:
        """The sweep started last. Its events are few: two per round."""
        runs = self._read("runs", schemas.RUNS)
        top = runs.agg(F.max("generation")).first()[0]
        if top is None:
            return None
        events = runs.where(F.col("generation") == top).collect()
        (start,) = (e for e in events if e.event == "start")
        rounds = [Round(e.round, e.unit_from, e.unit_to, e.event == "retry") for e in events if e.event in ("plan", "retry")]
        return Sweep(
            top,
            start.since,
            start.until,
            start.slice_days,
            any(e.event == "done" for e in events),
            min((e.at for e in events if e.event == "covered"), default=None),
            tuple(sorted(rounds, key=lambda r: r.number)),
            frozenset(e.round for e in events if e.event == "round"),
        )

    def open(self, since: dt.date, until: dt.datetime, slice_days: int | None = None) -> Sweep:
        """Resume the newest sweep if its cut-off is ``since``, else start over.

        A resumed sweep keeps its own end and slices, so its units stay the same.
        """
        newest = self.newest()
        if newest and newest.since == since:
            return newest
        sweep = Sweep(newest.generation + 1 if newest else 1, since, until, slice_days)
        self._event(sweep, "start")
        return sweep

    def plan(self, sweep: Sweep, first: int = 0, stop: int = 0, retry: bool = False) -> tuple[Sweep, Round]:
        """Put a round on record before it begins."""
        round_ = Round(max((r.number for r in sweep.rounds), default=ADOPTED) + 1, first, stop, retry)
        self._event(sweep, "retry" if retry else "plan", round_)
        return replace(sweep, rounds=(*sweep.rounds, round_)), round_

    def start_marks(self, sweep: Sweep) -> DataFrame | None:
        """Marks the sweep began with: none, unless it took over a state file."""
        return self._marks(sweep, [ADOPTED]) if ADOPTED in sweep.committed else None

    def marks(self, sweep: Sweep) -> DataFrame:
        """High-water marks of the sweep's complete slices."""
        return self._marks(sweep, [ADOPTED, *sweep.complete_rounds()])

    def _rows(self, sweep: Sweep, rounds: list[int]) -> DataFrame:
        wanted = self._spark.createDataFrame([(r,) for r in rounds], "round BIGINT")
        mine = self._read("progress", schemas.PROGRESS).where(F.col("generation") == sweep.generation)
        return mine.join(F.broadcast(wanted), "round", "left_semi")  # a number per round

    def _marks(self, sweep: Sweep, rounds: list[int]) -> DataFrame:
        best = F.max("last_msg_id").alias("last_msg_id")
        return self._rows(sweep, rounds).groupBy("channel_id").agg(best).where("last_msg_id IS NOT NULL")

    def totals(self, sweep: Sweep) -> DataFrame:
        """Per channel ``analysed, matched``, added up from the committed rounds' own rows."""
        sums = [F.sum(c).alias(c) for c in ("analysed", "matched")]
        return self._rows(sweep, sorted(sweep.committed - {ADOPTED})).groupBy("channel_id").agg(*sums)

    def failures(self, sweep: Sweep) -> int:
        """Posts whose last call failed."""
        retry = sweep.last_retry()
        rounds = [retry.number] if retry else sorted(sweep.committed - {ADOPTED})
        return self._rows(sweep, rounds).agg(F.sum("failed")).first()[0] or 0

    def commit(self, sweep: Sweep, round_: Round, partials: DataFrame) -> Sweep:
        """Write what the round adds (schema ``PARTIALS``), then the event that makes it count."""
        rows = partials.select(
            F.lit(sweep.since).alias("since"), "channel_id", "last_msg_id", "analysed", "matched", "failed"
        )
        # A round that is done again replaces its rows.
        path = f"{self._root}/progress/generation={sweep.generation}/round={round_.number}"
        rows.hint("rebalance").write.mode("overwrite").parquet(path)
        self._event(sweep, "round", round_)
        return replace(sweep, committed=sweep.committed | {round_.number})

    def cover(self, sweep: Sweep, at: dt.datetime | None = None) -> Sweep:
        """Every unit is committed."""
        now = at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        self._event(sweep, "covered", at=now)
        return replace(sweep, finished=now)

    def finish(self, sweep: Sweep) -> Sweep:
        self._event(sweep, "done")
        return replace(sweep, done=True)

    def write_state_file(self, sweep: Sweep, path: str) -> None:
        """The sweep as one JSON object ``{since, channels, done}``, empty parts left out.

        One object is one row in one task; ``write_state_rows`` has no such limit.
        """
        marks = self.marks(sweep)
        entries = F.collect_list(F.struct(F.col("channel_id").cast("string"), "last_msg_id"))
        channels = F.when(F.count("*") > 0, F.map_from_entries(entries))
        state = marks.agg(channels.alias("channels")).select(
            F.lit(sweep.since.isoformat()).alias("since"),
            "channels",
            F.lit(True if sweep.done else None).cast("boolean").alias("done"),
        )
        state.write.mode("overwrite").option("ignoreNullFields", "true").json(path)

    def write_state_rows(self, sweep: Sweep, path: str) -> None:
        """The sweep as JSON lines: one ``{since, done}``, one ``{channel_id, last_msg_id}`` per channel."""
        head = self._spark.range(1).select(
            F.lit(sweep.since.isoformat()).alias("since"), F.lit(sweep.done).alias("done")
        )
        rows = head.unionByName(self.marks(sweep), allowMissingColumns=True)
        rows.write.mode("overwrite").option("ignoreNullFields", "true").json(path)

    def adopt_state_file(self, path: str, until: dt.datetime, slice_days: int | None = None) -> Sweep | None:
        """Take over a state file ``{since, channels, done}`` as a new sweep."""
        state = self._spark.read.schema(schemas.STATE_FILE).json(path, multiLine=True)
        head = state.select(F.to_date("since").alias("since"), "done").first()
        if head is None or head.since is None:
            return None
        newest = self.newest()
        sweep = Sweep(newest.generation + 1 if newest else 1, head.since, until, slice_days)
        self._event(sweep, "start")
        none = F.lit(0).cast("bigint")
        marks = state.select(F.explode("channels").alias("channel_id", "last_msg_id")).select(
            F.col("channel_id").cast("bigint").alias("channel_id"),
            "last_msg_id",
            *[none.alias(c) for c in ("analysed", "matched", "failed")],
        )
        sweep = self.commit(sweep, Round(ADOPTED), marks)
        if head.done:
            sweep = self.finish(self.cover(sweep))
        return sweep
