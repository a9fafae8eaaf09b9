"""Sweeps, streams and sinks: resume, stream = batch, and repeated work."""

import datetime as dt
import json
import sys
import time
import uuid

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from siftline import constants as K
from siftline import schemas
from siftline.operators import lookup
from siftline.operators import screen as C
from siftline.operators.matches import all_matches, match_records, quarantine, with_channel
from siftline.operators.reports import backlog_by_channel, high_water, run_summary, run_summary_by_channel
from siftline.operators.scoring import CallFailed, CallPolicy
from siftline.operators.verdicts import read_verdicts
from siftline.params import ScreeningParams, SinkPaths
from siftline.plans import backfill as B
from siftline.plans.job import run_job
from siftline.session import ARROW_BYTES, STREAM_ARROW_BYTES
from siftline.sinks.tables import read_match_log, read_outbox, write_match_log, write_part
from siftline.sources.channels import read_channels
from siftline.sources.posts import read_history, read_live, read_live_json, write_posts_by_day
from siftline.sources.progress import BUCKETS, SweepState
from siftline.streaming import live as live_module, retries as retries_module
from siftline.streaming.live import live_posts, malformed_table, start_live
from siftline.streaming.retries import failed_rows, failed_table, settle, start_retries

# The workers do not have the tests on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DAY = dt.datetime(2024, 1, 1)
MODEL = "json-local"
UNPACED = CallPolicy(rpm=0)


def scorer(system):
    def reply(text):
        if "fail" in text:
            raise CallFailed(503, "down")
        return '{"match": %s, "reason": "r"}' % ("true" if "yes" in text else "false")

    return reply


def make_posts(spark):
    rows = []
    for i in range(1, 41):
        channel = [10, 10, 10, 11, 12, 13][i % 6]
        text = ["yes", "no", " \n", "yes fail", "yes 2"][i % 5]
        kind = "service" if i % 9 == 0 else "message"
        peer = "user" if i % 11 == 0 else "channel"
        rows.append((channel, i, kind, peer, text, DAY + dt.timedelta(hours=2 * i)))
    return spark.createDataFrame(rows, schemas.POSTS)


def make_channels(spark):
    rows = [(10, "Ten", "ten", False), (11, "", "", False), (12, "Left", "l", True)]
    return spark.createDataFrame(rows, schemas.CHANNELS)


def sinks_at(path):
    return SinkPaths(*(str(path / n) for n in ("log", "outbox", "verdicts", "quarantine", "state")))


PARAMS = ScreeningParams(
    watch_csv="-10010, 11, 12, 99", model=MODEL, rpm=0, since=DAY.date(), destination="jobs"
)


def run(spark, sinks, now, params=PARAMS, make=scorer, **options):
    return B.backfill(
        spark, make_posts(spark), make_channels(spark), params, sinks, make, UNPACED, now, **options
    )


def log_rows(spark, sinks):
    return sorted((r.channel_id, r.msg_id, r.source) for r in read_match_log(spark, sinks.match_log).collect())


def expected_matches(spark, until):
    rows = make_posts(spark).where(
        (F.col("kind") == "message") & F.col("channel_id").isin(10, 11)
        & F.col("message").isin("yes", "yes 2") & (F.col("date") < C.ntz(until))
    )
    return sorted((r.channel_id, r.msg_id, "backfill") for r in rows.collect())


def test_sweep_logs_marks_and_summary(spark, tmp_path):
    sinks, now = sinks_at(tmp_path), DAY + dt.timedelta(days=3)
    sweep = run(spark, sinks, now)
    assert sweep.generation == 1 and sweep.slices == 3 and len(sweep.committed) == 1
    assert sweep.finished and not sweep.gaps() and not sweep.done  # some calls failed
    assert log_rows(spark, sinks) == expected_matches(spark, now)
    outbox = read_outbox(spark, sinks.outbox).collect()
    assert len(outbox) == len(log_rows(spark, sinks))
    assert len({r.dedup_id for r in outbox}) == len(outbox)
    assert {r.destination for r in outbox} == {"jobs"}
    swept = make_posts(spark).where((F.col("kind") == "message") & (F.col("date") < C.ntz(now)))
    good = swept.where(~F.contains("message", F.lit("fail")) & F.col("channel_id").isin(10, 11))
    want = {r[0]: r[1] for r in good.groupBy("channel_id").agg(F.max("msg_id")).collect()}
    marks = SweepState(spark, sinks.state).marks(sweep)
    assert {r.channel_id: r.last_msg_id for r in marks.collect()} == want
    by_channel = run_summary_by_channel(B.sweep_verdicts(spark, sinks, sweep))
    total = run_summary(by_channel).first()
    assert sorted(by_channel.collect()) == sorted(SweepState(spark, sinks.state).totals(sweep).collect())
    assert total.matched == len(outbox)
    assert total.analysed == good.where(F.trim(F.translate("message", "\n", "")) != "").count()


def test_finished_sweep_is_left_alone_and_new_date_starts_over(spark, tmp_path):
    sinks, now = sinks_at(tmp_path), DAY + dt.timedelta(days=2)
    first = run(spark, sinks, now, passes=1)
    before = log_rows(spark, sinks)
    again = run(spark, sinks, now + dt.timedelta(days=1))
    assert again == first and first.done and log_rows(spark, sinks) == before
    other = ScreeningParams(**{**PARAMS.__dict__, "since": dt.date(2024, 1, 2)})
    second = run(spark, sinks, now, params=other)
    assert second.generation == 2 and second.slices == 1
    # Back to the first date: its state is gone, so it runs again.
    assert run(spark, sinks, now).generation == 3


def test_ids_need_not_rise_with_dates(spark, tmp_path):
    sinks, now = sinks_at(tmp_path), DAY + dt.timedelta(days=4)
    posts = make_posts(spark).withColumn("msg_id", F.lit(41) - F.col("msg_id"))
    channels = make_channels(spark)
    B.backfill(spark, posts, channels, PARAMS, sinks, scorer, UNPACED, now)
    kept = posts.where(
        (F.col("kind") == "message") & F.col("channel_id").isin(10, 11)
        & F.col("message").isin("yes", "yes 2")
    )
    want = sorted((r.channel_id, r.msg_id, "backfill") for r in kept.collect())
    assert log_rows(spark, sinks) == want


def counting(folder):
    """A scorer that leaves a file per call, named by the text's number."""

    def make(system):
        def reply(text):
            (folder / f"{text.split()[0]}-{uuid.uuid4().hex}").touch()
            return scorer(system)(text)

        return reply

    return make


def numbered_posts(spark):
    return make_posts(spark).withColumn(
        "message", F.when(F.trim(F.translate("message", "\n", "")) == "", F.col("message")).otherwise(F.concat("msg_id", F.lit(" "), "message"))
    )


@pytest.mark.parametrize(
    ("cut_at", "slice_days"), [("plan", 1), ("score", None), ("deliver", 1), ("commit", None), ("event", 2)]
)
def test_a_cut_sweep_repeats_one_round_at_most(spark, tmp_path, monkeypatch, cut_at, slice_days):
    sinks, now = sinks_at(tmp_path), DAY + dt.timedelta(days=3)
    calls, marks = {"n": 0}, tmp_path / "calls"
    marks.mkdir()

    def go(until):
        return B.backfill(
            spark, numbered_posts(spark), make_channels(spark), PARAMS, sinks, counting(marks), UNPACED,
            until, slice_days, round_posts=14,
        )

    def cut(original):
        def wrapped(*args, **kwargs):
            calls["n"] += 1
            if calls["n"] == 2:
                raise RuntimeError("cut")
            return original(*args, **kwargs)

        return wrapped

    with monkeypatch.context() as patch:
        if cut_at == "score":
            patch.setattr(B, "verdicts_once", cut(B.verdicts_once))
        elif cut_at == "deliver":
            patch.setattr(B, "deliver", cut(B.deliver))
        elif cut_at in ("commit", "plan"):
            patch.setattr(SweepState, cut_at, cut(getattr(SweepState, cut_at)))
        else:
            # What the round adds is written, the event that makes it count is not.
            original = SweepState._event

            def event(self, sweep, kind, *more, **named):
                if kind == "round":
                    calls["n"] += 1
                    if calls["n"] == 2:
                        raise RuntimeError("cut")
                return original(self, sweep, kind, *more, **named)

            patch.setattr(SweepState, "_event", event)
        with pytest.raises(RuntimeError, match="cut"):
            go(now)
    state = SweepState(spark, sinks.state).newest()
    assert not state.finished and len(state.committed) == 1 and state.gaps()
    # The resumed run keeps the frozen end, although it starts later.
    sweep = go(now + dt.timedelta(days=5))
    assert sweep.finished and sweep.until == now and len(sweep.committed) > 2
    assert not (tmp_path / "state" / "staged" / f"sweep={sweep.generation}").exists()
    assert log_rows(spark, sinks) == expected_matches(spark, now)
    made = [f.name.split("-")[0] for f in marks.iterdir()]
    assert len(made) == len(set(made)) > 14  # no post is paid for twice
    clean = sinks_at(tmp_path / "clean")
    once = B.backfill(spark, make_posts(spark), make_channels(spark), PARAMS, clean, scorer, UNPACED, now, slice_days)
    for read in (SweepState.marks, SweepState.totals):
        pair = [sorted(map(tuple, read(SweepState(spark, s.state), w).collect())) for s, w in ((sinks, sweep), (clean, once))]
        assert pair[0] == pair[1] != []


def test_rounds_split_large_slices_and_join_small_ones():
    posts = {0: 10, 1: 10, 2: 1000, 4: 30}
    gaps = [(0, 3 * BUCKETS), (3 * BUCKETS + 7, 6 * BUCKETS)]
    ranges = B.round_ranges(gaps, posts, 100)
    assert [x for r in ranges for x in range(*r)] == [x for g in gaps for x in range(*g)]
    size = lambda a, b: sum(posts.get(u // BUCKETS, 0) / BUCKETS for u in range(a, b))
    assert max(size(*r) for r in ranges) <= 101 and len(ranges) == 12
    assert B.round_ranges(gaps, {}, None) == gaps


def test_failed_posts_are_tried_again_by_later_runs(spark, tmp_path):
    sinks, now = sinks_at(tmp_path), DAY + dt.timedelta(days=3)

    def mended(system):
        def reply(text):
            assert "fail" in text
            if text != "yes fail":
                raise CallFailed(503, "down")
            return '{"match": true, "reason": "r"}'

        return reply

    def still_down(system):
        def reply(text):
            raise CallFailed(429, "down") if "fail" in text else AssertionError(text)

        return reply

    state = SweepState(spark, sinks.state)
    first = run(spark, sinks, now, round_posts=20)
    failed = make_posts(spark).where(
        (F.col("kind") == "message") & F.col("channel_id").isin(10, 11) & (F.col("message") == "yes fail") & (F.col("date") < C.ntz(now))
    )
    ids = sorted(r.msg_id for r in failed.collect())
    assert not first.done and state.failures(first) == len(ids) > 2
    policy = CallPolicy(rpm=0, max_retries=0)
    second = B.backfill(spark, make_posts(spark), make_channels(spark), PARAMS, sinks, still_down, policy, now)
    assert not second.done and state.failures(second) == len(ids) and log_rows(spark, sinks) == expected_matches(spark, now)
    third = run(spark, sinks, now, make=mended)
    assert third.done and state.failures(third) == 0 and third.finished == first.finished
    extra = [r for r in log_rows(spark, sinks) if r not in expected_matches(spark, now)]
    assert sorted(m for _, m, _ in extra) == ids
    verdicts = B.sweep_verdicts(spark, sinks, third)
    assert verdicts.where("error = 'call_failed'").count() == 0
    assert verdicts.count() == verdicts.select("channel_id", "msg_id").distinct().count()
    assert sorted(run_summary_by_channel(verdicts).collect()) == sorted(state.totals(third).collect())
    assert run(spark, sinks, now, make=lambda s: None) == third


def test_the_posts_are_scanned_once_whatever_the_slices(spark, tmp_path, monkeypatch):
    sinks, now, scans = sinks_at(tmp_path), DAY + dt.timedelta(days=3), []
    seen = B._PostSource._pending
    monkeypatch.setattr(B._PostSource, "_pending", lambda self, *a: scans.append(a) or seen(self, *a))
    run(spark, sinks, now)
    assert len(scans) == 1
    run(spark, sinks_at(tmp_path / "rounds"), now, round_posts=20)
    assert len(scans) == 2


def test_resume_does_not_call_the_model_again_for_stored_verdicts(spark, tmp_path, monkeypatch):
    sinks, now = sinks_at(tmp_path), DAY + dt.timedelta(days=1)
    with monkeypatch.context() as patch:
        patch.setattr(B, "deliver", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("cut")))
        with pytest.raises(RuntimeError):
            run(spark, sinks, now)

    def never(system):
        def reply(text):
            raise AssertionError("called again")

        return reply

    run(spark, sinks, now, make=never)
    assert log_rows(spark, sinks) == expected_matches(spark, now)
    stored = read_verdicts(spark, sinks.verdicts).collect()
    assert {r.error for r in stored} == {None, "call_failed", "empty_post"}
    assert all((r.message is not None) == (bool(r.match) or r.error == "call_failed") for r in stored)


def test_no_date_no_sweep_and_range_error(spark, tmp_path):
    none = ScreeningParams(**{**PARAMS.__dict__, "since": None})
    assert run(spark, sinks_at(tmp_path), DAY, params=none) is None
    with pytest.raises(ValueError, match="until"):
        run(spark, sinks_at(tmp_path), DAY - dt.timedelta(days=1))
    with pytest.raises(ValueError, match="until"):
        C.date_range(make_posts(spark), DAY, DAY - dt.timedelta(seconds=1))


def test_state_file_is_taken_over(spark, tmp_path):
    path = tmp_path / "state.json"
    path.write_text(
        '{\n  "since": "2024-01-01",\n  "channels": {"10": 12, "11": 7},\n  "done": false\n}'
    )
    sinks, now = sinks_at(tmp_path), DAY + dt.timedelta(days=3)
    state = SweepState(spark, sinks.state)
    sweep = state.adopt_state_file(str(path), now)
    assert {r.channel_id: r.last_msg_id for r in state.marks(sweep).collect()} == {10: 12, 11: 7}
    run(spark, sinks, now)
    marks = {10: 12, 11: 7}
    want = [r for r in expected_matches(spark, now) if r[1] > marks[r[0]]]
    assert log_rows(spark, sinks) == want


def test_state_file_round_trip(spark, tmp_path):
    sinks, now = sinks_at(tmp_path), DAY + dt.timedelta(days=2)
    sweep = run(spark, sinks, now, passes=1)
    state, path = SweepState(spark, sinks.state), str(tmp_path / "exported")
    state.write_state_file(sweep, path)
    (line,) = [f.read_text() for f in (tmp_path / "exported").glob("*.json") if f.read_text()]
    marks = {str(r.channel_id): r.last_msg_id for r in state.marks(sweep).collect()}
    assert json.loads(line) == {"since": "2024-01-01", "channels": marks, "done": True}
    taken = SweepState(spark, str(tmp_path / "other")).adopt_state_file(path, now)
    assert taken.done and taken.since == sweep.since


def test_stream_equals_batch_over_several_triggers(spark, tmp_path):
    source, sinks = str(tmp_path / "posts"), sinks_at(tmp_path)
    make_posts(spark).repartition(5).write.parquet(source)
    watch = spark.createDataFrame([(10,), (11,), (13,)], schemas.WATCH)
    as_of = C.ntz(DAY + dt.timedelta(days=2))
    params = ScreeningParams(model=MODEL, rpm=0, max_age_s=36 * 3600)

    def drain(folder):
        query = start_live(
            read_live(spark, folder, files_per_trigger=1), make_channels(spark), watch, params, sinks,
            scorer, str(tmp_path / "checkpoint"), "t", UNPACED, {"availableNow": True}, as_of,
            until=DAY + dt.timedelta(hours=20),
        )
        query.awaitTermination()
        return len(query.recentProgress)

    assert drain(source) >= 5
    kept = live_posts(make_posts(spark), watch, params, as_of, DAY + dt.timedelta(hours=20))
    kept = kept.where(F.col("message").isin("yes", "yes 2"))
    found = sorted((r.channel_id, r.msg_id, "live") for r in kept.collect())
    assert log_rows(spark, sinks) == [r for r in found if r[0] != 13]
    lost = spark.read.option("recursiveFileLookup", "true").parquet(sinks.quarantine).collect()
    assert sorted(r.msg_id for r in lost) == [m for c, m, _ in found if c == 13] != []
    # Nothing new, nothing repeated.
    drain(source)
    assert log_rows(spark, sinks) == [r for r in found if r[0] != 13]


def test_json_lines_equal_a_table_over_a_restart(spark, tmp_path):
    source, sinks = tmp_path / "lines", sinks_at(tmp_path)
    source.mkdir()
    watch = spark.createDataFrame([(10,), (11,), (13,)], schemas.WATCH)
    as_of = C.ntz(DAY + dt.timedelta(days=2))
    params = ScreeningParams(model=MODEL, rpm=0, max_age_s=36 * 3600)
    lines = [r[0] for r in make_posts(spark).select(F.to_json(F.struct("*"))).collect()]
    bad = ["", "null", "[1]", '{"channel_id":10}', '{"channel_id":"x","msg_id":1}', "{\"msg_id\":"]

    def drain():
        start_live(
            read_live_json(spark, str(source), files_per_trigger=1), make_channels(spark), watch, params,
            sinks, scorer, str(tmp_path / "checkpoint"), "j", UNPACED, {"availableNow": True}, as_of,
        ).awaitTermination()

    half = len(lines) // 2
    (source / "a.json").write_text("\n".join(lines[:half] + bad[:3]) + "\n")
    drain()
    (source / "b.json").write_text("\n".join(bad[3:] + lines[half:]) + "\n")
    drain()
    drain()
    kept = live_posts(make_posts(spark), watch, params, as_of).where(F.col("message").isin("yes", "yes 2"))
    want = sorted((r.channel_id, r.msg_id, "live") for r in kept.collect() if r.channel_id != 13)
    assert log_rows(spark, sinks) == want != []
    reader = spark.read.option("recursiveFileLookup", "true")
    assert sorted(r.malformed for r in reader.parquet(malformed_table(sinks)).collect()) == sorted(bad)


def test_history_is_pruned_by_day(spark, tmp_path):
    path = str(tmp_path / "by_day")
    write_posts_by_day(make_posts(spark), path)
    until = DAY + dt.timedelta(hours=40)
    history = read_history(spark, path, DAY + dt.timedelta(hours=20), until)
    plan = history._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "GreaterThanOrEqual(date" in plan
    want = make_posts(spark).where(
        (F.col("kind") == "message") & (F.col("date") >= C.ntz(DAY + dt.timedelta(hours=20)))
        & (F.col("date") < C.ntz(until))
    )
    assert sorted(r.msg_id for r in history.collect()) == sorted(r.msg_id for r in want.collect()) != []


def test_max_age_boundaries(spark):
    as_of = dt.datetime(2024, 1, 1, 12)
    ages = [900, 901, 0, -60]
    rows = [(i, as_of - dt.timedelta(seconds=a)) for i, a in enumerate(ages)]
    # Whole seconds count: 900.4 s before a whole second is 901 s of age.
    rows += [(4, as_of - dt.timedelta(seconds=900.4)), (5, as_of - dt.timedelta(seconds=899.6))]
    rows += [(6, C.EPOCH), (7, None), (8, C.EPOCH + dt.timedelta(seconds=1))]
    posts = spark.createDataFrame(rows, "msg_id INT, date TIMESTAMP_NTZ")
    kept = C.max_age(posts, C.ntz(as_of), 900).collect()
    assert sorted(r.msg_id for r in kept) == [0, 2, 3, 5, 6, 7]
    assert C.max_age(posts, C.ntz(as_of), 0).count() == len(rows)


def test_time_does_not_depend_on_the_session_zone(spark):
    # 02:30 on that day does not exist in the zone.
    as_of = dt.datetime(2024, 3, 10, 2, 30, 0, 400_000)
    rows = [(i, as_of - dt.timedelta(seconds=s)) for i, s in enumerate([899, 900.4, 901])]
    posts = spark.createDataFrame(rows, "msg_id INT, date TIMESTAMP_NTZ")
    zone = spark.conf.get("spark.sql.session.timeZone")
    for other in ("America/New_York", "Asia/Almaty", "UTC"):
        spark.conf.set("spark.sql.session.timeZone", other)
        try:
            kept = C.max_age(posts, C.ntz(as_of), 900).collect()
            now = spark.range(1).select(C.utc_now()).first()[0]
        finally:
            spark.conf.set("spark.sql.session.timeZone", zone)
        # The limit is 02:15:00.4, so the first whole second that is young enough is 02:15:01.
        assert [r.msg_id for r in kept] == [0]
        utc = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        assert abs(utc - now) < dt.timedelta(seconds=30)


def test_channels_of_the_watch_list(spark, tmp_path):
    path = str(tmp_path / "channels")
    make_channels(spark).write.parquet(path)
    watch = spark.createDataFrame([(10,), (99,)], schemas.WATCH)
    assert read_channels(spark, path).count() == 3
    assert [r.channel_id for r in read_channels(spark, path, watch).collect()] == [10]


def test_date_range_in_whole_seconds(spark):
    rows = [(0, DAY), (1, DAY + dt.timedelta(hours=1)), (2, DAY + dt.timedelta(minutes=59, seconds=59.9))]
    posts = spark.createDataFrame(rows, "msg_id INT, date TIMESTAMP_NTZ")
    since, until = DAY + dt.timedelta(seconds=0.7), DAY + dt.timedelta(hours=1, seconds=0.2)
    assert sorted(r.msg_id for r in C.date_range(posts, since, until).collect()) == [0, 2]


def test_cutover_loses_and_doubles_nothing(spark):
    posts = make_posts(spark)
    for hours in (0, 3, 24, 200):
        history, live = C.cutover(posts, DAY + dt.timedelta(hours=hours, seconds=0.5))
        ids = [r.msg_id for r in history.unionByName(live).collect()]
        assert sorted(ids) == list(range(1, 41))
        until = DAY + dt.timedelta(hours=hours, seconds=0.5)
        assert posts.where(C.before_cutover(until)).count() == history.count()
    undated = posts.withColumn("date", F.lit(None).cast("timestamp_ntz"))
    history, live = C.cutover(undated, DAY)
    assert (history.count(), live.count()) == (0, 40)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_beyond_the_bound_gives_the_same_rows(spark, how):
    facts = spark.range(500).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).alias("channel_id"),
        F.col("id").alias("msg_id"),
    )
    dim = spark.range(0, 40).select(F.col("id").alias("channel_id"), F.concat(F.lit("n"), "id").alias("name"))
    if how in ("left_semi", "left_anti"):
        dim = dim.select("channel_id")
    small = lookup.lookup_join(facts, dim, how)
    large = lookup.lookup_join(facts, dim, how, bound=lookup.BroadcastBound(bytes=0))
    wide = lookup.lookup_join(facts, dim, how, bound=lookup.BroadcastBound(bytes=20))
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect())) != []
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, wide.collect()))
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()


def test_oldest_first_spreads_a_hot_channel(spark):
    posts = spark.range(20_000).select(
        F.lit(1).alias("channel_id"), (F.hash("id") % 100_000).cast("bigint").alias("msg_id")
    )
    ordered = C.oldest_first(posts, partitions=8).withColumn("p", F.spark_partition_id())
    rows = ordered.collect()
    sizes = ordered.groupBy("p").count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 5_000
    assert [r.msg_id for r in rows] == sorted(r.msg_id for r in rows)


def test_marks_follow_scored_and_blank_posts_only(spark):
    rows = [(1, 5, False, None), (1, 9, False, "quota"), (2, 3, False, "no_text"), (3, 4, True, None), (3, 2, False, None)]
    processed = spark.createDataFrame(rows, "channel_id BIGINT, msg_id BIGINT, blank BOOLEAN, error STRING")
    old = spark.createDataFrame([(1, 7), (4, 1)], schemas.MARKS)
    got = {r.channel_id: r.last_msg_id for r in high_water(processed, old).collect()}
    assert got == {1: 7, 3: 4, 4: 1}


def test_backlog_takes_text_or_flag(spark):
    marks = spark.createDataFrame([(10, 20)], schemas.MARKS)
    posts = make_posts(spark)
    by_text = backlog_by_channel(posts, marks).collect()
    from siftline.functions.text import is_blank

    flagged = posts.withColumn("blank", is_blank(F.col("message"))).drop("message")
    assert sorted(by_text) == sorted(backlog_by_channel(flagged, marks).collect())
    assert sum(r.total for r in by_text) == 40


def test_match_log_lines(spark, tmp_path):
    hits = spark.createDataFrame([(10, 348, "<r> & удалёнка"), (77, 1, None)], "channel_id BIGINT, msg_id BIGINT, reason STRING")
    named = with_channel(hits, make_channels(spark))
    time = F.lit("2026-05-07 12:34:56").cast("timestamp")
    live = match_records(named.where("channel_found"), K.SOURCE_LIVE, time)
    log = all_matches(live, live)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    write_match_log(log, str(tmp_path / "log"), "all")
    write_match_log(log, None, "all")
    lines = [line for f in (tmp_path / "log" / "all").glob("*.json") for line in f.read_text().splitlines()]
    assert lines == [
        '{"time":"2026-05-07T12:34:56.000000Z","channel_id":10,"channel":"Ten","msg_id":348,'
        '"reason":"<r> & удалёнка","link":"https://t.me/ten/348","source":"live"}'
    ] * 2
    assert [tuple(r) for r in read_match_log(spark, str(tmp_path / "log")).collect()] == [tuple(r) for r in log.collect()]
    lost = quarantine(named, K.SOURCE_LIVE).collect()
    assert [(r.channel_id, r.reason, r.cause) for r in lost] == [(77, "", "channel_missing")]


def test_job_sweeps_then_goes_live_and_loses_nothing(spark, tmp_path):
    source, sinks = str(tmp_path / "posts"), sinks_at(tmp_path)
    make_posts(spark).write.parquet(source)
    times = [DAY + dt.timedelta(hours=40), DAY + dt.timedelta(hours=60)] * 2
    params = ScreeningParams(**{**PARAMS.__dict__, "max_age_s": 3600})

    def go(name):
        running = run_job(
            spark, spark.read.parquet(source), read_live(spark, source), make_channels(spark),
            params, sinks, scorer, str(tmp_path / name), name, UNPACED, {"availableNow": True},
            clock=lambda: times.pop(0), as_of=C.ntz(DAY + dt.timedelta(hours=61)),
        )
        running.live.awaitTermination()
        return running

    first = go("one")
    assert (first.watched, first.missing) == (4, 2)
    assert first.matched == len([r for r in log_rows(spark, sinks) if r[2] == "backfill"]) < first.analysed
    posts = make_posts(spark).where(
        (F.col("kind") == "message") & F.col("channel_id").isin(10, 11, 12)
        & F.col("message").isin("yes", "yes 2")
    )
    rows = posts.collect()
    until = DAY + dt.timedelta(hours=40)
    # A left channel is not swept; should it still post, the live flow takes it.
    history = [
        (r.channel_id, r.msg_id, "backfill") for r in rows if r.date < until and r.channel_id != 12
    ]
    live = [
        (r.channel_id, r.msg_id, "live") for r in rows if r.date >= until and r.peer_kind == "channel"
    ]
    assert log_rows(spark, sinks) == sorted(history + live) and live
    # A later start finds the sweep finished; posts that came while it ran are still no backlog.
    second = go("two")
    assert second.sweep.finished == first.sweep.finished
    assert log_rows(spark, sinks) == sorted(history + live + live)


def test_files_too_late_for_the_sweep_go_live_once(spark, tmp_path):
    source, sinks = str(tmp_path / "posts"), sinks_at(tmp_path)
    posts = make_posts(spark)
    late = F.col("msg_id").isin(18, 19)
    posts.where(~late).write.parquet(source)
    now = DAY + dt.timedelta(hours=40)
    params = ScreeningParams(**{**PARAMS.__dict__, "max_age_s": 600, "overlap_s": 5 * 3600})
    history = posts.where(~late)  # the listing of the moment the sweep began

    def go(name):
        run_job(
            spark, history, read_live(spark, source), make_channels(spark), params, sinks, scorer,
            str(tmp_path / name), name, UNPACED, {"availableNow": True},
            clock=lambda: now, as_of=C.ntz(DAY + dt.timedelta(hours=200)),
        ).live.awaitTermination()

    go("one")
    posts.where(late).write.mode("append").parquet(source)
    go("one")
    before = [r for r in log_rows(spark, sinks) if r[2] == "live" and r[1] < 20]
    kept = posts.where(late & (F.col("kind") == "message") & (F.col("peer_kind") == "channel"))
    want = [(r.channel_id, r.msg_id, "live") for r in kept.collect() if r.message in ("yes", "yes 2") and r.channel_id in (10, 11)]
    assert before == sorted(want) != []


def test_channels_added_while_the_stream_runs_are_seen(spark, tmp_path):
    source, sinks, table = str(tmp_path / "posts"), sinks_at(tmp_path), str(tmp_path / "channels")
    make_posts(spark).write.parquet(source)
    make_channels(spark).where("channel_id <> 11").write.parquet(table)
    watch = spark.createDataFrame([(10,), (11,)], schemas.WATCH)
    params = ScreeningParams(model=MODEL, rpm=0, max_age_s=0)

    def drain():
        start_live(
            read_live(spark, source), lambda: read_channels(spark, table), watch, params, sinks, scorer,
            str(tmp_path / "checkpoint"), "t", UNPACED, {"availableNow": True},
        ).awaitTermination()

    drain()
    assert {c for c, _, _ in log_rows(spark, sinks)} == {10}
    make_channels(spark).where("channel_id = 11").write.mode("append").parquet(table)
    make_posts(spark).withColumn("msg_id", F.col("msg_id") + 100).write.mode("append").parquet(source)
    drain()
    assert {c for c, _, _ in log_rows(spark, sinks)} == {10, 11}


def test_repeated_channel_rows_count_once(spark):
    hits = spark.createDataFrame([(10, 1, "r")], "channel_id BIGINT, msg_id BIGINT, reason STRING")
    twice = make_channels(spark).unionAll(make_channels(spark).withColumn("title", F.lit("A")))
    (row,) = with_channel(hits, twice).collect()
    assert row.title == "Ten"


def test_many_watched_ids_do_not_move_the_posts(spark):
    watch = spark.range(200_001).select(F.col("id").alias("channel_id"))
    plan = C.watched_only(make_posts(spark), watch)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_moments_with_a_zone_become_utc(spark):
    aware = dt.datetime(2024, 1, 1, 5, tzinfo=dt.timezone(dt.timedelta(hours=5)))
    assert spark.range(1).select(C.ntz(aware)).first()[0] == DAY


def test_state_rows(spark, tmp_path):
    sinks, now = sinks_at(tmp_path), DAY + dt.timedelta(days=2)
    sweep = run(spark, sinks, now, passes=1)
    SweepState(spark, sinks.state).write_state_rows(sweep, str(tmp_path / "rows"))
    rows = [json.loads(x) for f in (tmp_path / "rows").glob("*.json") for x in f.read_text().splitlines()]
    marks = {r.channel_id: r.last_msg_id for r in SweepState(spark, sinks.state).marks(sweep).collect()}
    assert {r["channel_id"]: r["last_msg_id"] for r in rows if "channel_id" in r} == marks
    assert [r for r in rows if "since" in r] == [{"since": "2024-01-01", "done": True}]


def test_settings():
    given = {"watch_csv": " 1,2 ", "destination": " @jobs", "rpm": "-3", "max_age_s": " 0 ", "since": "2026-04-17"}
    params = ScreeningParams.from_settings(given)
    assert (params.destination, params.rpm, params.max_age_s) == ("jobs", 25, 0)
    assert params.since == dt.date(2026, 4, 17)
    for bad in ({"destination": "me"}, {"watch_csv": "1"}, {**given, "since": "17.4.2026"}):
        with pytest.raises(ValueError):
            ScreeningParams.from_settings(bad)


def test_batch_cut_off_after_scoring_makes_no_call_twice(spark, tmp_path, monkeypatch):
    source, sinks = str(tmp_path / "posts"), sinks_at(tmp_path)
    make_posts(spark).write.parquet(source)
    watch = spark.createDataFrame([(10,), (11,)], schemas.WATCH)
    params = ScreeningParams(model=MODEL, rpm=0, max_age_s=0)

    def drain(make, checkpoint="checkpoint"):
        start_live(
            read_live(spark, source), make_channels(spark), watch, params, sinks, make,
            str(tmp_path / checkpoint), "t", UNPACED, {"availableNow": True},
        ).awaitTermination()

    with monkeypatch.context() as patch:
        patch.setattr(live_module, "deliver", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("cut")))
        with pytest.raises(Exception, match="cut"):
            drain(scorer)
    assert not (tmp_path / "log").exists()

    def never(system):
        def reply(text):
            raise AssertionError("called again")

        return reply

    drain(never)
    kept = live_posts(make_posts(spark), watch, params).where(F.col("message").isin("yes", "yes 2"))
    want = sorted((r.channel_id, r.msg_id, "live") for r in kept.collect())
    assert log_rows(spark, sinks) == want
    # Another checkpoint is another stream: its batch 0 is its own.
    drain(scorer, "other")
    assert log_rows(spark, sinks) == sorted(want * 2)


def test_failed_posts_wait_out_a_restart_and_come_once(spark, tmp_path):
    sinks, held = sinks_at(tmp_path), str(tmp_path / "checkpoint")
    rows = [(10, i, "yes fail" if i % 3 == 0 else "yes", 1, 12_000_000) for i in range(1, 7)]
    failed = spark.createDataFrame(rows, schemas.FAILED)
    write_part(failed, failed_table(sinks), "stream=a/batch=0")
    params = ScreeningParams(model=MODEL, rpm=0)

    def start():
        return start_retries(
            spark, make_channels(spark), params, sinks, scorer, held, "retries", UNPACED,
            {"processingTime": "200 milliseconds"}, attempts=2, pause_s=1,
        )

    def waiting(query):
        progress = query.lastProgress
        return sum(s.numRowsTotal for s in progress.stateOperators) if progress else 0

    query = start()
    while not waiting(query):
        time.sleep(0.1)
    query.stop()
    assert log_rows(spark, sinks) == []
    # The batch that wrote them is done again.
    write_part(failed, failed_table(sinks), "stream=a/batch=0-again")
    assert settle(start(), 200)
    tried = read_verdicts(spark, sinks.verdicts).groupBy("msg_id").count().collect()
    # Two tries of those that fail: attempt 1 and attempt 2.
    assert {r.msg_id: r["count"] for r in tried} == {1: 1, 2: 1, 3: 2, 4: 1, 5: 1, 6: 2}
    assert log_rows(spark, sinks) == [(10, i, "live") for i in (1, 2, 4, 5)]


@pytest.mark.parametrize("own", [None, "1m"])
def test_streams_hand_small_batches_to_python(spark, tmp_path, monkeypatch, own):
    sinks, seen = sinks_at(tmp_path), []
    make_posts(spark).write.parquet(str(tmp_path / "in"))

    def spied(module):
        score = module.score_posts

        def spy(posts, *args, **options):
            seen.append((module.__name__, posts.sparkSession.conf.get(ARROW_BYTES)))
            return score(posts, *args, **options)

        monkeypatch.setattr(module, "score_posts", spy)

    spied(live_module)
    spied(retries_module)
    if own:
        spark.conf.set(ARROW_BYTES, own)
    provider = spark.conf.get(retries_module._PROVIDER)
    try:
        start_live(
            read_live(spark, str(tmp_path / "in")), make_channels(spark), make_channels(spark).select("channel_id"),
            PARAMS, sinks, scorer, str(tmp_path / "live"), "l", UNPACED, {"availableNow": True}, as_of=F.lit(DAY), keep_failed=True,
        ).awaitTermination()
        retrying = start_retries(
            spark, make_channels(spark), PARAMS, sinks, scorer, str(tmp_path / "retries"), "r", UNPACED,
            {"processingTime": "200 milliseconds"}, attempts=2, wait_scale=0.001,
        )
        assert spark.conf.get(ARROW_BYTES, None) == own
        assert spark.conf.get(retries_module._PROVIDER) == provider
        assert settle(retrying, 200)
    finally:
        spark.conf.unset(ARROW_BYTES)
    limit = own or STREAM_ARROW_BYTES
    assert set(seen) == {(live_module.__name__, limit), (retries_module.__name__, limit)}


def test_waits_of_failed_posts(spark):
    calls = [(0, 429, "retry in 7s", 0)], [(0, 503, "down", 0)], [(0, 429, "slow", 0)]
    errors = (K.ERR_QUOTA, K.ERR_CALL_FAILED, K.ERR_QUOTA)
    rows = [(1, i, MODEL, None, c, None, None, e, "text") for i, (c, e) in enumerate(zip(calls, errors))]
    rows.append((1, 9, MODEL, "{}", [], False, "", None, None))
    verdicts = spark.createDataFrame(rows, schemas.VERDICTS)
    got = {r.msg_id: (r.attempt, r.wait_us) for r in failed_rows(verdicts, F.lit(2), pause_s=5).collect()}
    assert got == {0: (2, 8_000_000), 1: (2, 5_000_000), 2: (2, 81_000_000)}
