import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from siftline.functions.replies import parse_replies
from siftline.operators.scoring import (
    PIECE_BYTES,
    PIECE_ROWS,
    CallFailed,
    CallPolicy,
    _call,
    _Pacer,
    call_log,
    score_posts,
    store_replies,
)

# The workers do not have the tests on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

POSTS = "channel_id BIGINT, msg_id BIGINT, message STRING"


def no_sleep(seconds):
    return None


def flaky_scorer(system):
    assert system == ""
    seen = {}

    def reply(text):
        post = text.split("POST:\n")[1].split("\n---")[0]
        seen[post] = seen.get(post, 0) + 1
        if post == "busy" and seen[post] < 3:
            raise CallFailed(429, "retry in 2s")
        if post == "always busy":
            raise CallFailed(500, "RESOURCE_EXHAUSTED")
        if post == "down":
            raise CallFailed(503, "down")
        if post == "bug":
            raise ValueError("boom")
        if post == "silent":
            return None
        return f"MATCH: yes\nREASON: {post}"

    return reply


def test_every_row_ends_as_reply_or_error(spark, tmp_path):
    texts = [" fine ", "busy", "always busy", "down", "bug", "silent", " \n", None]
    posts = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], POSTS)
    policy = CallPolicy(rpm=25, tasks=2, sleep=no_sleep)
    stored = store_replies(
        score_posts(posts, flaky_scorer, policy=policy), str(tmp_path / "replies")
    )
    got = {r.msg_id: (r.match, r.reason, r.error) for r in parse_replies(stored).collect()}
    assert got == {
        0: (True, "fine", None),
        1: (True, "busy", None),
        2: (None, None, "quota"),
        3: (None, None, "call_failed"),
        4: (None, None, "call_failed"),
        5: (None, None, "empty_response"),
        6: (None, None, "empty_post"),
        7: (None, None, "empty_post"),
    }
    log = {}
    for r in call_log(stored).collect():
        log.setdefault(r.msg_id, []).append((r.attempt, r.code, r.wait_us))
    second = 1_000_000
    assert log == {
        1: [(0, 429, 3 * second), (1, 429, 3 * second)],
        2: [(0, 500, 11 * second), (1, 500, 21 * second), (2, 500, 41 * second), (3, 500, 0)],
        3: [(0, 503, 0)],
        4: [(0, 0, 0)],
    }


def test_no_rate_no_shuffle(spark):
    posts = spark.createDataFrame([(1, 1, "x")], POSTS)
    plan = score_posts(posts, flaky_scorer, policy=CallPolicy(rpm=0))
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def held_scorer(system):
    held = [0]

    class Reply(str):
        def __del__(self):
            held[0] -= 1

    def reply(text):
        held[0] += 1
        return Reply(held[0])

    return reply


@pytest.mark.parametrize(("n", "size"), [(5000, 8), (400, PIECE_BYTES // 16), (3, 2 * PIECE_BYTES)])
def test_a_task_holds_few_replies_at_a_time(spark, n, size):
    text = F.concat(F.lpad(F.col("id").cast("string"), 8, "0"), F.repeat(F.lit("x"), size - 8))
    posts = spark.range(0, n, 1, 1).select(F.lit(1).alias("channel_id"), F.col("id").alias("msg_id"), text.alias("message"))
    scored = score_posts(posts, held_scorer, "json-1", CallPolicy(rpm=0), rules="r", keep_post=True)
    rows = scored.select("channel_id", "msg_id", "raw", "error", F.left("post", F.lit(8)).alias("id"), F.length("post").alias("n")).collect()
    assert sorted((r.channel_id, r.msg_id, r.error, int(r.id), r.n) for r in rows) == [(1, i, None, i, size) for i in range(n)]
    # The replies of a piece go as those of the next one are there.
    assert max(int(r.raw) for r in rows) <= 2 * max(1, min(PIECE_ROWS, PIECE_BYTES // size))


def test_pacing_takes_a_slot_per_attempt():
    clock, slept = [0.0], []

    def sleep(seconds):
        slept.append(seconds)
        clock[0] += seconds

    policy = CallPolicy(rpm=60, sleep=sleep, clock=lambda: clock[0])
    pacer = _Pacer(1_000_000, 0, 1, policy)
    fails = iter([True, False, False])

    def scorer(text):
        if next(fails):
            raise CallFailed(429, "retry in 0.1s")
        return "ok"

    assert _call(scorer, "a", pacer, policy)[0] == "ok"
    assert _call(scorer, "b", pacer, policy)[0] == "ok"
    # The wait after the quota error passes the second slot; each later call waits for its own.
    assert [round(s, 3) for s in slept] == [1.1, 0.9, 1.0]


def clock_scorer(system):
    return lambda text: repr(time.time())


def test_the_rate_holds_over_tasks_and_batches(spark):
    posts = spark.range(20).select(
        F.lit(1).cast("bigint").alias("channel_id"), F.col("id").alias("msg_id"), F.lit("x").alias("message")
    )
    policy = CallPolicy(rpm=1200, tasks=5)
    calls = [float(r.raw) for _ in range(4) for r in score_posts(posts, clock_scorer, "json-1", policy).collect()]
    assert len(calls) == 80
    # A slot every 0.05 s, each taken once: 79 gaps at least.
    assert max(calls) - min(calls) >= 79 * 0.05 - 0.02
    assert len({round(c / 0.05 - 0.4) for c in calls}) == 80


def test_lanes_never_share_a_slot():
    now, taken = [0.0], []
    policy = CallPolicy(sleep=lambda s: taken.append(round((now[0] + s) * 1e6)), clock=lambda: now[0])
    pacers = [_Pacer(100_000, lane, 4, policy) for lane in range(4)]
    for turn in range(50):
        now[0] = 0.01 + turn * 0.037
        pacers[turn * 7 % 4].wait()
    slots = [round(t / 100_000) for t in taken]
    assert len(set(slots)) == len(slots) == 50
    assert all(abs(t - s * 100_000) <= 1 for t, s in zip(taken, slots))


def brief_scorer(system):
    return lambda text: f"{system}|{text}"


def test_models_with_system_text_get_the_brief(spark):
    posts = spark.createDataFrame([(1, 1, " post ")], POSTS)
    policy = CallPolicy(rpm=0)
    (row,) = score_posts(posts, brief_scorer, "json-1", policy, rules="A LONG BRIEF").collect()
    system, text = row.raw.split("|")
    assert system.startswith("A LONG BRIEF\n") and text == "post"
    (row,) = score_posts(posts, brief_scorer, "gemma-1", policy, rules="A LONG BRIEF").collect()
    assert row.raw.startswith("|A LONG BRIEF\n")


def test_a_hint_beyond_all_bounds_falls_back():
    def scorer(text):
        raise CallFailed(429, "retry in " + "9" * 400 + "s")

    policy = CallPolicy(rpm=0, sleep=no_sleep)
    _, error, calls = _call(scorer, "a", _Pacer(0, 0, 1, policy), policy)
    assert error == "quota" and [c[3] for c in calls] == [11_000_000, 21_000_000, 41_000_000, 0]
