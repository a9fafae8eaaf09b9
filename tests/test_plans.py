"""What the plans must and must not do, with Spark's own broadcasts off."""

import pytest
from pyspark.sql import functions as F

from siftline.plans import tables as T
from siftline.operators import lookup
from siftline.operators import screen as C
from siftline.plans.registry import QUERIES, SINCE, UNTIL

SF_DIR = "/root/testdata/sf0.001"
WRITERS = {"outbox", "match_log", "stream_matches", "backfill_matches", "progress_marks", "sweep_summary", "sweep_totals", "resumed_sweep", "retried_sweep", "retried_stream"}
ROW_LOCAL = (
    "verdicts", "two_line_verdicts", "json_verdicts", "page_objects", "rule_screening",
    "lexicon_hits", "scored_posts", "excerpts", "diagnostics", "prompt_requests",
    "destination_class", "retry_waits", "channel_ids", "response_texts",
)


@pytest.fixture(autouse=True)
def no_automatic_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in WRITERS])
def test_no_cross_join_and_no_single_task(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name not in ("run_summary", "watch_coverage"):
        assert "SinglePartition" not in text


@pytest.mark.parametrize("name", ROW_LOCAL)
def test_row_local_work_moves_nothing(spark, name):
    assert "Exchange" not in plan(QUERIES[name](spark, SF_DIR))


def test_date_bounds_reach_the_reader(spark):
    kept = plan(C.date_range(T.updates(spark, SF_DIR), SINCE, UNTIL))
    assert "GreaterThanOrEqual(ts,2024-01-02T00:00)" in kept and "LessThan(ts,2024-01-03T00:00)" in kept
    fresh = plan(C.max_age(T.updates(spark, SF_DIR), C.ntz(SINCE), 900))
    assert "GreaterThanOrEqual(ts,2024-01-01T23:45)" in fresh


def test_matches_join_small_tables_only(spark):
    text = plan(QUERIES["match_records"](spark, SF_DIR))
    scan = "FileScan parquet [doc_id"
    assert text.count(scan) == 1
    # From the scan of the texts up to the top there is a broadcast join and no exchange.
    above = text[: text.index(scan)]
    assert "Exchange" not in above and "BroadcastHashJoin" in above


def test_reports_aggregate_before_the_shuffle(spark):
    for name in ("backlog_by_channel", "reply_errors", "retry_plans", "high_water"):
        text = plan(QUERIES[name](spark, SF_DIR))
        assert "partial_" in text and "SortAggregate" not in text


def test_texts_without_a_match_do_not_move(spark):
    """Within the bound matches go to the texts; beyond it a Bloom filter does, and what passes it moves."""
    text = plan(QUERIES["notification_texts"](spark, SF_DIR))
    scan = text.rindex("FileScan parquet [doc_id")
    assert "Exchange" not in text[:scan].replace("BroadcastExchange", "")
    posts = spark.range(20_000).selectExpr("id % 7 AS channel_id", "id AS msg_id", "repeat('x', 50) AS message")
    few = posts.where("msg_id % 40 = 3").select("channel_id", "msg_id", F.lit("r").alias("reason"))
    want = sorted((r.msg_id, r.reason) for r in few.collect())
    for size in (64 << 20, 20_000):
        joined = lookup.wide_join(posts, few, ["channel_id", "msg_id"], lookup.BroadcastBound(size))
        assert sorted((r.msg_id, r.reason) for r in joined.collect()) == want
    words = len(want) * lookup.BITS_PER_KEY // 64
    bits = lookup.bloom_words(few, ["channel_id", "msg_id"], words)
    passed = lookup.may_hold(posts, bits, ["channel_id", "msg_id"], words)
    assert len(want) <= passed.count() < 2 * len(want)
    assert passed.join(few, ["channel_id", "msg_id"], "left_semi").count() == len(want)
    above = plan(passed)
    assert "Exchange" not in above[: above.index("Range (0, 20000")].replace("BroadcastExchange", "").split("BroadcastHashJoin")[0]


def test_few_hot_keys_are_spread_and_others_are_not(spark):
    facts = spark.range(30_000).selectExpr("IF(id % 3 = 0, 1, id % 9000) AS channel_id", "id AS msg_id")
    heavy = lookup.heavy_hitters(facts, "channel_id", 1 / 128)
    hot = spark.range(1, 2).select(F.xxhash64(F.col("id"))).first()[0]
    assert hot in heavy and len(heavy) <= 128
    dim = spark.range(9000).selectExpr("id AS channel_id", "concat('n', id) AS title")
    joined = lookup.lookup_join(facts, dim, "left", bound=lookup.BroadcastBound(0))
    assert joined.count() == 30_000 and joined.where("title <> concat('n', channel_id)").count() == 0
    # Rows of the dimension after the salt: the hot keys' alone are repeated.
    text = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" in text and "Join LeftOuter" in text


def test_places_need_no_group_of_a_channel(spark):
    posts = spark.range(9_000).selectExpr("IF(id % 3 = 0, 5, id % 40) AS channel_id", "xxhash64(id) AS msg_id")
    frame = C.places(posts, partitions=16)
    got = {(r.channel_id, r.msg_id): r.place for r in frame.collect()}
    want, seen = {}, {}
    for r in sorted(posts.collect()):
        seen[r.channel_id] = seen.get(r.channel_id, 0) + 1
        want[(r.channel_id, r.msg_id)] = seen[r.channel_id]
    assert got == want
    assert "Window" not in plan(frame)
    assert C.places(posts.limit(0)).collect() == []
