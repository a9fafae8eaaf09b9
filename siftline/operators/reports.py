"""Counts over posts and verdicts. All keys are pre-aggregated before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siftline.functions.text import is_blank
from siftline.operators.lookup import BroadcastBound, lookup_join


def backlog_by_channel(
    posts: DataFrame, marks: DataFrame, bound: BroadcastBound = BroadcastBound()
) -> DataFrame:
    """Per channel: posts in range, and those above the mark that are not blank.

    Takes ``blank`` if the input has it, so that text need not travel.
    """
    blank = F.col("blank") if "blank" in posts.columns else is_blank(F.col("message"))
    narrow = posts.select("channel_id", "msg_id", blank.alias("blank"))
    marked = lookup_join(narrow, marks.select("channel_id", "last_msg_id"), "left", bound=bound, stored=False)
    pending = (F.col("msg_id") > F.coalesce("last_msg_id", F.lit(0))) & ~F.col("blank")
    return marked.groupBy("channel_id").agg(
        F.count("*").alias("total"), F.count_if(pending).alias("pending")
    )


def run_summary_by_channel(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("channel_id").agg(
        F.count_if(F.col("error").isNull()).alias("analysed"),
        F.count_if(F.coalesce("match", F.lit(False))).alias("matched"),
    )


def run_summary(by_channel: DataFrame) -> DataFrame:
    return by_channel.agg(
        F.coalesce(F.sum("analysed"), F.lit(0)).alias("analysed"),
        F.coalesce(F.sum("matched"), F.lit(0)).alias("matched"),
    )


def high_water(processed: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """Per channel, the highest id that was scored or blank; errors do not raise it.

    ``processed`` has ``channel_id``, ``msg_id``, ``blank`` and ``error``.
    """
    done = F.col("blank") | F.col("error").isNull()
    seen = processed.where(done).select("channel_id", F.col("msg_id").alias("last_msg_id"))
    if marks is not None:
        seen = seen.unionByName(marks.select("channel_id", "last_msg_id"))
    return seen.groupBy("channel_id").agg(F.max("last_msg_id").alias("last_msg_id"))


def watch_coverage(watch: DataFrame, missing: DataFrame) -> DataFrame:
    """Number of watched ids and of those that do not resolve."""
    both = watch.select(F.lit(1).alias("w"), F.lit(0).alias("m")).unionAll(
        missing.select(F.lit(0).alias("w"), F.lit(1).alias("m"))
    )
    return both.agg(
        F.coalesce(F.sum("w"), F.lit(0)).cast("bigint").alias("watched"),
        F.coalesce(F.sum("m"), F.lit(0)).cast("bigint").alias("missing"),
    )


def error_counts(verdicts: DataFrame) -> DataFrame:
    return (
        verdicts.where(F.col("error").isNotNull())
        .groupBy("model", "error")
        .agg(F.count("*").alias("n"))
    )
