"""Matches to log records, outbox messages and quarantine rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftline.functions.scalars import notification_text, post_link
from siftline.operators.lookup import BroadcastBound, lookup_join, one_per_key


def with_channel(
    matches: DataFrame, channels: DataFrame, bound: BroadcastBound = BroadcastBound(), stored: bool = False
) -> DataFrame:
    """Left join with the channel dimension; ``channel_found`` tells the two sides apart.

    A channel that has several rows counts once; a ``stored`` table has one each.
    """
    dim = channels if stored else one_per_key(channels.select("channel_id", "title", "username"))
    joined = lookup_join(matches, dim.withColumn("_found", F.lit(True)), "left", bound=bound, stored=stored)
    return joined.withColumn("channel_found", F.coalesce("_found", F.lit(False))).drop("_found")


def match_records(matches: DataFrame, source: str, time: Column | None = None) -> DataFrame:
    """The seven log columns of matches that have their channel's names."""
    moment = F.current_timestamp() if time is None else time
    return matches.select(
        moment.alias("time"),
        "channel_id",
        F.coalesce("title", F.lit("")).alias("channel"),
        "msg_id",
        F.coalesce("reason", F.lit("")).alias("reason"),
        post_link(F.col("username"), F.col("channel_id"), F.col("msg_id")).alias("link"),
        F.lit(source).alias("source"),
    )


def outbox_messages(matches: DataFrame, destination: str) -> DataFrame:
    """One rendered message per match, with an id that a rerun repeats."""
    link = post_link(F.col("username"), F.col("channel_id"), F.col("msg_id"))
    text = notification_text(
        F.col("title"), F.col("username"), F.col("reason"), F.col("message"), link
    )
    return matches.select(
        F.lit(destination).alias("destination"),
        text.alias("text"),
        F.xxhash64("channel_id", "msg_id").alias("dedup_id"),
    )


def quarantine(matches: DataFrame, source: str) -> DataFrame:
    """Matches whose channel is not in the dimension."""
    return matches.where(~F.col("channel_found")).select(
        "channel_id",
        "msg_id",
        F.coalesce("reason", F.lit("")).alias("reason"),
        F.lit(source).alias("source"),
        F.lit("channel_missing").alias("cause"),
    )


def all_matches(live: DataFrame, history: DataFrame) -> DataFrame:
    """One log of both sources, told apart by ``source``; duplicates stay."""
    return live.unionByName(history)
