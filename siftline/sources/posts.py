"""Posts as a bounded table or as a stream."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftline import schemas
from siftline.operators.screen import date_range, ordinary_only


def read_history(
    spark: SparkSession, path: str, since: dt.datetime | dt.date, until: dt.datetime | dt.date
) -> DataFrame:
    """Ordinary posts with ``since <= date < until``.

    A table stored by ``day`` is pruned to the days of the range.
    """
    return date_range(ordinary_only(spark.read.parquet(path)), since, until)


def write_posts_by_day(posts: DataFrame, path: str) -> None:
    """Append posts to a table partitioned by day, one writer task per range of posts."""
    dated = posts.withColumn("day", F.col("date").cast("date"))
    ranged = dated.repartitionByRange("day", "channel_id", "msg_id")
    ranged.write.mode("append").partitionBy("day").parquet(path)


def read_live(
    spark: SparkSession, path: str, schema: str = schemas.POSTS, files_per_trigger: int = 1000
) -> DataFrame:
    """Unbounded stream of new posts from Parquet files that appear below ``path``."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )


def parse_posts(raw: DataFrame) -> DataFrame:
    """``value`` (JSON posts) to posts with ``malformed``: the text of a row without a post key.

    Malformed rows have no ``kind``, so every filter of the flows drops them.
    The live flow stores them apart; elsewhere take those with ``malformed`` out before.
    """
    text = F.col("value").cast("string")
    parsed = raw.select(text.alias("_text"), F.from_json(text, schemas.POSTS).alias("post"))
    bad = F.col("post.channel_id").isNull() | F.col("post.msg_id").isNull()
    names = [part.split()[0] for part in schemas.POSTS.split(", ")]
    return parsed.select(
        *[F.when(~bad, F.col(f"post.{n}")).alias(n) for n in names],
        F.when(bad, F.coalesce("_text", F.lit(""))).alias("malformed"),
    )


def read_live_json(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """The same stream from files of JSON lines below ``path``, with ``malformed``.

    The live flow writes malformed lines to ``malformed_table``. Files are
    part of the checkpoint, so a restart neither loses nor repeats a line.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return parse_posts(lines)


def read_live_kafka(
    spark: SparkSession,
    servers: str,
    topic: str,
    since: dt.datetime | None = None,
    per_trigger: int = 100_000,
) -> DataFrame:
    """The same stream from a topic, from messages of ``since`` (UTC) or the first on.

    Needs Spark's Kafka package. A batch takes ``per_trigger`` messages at most.
    """
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("maxOffsetsPerTrigger", per_trigger)
    )
    if since is None:
        raw = raw.option("startingOffsets", "earliest")
    else:
        moment = since.replace(tzinfo=since.tzinfo or dt.timezone.utc)
        raw = raw.option("startingTimestamp", str(int(moment.timestamp() * 1000)))
        raw = raw.option("startingOffsetsByTimestampStrategy", "latest")
    return parse_posts(raw.load())
