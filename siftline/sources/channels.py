"""The channel dimension and the watch list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftline.functions.scalars import normalize_channel_id
from siftline.functions.text import utrim


def read_channels(spark: SparkSession, path: str, watch: DataFrame | None = None) -> DataFrame:
    """Channels of the account; with ``watch``, only those wanted."""
    channels = spark.read.parquet(path).select("channel_id", "title", "username", "left")
    if watch is None:
        return channels
    return channels.join(watch.select("channel_id"), "channel_id", "left_semi")


def watch_ids(lists: DataFrame, column: str = "csv") -> DataFrame:
    """Distinct plain ids in comma lists; any entry that is no integer fails the job."""
    entry = utrim(F.col("entry"))
    number = F.when(entry.rlike(r"\A[+-]?[0-9]+\z"), entry.try_cast("bigint"))
    checked = F.coalesce(
        number,
        F.raise_error(F.concat(F.lit("invalid channel id: "), entry)).cast("bigint"),
    )
    return (
        lists.select(F.explode(F.split(F.col(column), ",")).alias("entry"))
        .where(entry != "")
        .select(normalize_channel_id(checked).alias("channel_id"))
        .distinct()
    )


def watch_list(spark: SparkSession, csv: str | None) -> DataFrame:
    """Watch list of one setting, checked in full at once; an empty result fails."""
    watch = watch_ids(spark.createDataFrame([(csv or "",)], "csv STRING"))
    if watch.count() == 0:
        raise ValueError("the watch list is empty")
    return watch
