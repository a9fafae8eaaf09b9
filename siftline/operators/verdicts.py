"""Posts with replies, and the matches among them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftline import constants as K
from siftline import schemas
from siftline.functions.replies import parse_replies
from siftline.operators.lookup import BroadcastBound, wide_join
from siftline.session import path_exists

KEY = ["channel_id", "msg_id"]


def with_verdicts(posts: DataFrame, replies: DataFrame) -> DataFrame:
    """Left join of posts with parsed replies; a post without reply is an error.

    Replies are parsed before the join, so raw text is not shuffled.
    """
    verdicts = parse_replies(replies).select(
        *KEY, "model", "match", "reason", F.col("error").alias("_error"), F.lit(True).alias("_hit")
    )
    joined = posts.join(verdicts, KEY, "left")
    error = F.when(F.col("_hit").isNull(), K.ERR_NO_REPLY).otherwise(F.col("_error"))
    return joined.withColumn("error", error).drop("_error", "_hit")


def store_verdicts(scored: DataFrame, path: str) -> DataFrame:
    """Write scored posts with their verdicts once, and read them back.

    Takes rows scored with ``keep_post``. The text stays with matches and failed
    calls, so what follows needs no second scan of the posts and no join with them.
    """
    parsed = parse_replies(scored, keep=("raw", "calls"))
    text = F.when(F.coalesce(F.col("match"), F.lit(False)) | failed_calls(), F.col("post"))
    parsed.withColumn("message", text).drop("post").write.mode("overwrite").parquet(path)
    return read_verdicts(scored.sparkSession, path)


def verdicts_once(spark: SparkSession, path: str, score: Callable[[], DataFrame]) -> DataFrame:
    """Stored verdicts if ``path`` is complete, else score and store.

    Work repeated after a failure so makes no model call twice.
    """
    if path_exists(spark, f"{path}/_SUCCESS"):
        return read_verdicts(spark, path)
    return store_verdicts(score(), path)


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.schema(schemas.VERDICTS).option("recursiveFileLookup", "true")
    return reader.parquet(path)


def failed_calls() -> Column:
    """True for verdicts whose model call failed: those a retry may mend."""
    return F.coalesce(F.col("error").isin(K.ERR_QUOTA, K.ERR_CALL_FAILED), F.lit(False))


def matches_only(verdicts: DataFrame) -> DataFrame:
    return verdicts.where(F.col("match"))


def matched_posts(
    posts: DataFrame, replies: DataFrame, bound: BroadcastBound = BroadcastBound()
) -> DataFrame:
    """Matches with their post. Replies are parsed and filtered once, and texts of other posts stay put."""
    hits = matches_only(parse_replies(replies)).select(*KEY, "model", "reason")
    return wide_join(posts, hits, KEY, bound)
