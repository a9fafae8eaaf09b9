"""Filters over posts, in the order cheap to costly.

Time bounds compare the raw column with whole-second limits, which equals a
comparison of truncated seconds and still reaches the Parquet reader.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftline import constants as K
from siftline.functions.text import is_blank
from siftline.operators.lookup import BroadcastBound, fits_broadcast, lookup_join, one_per_key
from siftline.session import store

EPOCH = dt.datetime(1970, 1, 1)


def ntz(moment: dt.datetime | dt.date | str) -> Column:
    """UTC literal without zone; a moment with a zone is converted."""
    if isinstance(moment, dt.datetime):
        if moment.tzinfo is not None:
            moment = moment.astimezone(dt.timezone.utc).replace(tzinfo=None)
        moment = moment.isoformat(sep=" ")
    return F.lit(str(moment)).cast("timestamp_ntz")


def utc_now() -> Column:
    """Current UTC time without zone, whatever the session zone is."""
    seconds = F.unix_micros(F.current_timestamp()).cast("decimal(24,0)") / F.lit(1_000_000)
    return ntz(EPOCH) + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def ordinary_only(posts: DataFrame) -> DataFrame:
    return posts.where(F.col("kind") == K.KIND_MESSAGE)


def channel_peer_only(posts: DataFrame) -> DataFrame:
    return posts.where(F.col("peer_kind") == K.PEER_CHANNEL)


def watched_only(
    posts: DataFrame, watch: DataFrame, bound: BroadcastBound = BroadcastBound()
) -> DataFrame:
    return lookup_join(posts, watch.select("channel_id"), "left_semi", bound=bound, stored=False)


def non_blank(posts: DataFrame) -> DataFrame:
    return posts.where(~is_blank(F.col("message")))


def max_age(
    posts: DataFrame,
    as_of: Column,
    seconds: int,
    exempt: tuple[dt.datetime, dt.datetime] | None = None,
) -> DataFrame:
    """Drop posts older than ``seconds`` at ``as_of``; 0 is off, undated posts stay.

    Posts dated within ``exempt`` (half-open) are never late. ``floor(date) >=
    limit`` is written as ``date >= ceil(limit)``.
    """
    if seconds == 0:
        return posts
    limit = as_of - F.make_dt_interval(secs=F.lit(seconds))
    past = F.extract(F.lit("SECOND"), limit) % F.lit(1)
    rest = F.when(past > 0, F.lit(1) - past).otherwise(F.lit(0))
    oldest = limit + F.make_dt_interval(secs=rest.cast("decimal(18,6)"))
    date = F.col("date")
    undated = date.isNull() | (date < ntz(EPOCH + dt.timedelta(seconds=1)))
    kept = undated | (date >= oldest)
    if exempt is not None:
        first, last = exempt
        kept = kept | ((date >= ntz(first)) & (date < ntz(last)))
    return posts.where(kept)


def date_range(
    posts: DataFrame, since: dt.datetime | dt.date, until: dt.datetime | dt.date
) -> DataFrame:
    """Half-open range in whole seconds; a ``day`` column prunes partitions."""
    start, end = whole_second(since), whole_second(until)
    if end < start:
        raise ValueError(f"history range: until ({end}) before since ({start})")
    if "day" in posts.columns:
        posts = posts.where(F.col("day").between(F.lit(start.date()), F.lit(end.date())))
    return posts.where((F.col("date") >= ntz(start)) & (F.col("date") < ntz(end)))


def whole_second(moment: dt.datetime | dt.date) -> dt.datetime:
    if not isinstance(moment, dt.datetime):
        moment = dt.datetime(moment.year, moment.month, moment.day)
    return moment.replace(microsecond=0)


def before_cutover(until: dt.datetime) -> Column:
    return F.coalesce(F.col("date") < ntz(whole_second(until)), F.lit(False))


def cutover(posts: DataFrame, until: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """Split once: history takes ``date < until``, live the rest, undated posts included."""
    limit = ntz(whole_second(until))
    date = F.col("date")
    return posts.where(date < limit), posts.where((date >= limit) | date.isNull())


def after_high_water(
    posts: DataFrame, marks: DataFrame | None, bound: BroadcastBound = BroadcastBound()
) -> DataFrame:
    """Keep posts above their channel's mark; a channel without mark starts at 0."""
    if marks is None:
        return posts.where(F.col("msg_id") > 0)
    marked = lookup_join(posts, marks.select("channel_id", "last_msg_id"), "left", bound=bound, stored=False)
    return marked.where(F.col("msg_id") > F.coalesce("last_msg_id", F.lit(0))).drop("last_msg_id")


def joined_only(channels: DataFrame) -> DataFrame:
    return channels.where(~F.coalesce("left", F.lit(False)))


def resolve_channels(watch: DataFrame, channels: DataFrame) -> DataFrame:
    """Watched channels the account is still in."""
    return joined_only(channels).join(watch.select("channel_id"), "channel_id", "left_semi")


def missing_channels(watch: DataFrame, channels: DataFrame) -> DataFrame:
    """Watched ids that do not resolve; reported, not fatal."""
    return watch.select("channel_id").join(
        joined_only(channels).select("channel_id"), "channel_id", "left_anti"
    )


def resolved_history(
    history: DataFrame, resolved: DataFrame, bound: BroadcastBound = BroadcastBound(), stored: bool = False
) -> DataFrame:
    """History of resolved channels only, with the channel's names. A ``stored`` table has a row per channel."""
    dim = resolved if stored else one_per_key(resolved.select("channel_id", "title", "username"))
    return lookup_join(history, dim, "inner", bound=bound, stored=stored)


def oldest_first(posts: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rising message ids within each channel.

    Range partitioning on channel and id keeps the order and splits a channel
    of any size over several tasks.
    """
    by = ["channel_id", "msg_id"]
    ranged = (
        posts.repartitionByRange(partitions, *by) if partitions else posts.repartitionByRange(*by)
    )
    return ranged.sortWithinPartitions(*by)


def places(posts: DataFrame, partitions: int | None = None) -> DataFrame:
    """``channel_id, msg_id, place``: 1, 2, ... by rising id within each channel.

    Two levels: the rows of ``oldest_first`` are stored, each partition tells
    how many rows of a channel it holds and where they begin, and sums over the
    earlier partitions (a row per channel and partition it meets) give the
    rest. A channel of any size covers as many tasks as it needs.
    """
    laid = oldest_first(posts.select("channel_id", "msg_id"), partitions)
    rows = store(laid.withColumn("_at", F.monotonically_increasing_id()), "places")
    # The id of a row is its partition and its row there.
    row = F.col("_at").bitwiseAND((1 << 33) - 1)
    rows = rows.withColumns({"_part": F.shiftright("_at", 33), "_row": row})
    own = rows.groupBy("channel_id", "_part").agg(F.min("_row").alias("_begin"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("channel_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    firsts = store(own.select(F.struct("channel_id", "_part").alias("_key"), (before - F.col("_begin")).alias("_shift")), "firsts")
    keyed = rows.withColumn("_key", F.struct("channel_id", "_part"))
    placed = keyed.join(F.broadcast(firsts), "_key") if fits_broadcast(firsts) else keyed.join(firsts, "_key")
    return placed.select("channel_id", "msg_id", (F.col("_row") + F.col("_shift") + 1).alias("place"))
