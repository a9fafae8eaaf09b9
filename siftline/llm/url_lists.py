"""URL filters whose lists change over time.

A list is dated entries: from that time on, a pattern is blocked, allowed, or
no longer listed. Entries of a pattern become validity intervals, and every
capture is judged by the entries that were active when it was fetched. The
most specific active pattern decides; of equal ones, a block.

Patterns are a host with or without the start of a path: ``example.com``
covers its subdomains, ``www.example.com/en/`` what lies below that path. So
every capture has a bounded set of patterns that can cover it, and the as-of
join is an equi-join on the pattern with the time looked up in its intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftline.llm.common import store
from siftline.operators.lookup import lookup_join


def validity_intervals(entries: DataFrame) -> DataFrame:
    """``pattern, since, action`` to ``pattern, spans``: ordered (since, until, action), unlisted ones left out.

    An entry holds until the next of its pattern, the last for ever. Of entries
    of one time the greatest action counts (block, then allow, then others).
    Entries without pattern or time are ignored; a null or unknown action ends
    the listing. Patterns are lower-cased and lose a trailing dot of the host.
    """
    rank = F.when(F.col("action") == "block", 2).when(F.col("action") == "allow", 1).otherwise(0)
    once = (
        entries.where("pattern IS NOT NULL AND since IS NOT NULL")
        .select(normal_pattern(F.col("pattern")).alias("pattern"), "since", rank.alias("rank"))
        .groupBy("pattern", "since").agg(F.max("rank").alias("rank"))
    )
    next_ = F.lead("since").over(Window.partitionBy("pattern").orderBy("since"))
    spans = once.withColumn("until", next_).where("rank > 0")
    span = F.struct("since", "until", F.when(F.col("rank") == 2, "block").otherwise("allow").alias("action"))
    # As many as one pattern has entries.
    return spans.groupBy("pattern").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def normal_pattern(pattern: Column) -> Column:
    host = F.regexp_replace(F.lower(F.regexp_extract(pattern, "^([^/]*)", 1)), r"\.$", "")
    return F.concat(host, F.regexp_extract(pattern, "^[^/]*(.*)$", 1))


def url_host(url: Column) -> Column:
    """Host in lower case without user, port and trailing dot; '' if there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(F.lower(host), r"\.$", "")


def url_patterns(url: Column) -> Column:
    """Patterns that can cover a URL: each domain its host lies in, and each start of its path there."""
    labels = F.split(url_host(url), r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    steps = F.split(path, "/", -1)
    m = F.size(steps)
    folders = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), m - 1)),
        lambda i: F.concat(F.array_join(F.slice(steps, 1, i), "/"), F.lit("/")),
    )
    starts = F.when(path == "", F.array(F.lit(""))).otherwise(
        F.array_distinct(F.concat(F.array(F.lit("")), folders, F.array(path)))
    )
    own = F.flatten(F.transform(domains, lambda d: F.transform(starts, lambda s: F.concat(d, s))))
    return F.when(url.isNull() | (url_host(url) == ""), F.array().cast("array<string>")).otherwise(own)


def judge(captures: DataFrame, entries: DataFrame, id_column: str) -> DataFrame:
    """``id, url, fetched`` to ``id, fetched, pattern, action, blocked``; captures without id are their own rows.

    ``pattern`` and ``action`` are null and ``blocked`` false where no active
    pattern covers the URL, the URL is null or has no host, or the time is
    null. Repeated rows are judged each by itself. Only patterns and times are
    joined; captures that share a pattern are dealt out by a hash of the row,
    so a host with a third of all captures is no single task.
    """
    rows = store(
        captures.select(F.col(id_column).alias("_id"), "url", "fetched").withColumn(
            "_row", F.monotonically_increasing_id()
        ),
        "captures",
    )
    lists = store(validity_intervals(entries), "lists")
    keys = rows.where("fetched IS NOT NULL").select("_row", "fetched", F.explode(url_patterns(F.col("url"))).alias("pattern"))
    active = F.filter(
        "spans",
        lambda s: (s["since"] <= F.col("fetched")) & (s["until"].isNull() | (s["until"] > F.col("fetched"))),
    )
    found = (
        lookup_join(keys, lists, "inner", key="pattern", spread="_row")
        .withColumn("span", F.get(active, 0))
        .where("span IS NOT NULL")
    )
    # More labels of the host and more of the path both make the pattern longer.
    weight = F.struct(F.char_length("pattern"), F.col("span.action"), F.col("pattern"))
    verdicts = found.groupBy("_row").agg(
        F.max_by(F.struct("pattern", F.col("span.action").alias("action")), weight).alias("v")
    )
    return rows.join(verdicts, "_row", "left").select(
        F.col("_id").alias(id_column),
        "fetched",
        F.col("v.pattern").alias("pattern"),
        F.col("v.action").alias("action"),
        F.coalesce(F.col("v.action") == "block", F.lit(False)).alias("blocked"),
    )
