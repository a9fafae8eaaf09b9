"""From stored verdicts to the output tables, in the order that matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftline.operators.lookup import BroadcastBound
from siftline.operators.matches import match_records, outbox_messages, quarantine, with_channel
from siftline.operators.verdicts import matches_only
from siftline.params import ScreeningParams, SinkPaths
from siftline.sinks.tables import write_match_log, write_part


def deliver(
    verdicts: DataFrame,
    channels: DataFrame,
    params: ScreeningParams,
    sinks: SinkPaths,
    source: str,
    part: str,
    time: Column | None = None,
    bound: BroadcastBound = BroadcastBound(),
    stored: bool = False,
) -> None:
    """Log first, then the outbox: a match is on record before it is announced.

    Each writer reads the matches of the stored table with its own columns only.
    """
    hits = with_channel(matches_only(verdicts), channels, bound, stored)
    found = hits.where(F.col("channel_found"))
    write_match_log(match_records(found, source, time), sinks.match_log, part)
    write_part(outbox_messages(found, params.destination), sinks.outbox, part)
    write_part(quarantine(hits, source), sinks.quarantine, part)
