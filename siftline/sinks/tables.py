"""Match log, outbox, quarantine.

Each writer replaces one part folder below the table's path. A part belongs
to one slice of a sweep or one batch of a stream, so repeating that work after
a crash replaces its rows and never doubles or drops others. Rows are few next
to the posts they come from, so they are rebalanced into files of a fair size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftline import schemas
from siftline.params import SinkPaths
from siftline.sinks.packs import Layout, compact, read_parts

_TIME = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timeZone": "UTC"}
LOG = Layout(schemas.MATCHES, "json", _TIME)
OUTBOX = Layout(schemas.OUTBOX)
QUARANTINE = Layout(schemas.QUARANTINE)


def write_match_log(records: DataFrame, path: str | None, part: str) -> None:
    """One JSON object per line, in field order, no field left out. No path, no log."""
    if path is not None:
        LOG.write(records, f"{path}/{part}")


def read_match_log(spark: SparkSession, path: str) -> DataFrame:
    """All parts of the log; empty while nothing was logged."""
    return read_parts(spark, path, LOG)


def write_part(rows: DataFrame, path: str, part: str) -> None:
    rows.hint("rebalance").write.mode("overwrite").parquet(f"{path}/{part}")


def read_outbox(spark: SparkSession, path: str) -> DataFrame:
    return read_parts(spark, path, OUTBOX)


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    return read_parts(spark, path, QUARANTINE)


def compact_batches(spark: SparkSession, sinks: SinkPaths, stream: str, before: int, fan: int) -> None:
    """Pack the outputs of a stream's batches below number ``before``."""
    for path, layout in ((sinks.match_log, LOG), (sinks.outbox, OUTBOX), (sinks.quarantine, QUARANTINE)):
        if path is not None:
            compact(spark, f"{path}/{stream}", layout, lambda p: int(p.removeprefix("batch=")) < before, fan)
