"""What several operators share: stored steps, word rules, batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from siftline.session import scratch_path

#: Words are runs of anything but ASCII white space; ``bytes.split()`` cuts at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a Python step holds at a time, beside the Arrow batch itself.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: later steps start from stored rows."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``limit`` bytes as UTF-8, with their first row; null is empty."""
    column = texts.cast(pa.large_binary())
    lengths = column.fill_null(b"")
    sizes = pa.compute.binary_length(lengths).to_pylist()
    begin, held = 0, 0
    for at, size in enumerate(sizes):
        if held and held + size > limit:
            yield begin, lengths.slice(begin, at - begin).to_pylist()
            begin, held = at, 0
        held += size
    if begin < len(sizes):
        yield begin, lengths.slice(begin).to_pylist()


def packed(docs: DataFrame, *own: str) -> DataFrame:
    """``docs`` with the columns ``own`` that it has, and all others in one struct ``_others``.

    So a step may add columns of any name; ``unpacked`` brings the others back.
    """
    others = [c for c in docs.columns if c not in own]
    rest = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None).cast("int")
    return docs.select(*[c for c in own if c in docs.columns], rest.alias("_others"))


def unpacked(columns: list[str], own: tuple[str, ...]) -> list[Column]:
    """The columns of a packed table in their first order."""
    return [F.col(c) if c in own else F.col("_others").getField(c).alias(c) for c in columns]


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """``df`` stored with ``rank``: 0, 1, ... by ``order``, nulls last.

    Rows are range-partitioned and sorted, so no task sees them all; a small
    table of counts per partition gives where each partition begins.
    """
    spread = df.repartitionByRange(F.col(order).asc_nulls_last()).sortWithinPartitions(
        F.col(order).asc_nulls_last()
    )
    rows = store(spread.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    rank = F.col("_first") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return (
        rows.withColumn("_part", part)
        .join(firsts, "_part")
        .withColumn("rank", rank)
        .drop("_part", "_at", "_first")
    )
