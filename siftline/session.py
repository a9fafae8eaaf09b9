"""Session helpers: where shared scratch data and checkpoints live."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: The most bytes of an Arrow batch that Spark hands to Python, and what streams start with where none is set.
ARROW_BYTES, STREAM_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


@contextmanager
def stream_settings(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Settings for the stream started within; it keeps a copy of them, and the session gets its own back.

    Batches for Python are small, so that what workers hold does not depend on how many posts a batch
    of the stream has.
    """
    settings = {ARROW_BYTES: spark.conf.get(ARROW_BYTES, STREAM_ARROW_BYTES), **settings}
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def shared_root(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    root = tempfile.mkdtemp(prefix="siftline-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later stages read stored rows in a fixed layout."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint(eager=True)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again, so that its plan runs once however often it is used."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def files_below(spark: SparkSession, path: str) -> list[str]:
    """All files below a folder, hidden ones too, as paths relative to it; none if there is no folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(target):
        return []
    root = system.makeQualified(target).toUri().getPath().rstrip("/") + "/"
    found, names = system.listFiles(target, True), []
    while found.hasNext():
        names.append(found.next().getPath().toUri().getPath().removeprefix(root))
    return names


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete what a job of ours stored at ``path``."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
