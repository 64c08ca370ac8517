"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings every job here relies on (naive times are UTC, AQE splits skewed joins)."""
    for key, value in RECOMMENDED.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="newsloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark)}/newsloom/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate rows that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write the rows to the shared folder and read them back as a table.

    For results that are used more than once or sorted globally (a sort reads its input twice, once to sample ranges):
    the work behind them is done once, a lost executor costs a read, and the table has a measured size, by which
    Spark decides whether to broadcast it.
    """
    folder = new_folder(df.sparkSession, label)
    for staged in getattr(_PASSING, "lists", [])[-1:]:
        staged.append(folder)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


_PASSING = threading.local()  # .lists: the folders staged so far in each open ``settle`` of this thread


def settle(spark: SparkSession, make: Callable[[], DataFrame], label: str = "stage") -> DataFrame:
    """``stage`` of what ``make`` returns; what was staged on the way there is deleted, since nothing reads it any more."""
    lists = _PASSING.__dict__.setdefault("lists", [])
    lists.append([])
    try:
        df = make()
        passing = list(lists[-1])
    finally:
        lists.pop()
    kept = stage(df, label)
    for folder in passing:
        remove(spark, folder)
    return kept


def cut_lineage(df: DataFrame) -> DataFrame:
    """As ``stage``, but keeping partitions and the order in them."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


READ_PARTITIONS = "newsloom.read.partitions"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition a table that was read, if the session says into how many parts; as it is otherwise.

    One row group is read by one task, however many cores there are. Whoever runs a job on a few large row groups may
    set ``newsloom.read.partitions``; it is never decided by the size of a table.
    """
    parts = df.sparkSession.conf.get(READ_PARTITIONS, None)
    return df.repartition(int(parts), key) if parts else df
