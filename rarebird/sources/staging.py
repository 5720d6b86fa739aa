"""Intermediate tables on storage that all executors share.

A table read by several fits is written once and read back. That cuts the
lineage, survives the loss of executors, and lets later readers prune columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from math import ceil

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to storage that all executors share")
    return folder.rstrip("/")


#: Rows of a partition of rows to score, about.
SCORED_ROWS = 50_000

_written: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder on shared storage, remembered until ``drop_staged``."""
    parent = f"{shared_folder(spark)}/rarebird-{uuid.uuid4().hex}"
    _written.append(parent)
    return f"{parent}/{name}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_staged(spark: SparkSession) -> None:
    """Delete what this process has staged; nothing may read it any more."""
    while _written:
        _delete(spark, _written.pop())


class Chain:
    """Tables staged one after another, each from the last; what a link no longer needs is deleted.

    ``add`` computes ``make()``, writes its table and deletes everything staged on the
    way to it, the table before it included. One chain at a time may grow in a
    process, and no other thread may stage tables meanwhile.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.last: str | None = None

    def add(self, make: Callable[[], DataFrame], name: str) -> DataFrame:
        before = set(_written)
        table = stage(make(), name)
        last = _written[-1]
        for folder in [f for f in _written if f not in before and f != last or f == self.last]:
            _delete(self.spark, folder)
            _written.remove(folder)
        self.last = last
        return table


def stage(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to shared storage and return the table read back.

    Reading one value of the ``partition_by`` column leaves the others' files alone.
    """
    path = new_path(df.sparkSession, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, partitions: int, by: str) -> DataFrame:
    """The rows dealt by a hash column, in an order that only the rows decide.

    A fit that draws at random per partition gives the same model wherever and
    on however many cores it runs. Rows alike in ``by`` should be alike.
    """
    return df.repartition(partitions, by).sortWithinPartitions(by)


def spread(df: DataFrame) -> DataFrame:
    """The rows of a staged table in even partitions, for work that costs far more than moving a row.

    Its files are few and uneven, as the job before wrote them, and a scan's tasks follow
    bytes; their number here follows from the rows, which file footers tell.
    """
    return df.repartition(max(1, ceil(df.count() / SCORED_ROWS)))


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` computed once for all that reads it inside the block, in memory or on local disk; released behind it.

    Partitions of lost executors are computed again from what ``df`` reads.
    """
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()
