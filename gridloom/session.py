"""Session helpers shared by the library."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator
from contextlib import ExitStack, contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables; Spark's reader resolves the path, so any filesystem works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where it is unset, a session on one machine (local master, as in tests) gets a folder of its own; a cluster is an error,
    because its machines would each write to their own disk."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "gridloom-checkpoints")


def durable(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


@contextmanager
def kept_on_disk() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that keeps a table on the executors' disks until the block ends.

    Lost parts are made again from the lineage, so the table's rows must not depend on the order in which rows arrive. A
    checkpoint starts a process (chmod) for each file on a local file system without Hadoop's native library; this starts none."""
    with ExitStack() as stack:

        def keep(df: DataFrame) -> DataFrame:
            stack.callback(df.persist(StorageLevel.DISK_ONLY).unpersist)
            df.count()
            return df

        yield keep


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder through the session's file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
