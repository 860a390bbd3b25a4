"""Cutting lineage in the folder that a cluster names for it."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a new one of our own only where that is unset and all runs on this machine."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if not named and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """df with its lineage cut, kept in spark.checkpoint.dir; a folder of our own only where that setting is unset."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager)


#: Folders of the tables that this process has written and not yet removed, with the session of each.
_tables: list[tuple[SparkSession, str]] = []


def written(df: DataFrame, by: str | None = None) -> DataFrame:
    """df as it is read again from a compressed table in the shared folder, one part for each value of `by`, so that what filters
    by it reads these alone. For rows that a checkpoint would hold in full. The table stays until `release`, or the end of the process."""
    folder = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    _tables.append((df.sparkSession, folder))
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder).select(*df.columns)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder, wherever its file system is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Removes the tables that operators have written in this session. What they returned can't be read after that."""
    for session, folder in [x for x in _tables if x[0] is spark]:
        remove(spark, folder)
        _tables.remove((session, folder))


@atexit.register
def _release_all() -> None:
    for session in {id(s): s for s, _ in _tables}.values():
        with contextlib.suppress(Exception):  # a session that was stopped can't remove anything
            release(session)
