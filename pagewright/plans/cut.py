"""Cutting a plan's lineage with files that every executor can read."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where none is set, a temporary one, but only when all runs in one process."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="pagewright-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read back from a checkpoint.

    Its files go with the DataFrame where the session has
    spark.cleaner.referenceTracking.cleanCheckpoints, else with the folder.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written as Parquet in the shared folder and read back: smaller than a checkpoint for wide rows.

    The table stays until ``release`` or until the folder is cleared.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.parquet(path)
    back._pagewright_path = path
    return back


def release(df: DataFrame) -> None:
    """Deletes the table of ``stored``, once nothing reads it any more; other DataFrames are left alone."""
    path = getattr(df, "_pagewright_path", None)
    if path:
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def sweep(spark: SparkSession) -> None:
    """Files of shuffles that no DataFrame needs any more go now, not when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
