"""The folder that all executors share, and materialising in it."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a temporary folder, on one machine only (tests): a cluster without it is an error."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="wayfold-ckpt-"))
        found = sc._jsc.sc().getCheckpointDir()
    return found.get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder, which outlives any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """df as compressed Parquet in the shared folder, for large steps; the caller drops the path once nothing reads it."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove shuffle files that no plan in use refers to; it looks only when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()
