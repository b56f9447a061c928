"""The folder that the driver and all executors share, and results kept there."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without one gets a folder of its own, a cluster without one an error."""
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = "/tmp/checkpoints/tessella"
    return d.rstrip("/")


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder's name below the shared one; it is deleted when the application ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def materialise(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """The rows as Parquet in the shared folder: computed once, and not again when an executor is lost."""
    path = shared_folder(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
