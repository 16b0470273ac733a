"""Tables written once, so that what reads them twice doesn't make them twice and a lost executor re-reads them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints, which all executors share.

    Only where none is named and all runs on one machine (tests) a temporary folder is set; a cluster
    without the setting is an error, since its executors share no local folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table of compressed columns in the shared folder; its partitions may become others."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept_in_place(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the shared folder: its partitions and the order within them stay as they are."""
    folder(df.sparkSession)
    return df.checkpoint()
