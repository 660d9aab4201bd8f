"""Table scans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> None:
    """Sets the folder of spark.checkpoint.dir, unless one is set.  A local session may leave it open."""
    if spark._jsc.sc().getCheckpointDir().isEmpty():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(path or f"file://{tempfile.mkdtemp(prefix='checkpoints-')}")


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for tables of one run, beside the checkpoints."""
    checkpoint_folder(spark)
    return f"{spark._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex[:12]}"
