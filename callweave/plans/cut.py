"""Cut long plans: a table in the shared folder of ``spark.checkpoint.dir`` stands for what led to it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def place(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, until the application ends; local sessions may have a folder of their own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir names no folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="callweave-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    path = f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = place(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
