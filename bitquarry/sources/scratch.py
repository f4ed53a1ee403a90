"""Tables between the steps of an iteration, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset and the master is local, below one of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="bitquarry-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/step-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df written and read back: what follows starts from the table, on any executor."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Removes tables that ``saved`` wrote and nothing reads any more."""
    for t in tables:
        files = t.inputFiles()
        if files:
            path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
