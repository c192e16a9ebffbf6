"""Cutting lineage: frames written in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a local folder, if driver and executors are one process, and else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        if at is None and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = at or tempfile.mkdtemp(prefix="siltstone-")
        spark.sparkContext.setCheckpointDir(at)
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return at or found.get()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read back: computed once, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/siltstone-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the JVM may be gone by now
        pass
