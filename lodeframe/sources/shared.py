"""The folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_path(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir; where that is unset on one machine, as in tests,
    below a new temporary folder. A cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/lodeframe-{uuid.uuid4().hex}"


def keep_table(df: DataFrame) -> DataFrame:
    """df, written as Parquet in the shared folder and read again."""
    path = work_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
