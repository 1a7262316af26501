"""Interim tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application within spark.checkpoint.dir; a local session without that setting gets one of its own, a cluster an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _own[:] = _own or [tempfile.mkdtemp(prefix="spark-", dir="/tmp")]
        at = _own[0]
    return f"{at.rstrip('/')}/tallyweave-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
