"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path below spark.checkpoint.dir, or, on a local master without one, below a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if sc.applicationId not in _OWN:
            _OWN[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="cuewright-")
        found = _OWN[sc.applicationId]
    return f"{found.rstrip('/')}/cuewright/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: rows that several plans use are worked out once, also after executors are lost."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
