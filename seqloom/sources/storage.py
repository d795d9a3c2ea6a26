"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: str | None = None


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; a temporary folder for local sessions without one."""
    global _local
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and spark.sparkContext.master.startswith("local["):
        _local = _local or f"file://{tempfile.mkdtemp(prefix='seqloom-')}"
        found = _local
    return (found or spark.conf.get("spark.sql.warehouse.dir") + "/_shared").rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once: written below the shared folder and read again."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
