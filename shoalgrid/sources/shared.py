"""Intermediate tables in storage that every executor and the driver share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where that is unset the warehouse, which only a local session may fall back to."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/shoalgrid"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends here, and a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
