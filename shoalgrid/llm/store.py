"""Tables of intermediate results in storage that every executor and the driver share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting that shuffle files go when a query ends, not when the driver's garbage is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Spark's setting for the rows of a batch that goes to Python.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where that is unset the warehouse, which only a local session may fall back to."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/llm"


def written(df: DataFrame, tag: str, batch_rows: int | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends here, and a lost executor costs no recomputation.

    The shuffle files behind ``df`` have no reader any more after that, so Spark is told to delete them when the write ends.
    ``batch_rows``: rows in an Arrow batch meanwhile, where rows may be large.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    settings = {CLEANUP: "true"} | ({BATCH: str(batch_rows)} if batch_rows else {})
    before = {k: spark.conf.get(k, "false" if k == CLEANUP else "10000") for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def in_slices(batches: Iterator, rows: int = 500) -> Iterator:
    """Arrow batches as slices of ``rows`` rows, so that few texts at a time are Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def single_value(df: DataFrame, *exprs) -> tuple:
    """The one row of a global aggregate."""
    return tuple(df.agg(*exprs).first())


def words(text):
    r"""Words ``[^\x20\x09-\x0D]+`` of a text column, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")
