"""Streams of cells: the stateless projections and filters run on them as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalgrid.functions import indices, qa
from shoalgrid.functions.reflectance import landsat_reflectance


def read_cells(spark: SparkSession, path: str, schema) -> DataFrame:
    """Cells from Parquet files as they land in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def prepared(cells: DataFrame) -> DataFrame:
    """Valid cells with reflectance and NDWI, for a table or a stream."""
    valid = cells.filter(~qa.scl_invalid(F.col("scl")))
    bands = [landsat_reflectance(F.col(f"{b}_dn")).alias(b) for b in ("blue", "green", "red", "nir")]
    refl = valid.select("scene_id", "r", "c", *bands)
    return refl.withColumn("ndwi", indices.normalized_difference(F.col("green"), F.col("nir")))
