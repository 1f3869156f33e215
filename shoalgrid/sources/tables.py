"""Reading and writing tables of cells, points and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalgrid.functions.geo import Grid

#: Rows and columns of a tile in storage: half a million cells or so a file.
TILE_ROWS = 700

NUMBERS = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "bigint", "float": "double", "double": "double"}


def read(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    """A table of cells or points from Parquet, ORC, CSV (with a header) or JSON."""
    reader = spark.read.options(**({"header": True} if kind == "csv" else {}) | options)
    return reader.format(kind).load(path)


def write_depth_product(cells: DataFrame, path: str, kind: str = "double", partition: str | None = "year") -> None:
    """A depth map as Parquet in the number type of the product."""
    writer = depth_product(cells, kind).write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def write_cells(cells: DataFrame, path: str, scene: str = "scene_id", tile: int = TILE_ROWS) -> None:
    """Cells as Parquet in a folder for each scene and square tile of ``tile`` rows and columns; a tile's rows are written by one task, sorted."""
    at = lambda x: F.floor(F.col(x) / tile).cast("int")
    tiled = cells.withColumn("tile_r", at("r")).withColumn("tile_c", at("c"))
    tiled = tiled.repartition(scene, "tile_r", "tile_c").sortWithinPartitions(scene, "tile_r", "tile_c", "r", "c")
    tiled.write.mode("overwrite").partitionBy(scene, "tile_r", "tile_c").parquet(path)


def read_cells(spark: SparkSession, path: str, box: tuple[int, int, int, int] | None = None, scenes: Sequence | None = None, scene: str = "scene_id", tile: int = TILE_ROWS) -> DataFrame:
    """Cells of the box (r0, c0, r1, c1, both ends in) and scenes asked for; folders of other scenes and tiles aren't opened."""
    cells = spark.read.parquet(path)
    if scenes is not None:
        cells = cells.filter(F.col(scene).isin(*scenes))
    if box is not None:
        r0, c0, r1, c1 = box
        cells = cells.filter(F.col("tile_r").between(r0 // tile, r1 // tile) & F.col("tile_c").between(c0 // tile, c1 // tile))
        cells = cells.filter(F.col("r").between(r0, r1) & F.col("c").between(c0, c1))
    return cells.drop("tile_r", "tile_c")


def depth_product(cells: DataFrame, kind: str) -> DataFrame:
    """``z`` as float, double or uint16 (in an int: not negative, rounded down, 65535 for no data)."""
    if kind == "uint16":
        z = F.coalesce(F.floor(F.least(F.greatest("z", F.lit(0.0)), F.lit(65534.0))), F.lit(65535)).cast("int")
        return cells.withColumn("z", z)
    return cells.withColumn("z", F.col("z").cast({"float32": "float"}.get(kind, kind)))


def training_points(points: DataFrame, grid: Grid) -> DataFrame:
    """The points that a model was fitted on, with their cell and its centre."""
    return points.select("point_id", F.col("depth").alias("depth_used"), F.col("weight").alias("weight_used"), F.col("r").alias("row_idx"), F.col("c").alias("col_idx"), grid.x(F.col("c")).alias("x"), grid.y(F.col("r")).alias("y"))


def with_uncertainty(points: DataFrame, sigma: Column, accepted: Column) -> DataFrame:
    """``points`` with ``sdb_uncert`` (replaced if there) and ``accepted``."""
    return points.withColumn("sdb_uncert", sigma).withColumn("accepted", accepted)


def sanitize_columns(rows: DataFrame) -> DataFrame:
    """Columns a simple table format can hold: numbers, text, times as ISO text; nested columns are dropped."""
    out = []
    for name, kind in rows.dtypes:
        if kind in NUMBERS:
            out.append(F.col(name).cast(NUMBERS[kind]).alias(name))
        elif kind.startswith("decimal"):
            out.append(F.col(name).cast("double").alias(name))
        elif kind.startswith("timestamp"):
            out.append(F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss").alias(name))
        elif kind in ("string", "date", "boolean"):
            out.append(F.col(name).cast("string").alias(name))
    return rows.select(*out)
