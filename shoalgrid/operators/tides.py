"""Tide grids on real axes: reading them, and the cell of a place as an as-of join on both axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names that an axis or the amplitude goes by, in the order in which they are looked for.
LATITUDES = ("lat", "latitude")
LONGITUDES = ("lon", "longitude")
AMPLITUDES = ("amplitude", "amp", "z", "z0", "h")
#: Amplitudes over this are centimetres, whatever the units say.
LARGEST_METRES = 15.0
#: Rows of an axis table up to which it is broadcast; it is counted first.
AXIS_ROWS = 100_000


def _named(table: DataFrame, names: tuple[str, ...]) -> Column:
    for n in names:
        if n in table.columns:
            return F.col(n)
    raise ValueError(f"none of the columns {', '.join(names)}")


def read_tide_grid(table: DataFrame, con: str = "con", units: str | None = "units") -> DataFrame:
    """(con, lat_i, lon_i, lat, lon, amp in metres) of a table of constituents with axes, places on them and amplitudes under any of their names.

    What is masked (NULL or NaN) is 0. All constituents are centimetres if the units of any have "cm" or an amplitude is
    over LARGEST_METRES. A constituent's name is its file's, before the first dot and in lower case.
    """
    amp = F.coalesce(F.nanvl(_named(table, AMPLITUDES).cast("double"), F.lit(0.0)), F.lit(0.0))
    text = F.coalesce(F.lower(F.col(units)), F.lit("")) if units and units in table.columns else F.lit("")
    name = F.lower(F.substring_index(F.col(con), ".", 1)) if dict(table.dtypes)[con] == "string" else F.col(con)
    grid = table.select(name.alias("con"), "lat_i", "lon_i", _named(table, LATITUDES).cast("double").alias("lat"), _named(table, LONGITUDES).cast("double").alias("lon"), amp.alias("amp"), text.alias("_units"))
    cm = grid.agg(F.coalesce(F.bool_or(F.col("_units").contains("cm") | (F.col("amp") > LARGEST_METRES)), F.lit(False)).alias("_cm"))
    metres = F.when(F.col("_cm"), F.col("amp") / 100).otherwise(F.col("amp"))
    return grid.crossJoin(F.broadcast(cm)).select("con", "lat_i", "lon_i", "lat", "lon", metres.alias("amp"))


def axis(grid: DataFrame, index: str, value: str) -> DataFrame:
    """(index, value, falling): the places of an axis, and whether its values fall from the first to the last."""
    places = grid.select(index, value).distinct()
    ends = places.agg((F.max_by(value, index) < F.min_by(value, index)).alias("falling"))
    return places.crossJoin(F.broadcast(ends))


def on_axis(points: DataFrame, axis_: DataFrame, x: Column, index: str, value: str) -> DataFrame:
    """``points`` with ``index``: the first place on the axis, in its own direction, that ``x`` doesn't lie beyond; the last where it lies beyond all.

    Each place stands for the interval from its forerunner to itself. Intervals go to the buckets of equal width that
    they touch, as wide as intervals are on average, so that there are three times as many rows as places at most; a point
    meets the few intervals of its own bucket by an equality join. A NULL or NaN coordinate has the last place.
    """
    sign = F.when(F.col("falling"), -F.col(value)).otherwise(F.col(value))
    ordered = Window.orderBy("_hi")  # over an axis: a row a place, whatever the points
    places = axis_.select(F.col(index).alias("_at"), sign.alias("_hi"), "falling")
    span = places.agg(F.min("_hi").alias("_first"), F.max("_hi").alias("_end"), F.max("_at").alias("_last"), ((F.max("_hi") - F.min("_hi")) / F.greatest(F.count("*") - 1, F.lit(1))).alias("_width"), F.bool_or("falling").alias("_falling"))
    span = span.withColumn("_width", F.when(F.col("_width") > 0, F.col("_width")).otherwise(1.0))
    bucket = lambda v: F.floor((v - F.col("_first")) / F.col("_width"))
    steps = places.withColumn("_lo", F.lag("_hi").over(ordered)).crossJoin(F.broadcast(span.drop("_falling")))
    steps = steps.withColumn("_bucket", F.explode(F.sequence(bucket(F.coalesce("_lo", "_hi")), bucket(F.col("_hi")))))
    steps = steps.select("_at", F.col("_lo"), F.col("_hi"), "_bucket")
    if steps.limit(AXIS_ROWS + 1).count() <= AXIS_ROWS:
        steps = F.broadcast(steps)
    signed = F.when(F.col("_falling"), -x).otherwise(x)
    at = points.crossJoin(F.broadcast(span)).withColumn("_x", F.when(signed.isNotNull(), F.greatest(signed, F.col("_first"))))
    at = at.withColumn("_inside", F.coalesce((F.col("_x") <= F.col("_end")) & ~F.isnan("_x"), F.lit(False)))
    at = at.withColumn("_b", F.when(F.col("_inside"), bucket(F.col("_x"))))
    within = (F.col("_b") == F.col("_bucket")) & (F.col("_x") <= F.col("_hi")) & (F.col("_lo").isNull() | (F.col("_x") > F.col("_lo")))
    found = at.join(steps, within, "left")
    return found.withColumn(index, F.coalesce("_at", "_last").cast("int")).select(*points.columns, index)


def tide_cells(points: DataFrame, grid: DataFrame) -> DataFrame:
    """``points`` (lat, lon) with lat_i and lon_i of their cell in ``grid``; longitudes are turned to the axis's own range, 0 to 360 or -180 to 180."""
    lats, lons = axis(grid, "lat_i", "lat"), axis(grid, "lon_i", "lon")
    ends = lons.agg(F.min_by("lon", "lon_i").alias("_west"), F.max_by("lon", "lon_i").alias("_east"))
    lon = F.col("lon")
    turned = F.when((F.col("_west") >= 0) & (F.col("_east") > 180) & (lon < 0), lon + 360.0).when((F.col("_west") < 0) & (lon > 180), lon - 360.0).otherwise(lon)
    placed = on_axis(points, lats, F.col("lat"), "lat_i", "lat")
    placed = placed.crossJoin(F.broadcast(ends)).withColumn("_lon", turned).drop("_west", "_east")
    return on_axis(placed, lons, F.col("_lon"), "lon_i", "lon").drop("_lon")


def tide_at(points: DataFrame, grid: DataFrame) -> DataFrame:
    """``points`` once for each constituent at their cell, with its name and ``amp``: one equality join of the two places."""
    return tide_cells(points, grid).join(grid.select("con", "lat_i", "lon_i", "amp"), ["lat_i", "lon_i"])
