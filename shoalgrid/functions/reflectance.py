"""Sensor numbers to surface reflectance, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalgrid.operators.quantiles import exact_quantiles

NODATA = -9999.0


def null_if_nodata(x: Column, sentinel: float = NODATA, deepest: float = -9000.0, largest: float = 15000.0) -> Column:
    """NULL for NaN, the sentinel, values at or under ``deepest`` and magnitudes above ``largest``."""
    return F.when(~F.isnan(x) & (x != sentinel) & (x > deepest) & (F.abs(x) <= largest), x)


def parse_baseline(x: Column) -> Column:
    """Processing baseline text such as ``05.13`` or ``V04.00`` to a number; NULL if it is none."""
    return F.regexp_replace(F.trim(x), "^[vV]", "").try_cast("double")


def reflectance_offset(offset_applied: Column, baseline: Column, metadata_offset: Column) -> Column:
    """Offset to add: 0 if already applied; by baseline 4 and up the metadata's (-0.1 if that is 0), below 4 none; else the metadata's or -0.1."""
    given = F.when(F.abs(metadata_offset) > 1e-6, metadata_offset)
    return (
        F.when(offset_applied, 0.0)
        .when(baseline >= 4, F.coalesce(given, F.lit(-0.1)))
        .when(baseline < 4, 0.0)
        .otherwise(F.coalesce(given, F.lit(-0.1)))
    )


def scaled(dn: Column, scale: float | Column, offset: float | Column) -> Column:
    """dn * scale + offset, NULL for numbers that are not positive."""
    dn = dn.cast("double")
    return F.when(dn > 0, dn * scale + offset)


def landsat_reflectance(dn: Column) -> Column:
    """Collection-2 scaling; fill (0) is NULL, nothing is clipped."""
    return scaled(dn, F.lit(0.0000275), F.lit(-0.2))


def sentinel_reflectance(cells: DataFrame, band: str, scale: float = 1e-4, offset: float = -0.1, by: str = "scene_id", most: float = 0.7) -> DataFrame:
    """``cells`` with ``<band>_refl``; in a scene where over ``most`` of the valid cells would fall under -0.02 the offset is dropped.

    The share is one aggregate per scene, joined back (scenes are few next to cells).
    """
    value = scaled(F.col(band), F.lit(scale), F.lit(offset))
    low = cells.groupBy(F.col(by).alias("_by")).agg(F.avg((value < -0.02).cast("double")).alias("_low"))
    joined = cells.join(low, cells[by].eqNullSafe(low["_by"]))
    drop = (F.lit(offset) < -0.01) & (F.coalesce("_low", F.lit(0.0)) > most)
    used = F.when(drop, 0.0).otherwise(offset)
    return joined.withColumn(f"{band}_refl", scaled(F.col(band), F.lit(scale), used)).drop("_by", "_low")


def already_scaled(cells: DataFrame, band: str, by: str = "scene_id") -> DataFrame:
    """Per scene whether a band is reflectance already: its 95th percentile is 2.5 at most and its minimum -0.5 at least."""
    x = F.col(band).cast("double")
    ends = exact_quantiles(cells, {"_high": (x, 0.95), "_low": (x, 0.0)}, [by])
    return ends.select(by, ((F.col("_high") <= 2.5) & (F.col("_low") >= -0.5)).alias("scaled"))


def reflectance_by_sensor(platform: Column, dn: Column) -> Column:
    """Landsat's or Sentinel-2's scaling by the platform's name; NULL for others."""
    name = F.lower(platform)
    return F.when(name.startswith("landsat"), landsat_reflectance(dn)).when(name.startswith("sentinel-2"), scaled(dn, F.lit(1e-4), F.lit(-0.1)))
