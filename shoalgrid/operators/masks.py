"""Water and shallow-water masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalgrid.functions import indices, qa
from shoalgrid.operators.thresholds import otsu


def water_flag(invalid: Column, water: Column) -> Column:
    """1 water, 0 land, 255 invalid."""
    return F.when(invalid, 255).when(water, 1).otherwise(0).cast("int")


def water_by_otsu(cells: DataFrame, by: str = "scene_id", adjust: float = 0.0, least: int = 100) -> DataFrame:
    """``cells`` that have an ``ndwi``, with ``water``: above the scene's threshold (0 with ``least`` values or fewer) plus ``adjust``."""
    valid = cells.filter("ndwi IS NOT NULL")
    limits = otsu(valid, "ndwi", by=[by]).withColumnRenamed(by, "_by")
    counts = valid.groupBy(F.col(by).alias("_b")).agg(F.count("*").alias("_n"))
    limits = counts.join(limits, counts["_b"].eqNullSafe(limits["_by"]), "left")
    limits = limits.select("_b", F.when(F.col("_n") > least, F.coalesce("threshold", F.lit(0.0))).otherwise(0.0).alias("_t"))
    return valid.join(limits, valid[by].eqNullSafe(limits["_b"])).withColumn("water", F.col("ndwi") > F.col("_t") + adjust).drop("_b", "_t")


def water_by_three_indices() -> Column:
    """MNDWI > 0, NWI > 0 and NDVI < 0.1 over columns named by band."""
    blue, green, red, nir, swir = (F.col(b) for b in ("blue", "green", "red", "nir", "swir"))
    return (indices.mndwi(green, swir) > 0) & (indices.nwi(blue, green, red, nir, swir) > 0) & (indices.ndvi(nir, red) < 0.1)


def water_by_quality(cells: DataFrame, by: str = "scene_id") -> DataFrame:
    """``cells`` with flags ``permissive`` (class says water, or index above its threshold and some green) and ``strict`` (both)."""
    invalid, water = qa.scl_invalid(F.col("scl")), qa.scl_water(F.col("scl"))
    limits = otsu(cells.filter(~invalid), "ndwi", by=[by], place="middle", clip=True).select(F.col(by).alias("_by"), F.col("threshold").alias("_t"))
    joined = cells.join(limits, cells[by] == limits["_by"], "left")
    index = F.coalesce(F.col("ndwi") > F.coalesce("_t", F.lit(0.0)), F.lit(False))
    out = joined.withColumn("permissive", water_flag(invalid, water | (index & (F.col("green") > 0.005))))
    return out.withColumn("strict", water_flag(invalid, water & index)).drop("_by", "_t")


def water_mask(cells: DataFrame, method: str = "hybrid", mode: str = "permissive", quality: str | None = "scl", threshold: float | None = None, by: str = "scene_id") -> DataFrame:
    """``cells`` with ``flag``: 1 water, 0 land, 255 what is no data, cloud, shadow, snow or saturated.

    quality: the column whose class or bits say so, ``scl`` or ``qa_pixel`` (with ``qa_radsat`` where cells have it),
    or None. method: ``qa`` takes its water alone; ``ndwi`` and ``mndwi`` an index above a threshold, the given one or each
    scene's own by its valid cells; ``hybrid`` both: in the mode ``strict`` cells that both call water, else those that either does
    (the index with some green). Without an index or a quality column hybrid takes what there is.
    """
    if method not in ("qa", "scl", "ndwi", "mndwi", "hybrid") or mode not in ("strict", "permissive") or quality not in (None, "scl", "qa_pixel"):
        raise ValueError(f"no water mask by {method}, {mode}, {quality}")
    if method in ("qa", "scl") and quality is None:
        raise ValueError(f"{method} needs a quality column")
    if quality == "scl":
        invalid, water = qa.scl_invalid(F.col("scl")), qa.scl_water(F.col("scl"))
    elif quality == "qa_pixel":
        flags = qa.qa_pixel(F.col("qa_pixel"))
        invalid, water = flags["invalid"], flags["water"]
        if "qa_radsat" in cells.columns:
            invalid = invalid | qa.radsat_saturated(F.col("qa_radsat"))
    else:
        invalid, water = F.lit(False), F.lit(False)
    invalid, water = (F.coalesce(x, F.lit(k)) for x, k in ((invalid, True), (water, False)))
    marked = cells.withColumn("_bad", invalid).withColumn("_aux", water)
    other = "swir" if method == "mndwi" else "nir"
    if method in ("qa", "scl") or not {"green", other} <= set(cells.columns):
        if method in ("ndwi", "mndwi"):
            raise ValueError(f"{method} needs green and {other}")
        wet = F.col("_aux") if quality else F.lit(True)
        return marked.withColumn("flag", water_flag(F.col("_bad"), wet)).drop("_bad", "_aux")
    index = indices.normalized_difference(F.col("green"), F.col(other))
    marked = marked.withColumn("_index", F.when(~F.col("_bad"), index))
    if threshold is None:
        limits = otsu(marked.filter("_index IS NOT NULL"), "_index", by=[by], place="middle", clip=True).select(F.col(by).alias("_by"), F.col("threshold").alias("_t"))
        marked = marked.join(limits, marked[by].eqNullSafe(limits["_by"]), "left").withColumn("_t", F.coalesce("_t", F.lit(0.0))).drop("_by")
    else:
        marked = marked.withColumn("_t", F.lit(float(threshold)))
    above = F.coalesce(F.col("_index") > F.col("_t"), F.lit(False))
    if method != "hybrid" or quality is None:
        wet = above
    elif mode == "strict":
        wet = F.col("_aux") & above
    else:
        wet = F.col("_aux") | (above & F.coalesce(F.col("green") > 0.005, F.lit(False)))
    return marked.withColumn("flag", water_flag(F.col("_bad"), wet)).drop("_bad", "_aux", "_index", "_t")


def water_stats(flagged: DataFrame, by: Sequence[str] = (), flag: str = "flag") -> DataFrame:
    """Counts and percentage of ``flag`` codes."""
    f = F.col(flag)
    return flagged.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(f != 255).alias("valid"),
        F.count_if(f == 1).alias("water"),
        F.count_if(f == 0).alias("land"),
        F.count_if(f == 255).alias("invalid"),
        (100.0 * F.count_if(f == 1) / F.count("*")).alias("water_pct"),
    )
