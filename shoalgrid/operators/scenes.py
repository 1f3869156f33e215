"""Scene catalogues and file lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalgrid.operators.ranks import running_total


def filter_scenes(scenes: DataFrame, cloud: float, platforms: Sequence[str], start: str, end: str, limit: int) -> DataFrame:
    """The newest ``limit`` scenes of some platforms in a range of days with little cloud."""
    found = scenes.filter((F.col("cloud_cover") <= cloud) & F.col("platform").isin(*platforms) & F.to_date("acq_ts").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return found.orderBy(F.desc("acq_ts"), "scene_key").limit(limit)


def same_sensor(scenes: DataFrame) -> DataFrame:
    """``scenes``, or an error when the rows are read if they mix families of sensors."""
    family = F.split_part(F.col("platform"), F.lit("-"), F.lit(1))
    kinds = scenes.agg(F.count_distinct(family).alias("_kinds"))
    checked = kinds.select(F.assert_true(F.col("_kinds") <= 1, F.lit("a composite can't mix sensors")).isNull().alias("_ok"))
    return scenes.crossJoin(F.broadcast(checked)).filter("_ok").drop("_ok")


def aoi_coverage(scenes: DataFrame, aoi: tuple[float, float, float, float]) -> DataFrame:
    """``scenes`` (minx, miny, maxx, maxy) with the percentage of the area of interest that their box covers."""
    x0, y0, x1, y1 = aoi
    w = F.greatest(F.lit(0.0), F.least(F.col("maxx"), F.lit(x1)) - F.greatest(F.col("minx"), F.lit(x0)))
    h = F.greatest(F.lit(0.0), F.least(F.col("maxy"), F.lit(y1)) - F.greatest(F.col("miny"), F.lit(y0)))
    return scenes.withColumn("coverage", 100.0 * w * h / ((x1 - x0) * (y1 - y0)))


def resolve_band_asset(assets: Column, band: str, aliases: Sequence[str] = (), bands: Column | None = None) -> Column:
    """Address of a band in a map of assets: by key, alias, key in other case, a band that the asset describes, or the end of a file's name.

    bands: a map of assets' keys to what they describe, arrays of structs (name, common_name).
    """
    other = lambda f: F.element_at(F.map_values(F.map_filter(assets, f)), 1)
    first = lambda f: F.when(F.size(F.map_filter(assets, f)) > 0, other(f))
    short = band.upper().replace("SR_", "").replace("B0", "B")
    names = [band.upper(), short, f"OLI_{short}", f"OLI_{band.upper()}"]
    tells = lambda k, v: F.coalesce(F.exists(F.try_element_at(bands, k), lambda b: F.upper(b["name"]).isin(names) | (F.lower(b["common_name"]) == band.lower())), F.lit(False))
    ends = "|".join(dict.fromkeys([band, band.removeprefix("SR_")]))
    suffix = rf"(?i)(^|[_/])({ends})\.[a-z0-9]+$"
    return F.coalesce(
        F.try_element_at(assets, F.lit(band)),
        *[F.try_element_at(assets, F.lit(a)) for a in aliases],
        first(lambda k, v: F.lower(k).isin(band.lower(), *[a.lower() for a in aliases])),
        *([first(tells)] if bands is not None else []),
        first(lambda k, v: v.rlike(suffix)),
    )


#: Words in a file's name that tell its role, looked for in this order.
CONTROL = ("control", "check", "ctrl", "residual", "datum", "error")
VALIDATION = ("unseen", "sonar", "test", "valid", "eval", "chk", "ground")
TRAIN = ("train", "lidar", "icesat", "atl", "bathy", "depth", "point", "survey")


def discover(files: DataFrame) -> DataFrame:
    """(year, role, path): for each year in file names the file of each role, by the order of its key words, then by name."""
    path = F.lower("path")
    has = lambda *words: path.rlike("|".join(words))
    role = F.when(has(*CONTROL), "control").when(has(*VALIDATION), "validation").when(has(*TRAIN), "train").otherwise("image")
    named = files.distinct().select("path", F.regexp_extract("path", r"(19|20)\d\d", 0).cast("int").alias("year"), role.alias("role"), F.when(has("control", "train"), 0).otherwise(1).alias("priority"))
    return named.groupBy("year", "role").agg(F.min(F.struct("priority", "path")).alias("best")).select("year", "role", "best.path")


def natural_order(rows: DataFrame, path: str) -> DataFrame:
    """Names with their place by the first number in them, then by name."""
    place = F.row_number().over(Window.orderBy(F.regexp_extract(path, r"\d+", 0).try_cast("int"), path))
    return rows.select(path, place.alias("place"))


def chronological(rows: DataFrame, ts: str, key: str) -> DataFrame:
    """``rows`` with ``place`` by time, ties by ``key``: days are counted and added up, and only a day's rows are sorted in one task."""
    dated = rows.withColumn("_day", F.unix_date(F.to_date(ts)))
    days = running_total(dated.groupBy("_day").agg(F.count("*").alias("_n")), "_day", "_n", "_upto").select(F.col("_day").alias("_d"), (F.col("_upto") - F.col("_n")).alias("_before"))
    placed = dated.withColumn("_own", F.row_number().over(Window.partitionBy("_day").orderBy(ts, key))).join(days, F.col("_day") == F.col("_d"))
    return placed.withColumn("place", F.col("_before") + F.col("_own")).drop("_day", "_d", "_own", "_before")
