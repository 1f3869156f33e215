"""Yearly depth maps: periods, change, stability and volumes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoalgrid.operators.components import label
from shoalgrid.operators.focal import binary_opening
from shoalgrid.operators.quantiles import exact_median, exact_quantiles
from shoalgrid.operators.thresholds import histogram, otsu_of_histogram


def healthy_years(maps: DataFrame, least: int = 10) -> DataFrame:
    """(year) of maps with more than ``least`` cells of a magnitude between 1e-4 and 15000."""
    good = (F.abs("z") > 1e-4) & (F.abs("z") < 15000)
    return maps.groupBy("year").agg(F.count_if(good).alias("n")).filter(F.col("n") > least).select("year")


def change_periods(years: DataFrame, kind: str = "sequential") -> DataFrame:
    """(period, kind, y1, y2) of distinct ``year`` rows: sequential or baseline pairs; sequential ones add the whole span if over 2 years.

    Years are few: one row a year, whatever the maps hold.
    """
    order = Window.orderBy("year")
    if kind == "baseline":
        pairs = years.select(F.first("year").over(order).alias("y1"), F.col("year").alias("y2")).filter("y1 < y2")
        pairs = pairs.withColumn("kind", F.lit("Baseline"))
    else:
        pairs = years.select(F.lag("year").over(order).alias("y1"), F.col("year").alias("y2")).dropna().withColumn("kind", F.lit("Sequential"))
        span = years.agg(F.min("year").alias("y1"), F.max("year").alias("y2"), F.count("*").alias("n")).filter("n > 2")
        pairs = pairs.unionByName(span.select("y1", "y2", F.lit("Long-term Trend").alias("kind")))
    return pairs.select(F.concat_ws("-", "y1", "y2").alias("period"), "kind", "y1", "y2")


def aligned_pairs(maps: DataFrame, periods: DataFrame) -> DataFrame:
    """(period, y1, y2, r, c, z1, z2, u1, u2) of cells that are valid in both years: |z| between 0.1 and 15000."""
    valid = maps.filter((F.abs("z") > 0.1) & (F.abs("z") < 15000))
    p = F.broadcast(periods.select("period", "y1", "y2"))  # one row for each pair of years
    first = valid.select(F.col("year").alias("y1"), "r", "c", F.col("z").alias("z1"), F.col("u").alias("u1")).join(p, "y1")
    second = valid.select(F.col("year").alias("y2"), "r", "c", F.col("z").alias("z2"), F.col("u").alias("u2"))
    return first.join(second, ["y2", "r", "c"])


def depth_of_closure(pairs: DataFrame, most: float) -> DataFrame:
    """Pairs no deeper than ``most`` in either year, by the sign that the mean of z1 has; all of them if ``most`` is not positive."""
    if most <= 0:
        return pairs
    sign = pairs.agg((F.avg("z1") > 0).alias("_up"))
    d = lambda c: F.when(F.col("_up"), F.col(c)).otherwise(-F.col(c))
    return pairs.crossJoin(F.broadcast(sign)).filter((d("z1") <= most) & (d("z2") <= most)).drop("_up")


def change_threshold(pairs: DataFrame, base: float | None = 0.15) -> DataFrame:
    """(period, base): as given, or the threshold between small and large |z2 - z1| over their own range."""
    if base is not None:
        return pairs.select("period").distinct().withColumn("base", F.lit(float(base)))
    d = pairs.select("period", F.abs(F.col("z2") - F.col("z1")).alias("d"))
    span = d.groupBy(F.col("period").alias("p")).agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    scaled = d.join(F.broadcast(span), F.col("period") == F.col("p")).withColumn("x", F.when(F.col("hi") > F.col("lo"), (F.col("d") - F.col("lo")) / (F.col("hi") - F.col("lo"))))
    found = otsu_of_histogram(histogram(scaled, "x", ["period"], 0.0, 1.0), ["period"], 0.0, 1.0, "middle").withColumnRenamed("period", "q")
    joined = span.join(found, F.col("p") == F.col("q"), "left")
    return joined.select(F.col("p").alias("period"), F.coalesce(F.col("lo") + F.col("threshold") * (F.col("hi") - F.col("lo")), (F.col("lo") + F.col("hi")) / 2).alias("base"))


def significant_change(pairs: DataFrame, base: float | None = 0.15, factor: float = 0.10) -> DataFrame:
    """``pairs`` with dz (positive is accretion), limit (base + factor |z1|) and change: 1 accretion, -1 erosion, 0 neither.

    Depths that are positive on average count downwards, so their difference changes its sign.
    """
    sign = pairs.groupBy(F.col("period").alias("_p")).agg((F.avg("z1") > 0).alias("_down"))
    marks = change_threshold(pairs, base).withColumnRenamed("period", "_q").join(sign, F.col("_q") == F.col("_p"))
    out = pairs.join(F.broadcast(marks), F.col("period") == F.col("_p"))
    raw = F.col("z2") - F.col("z1")
    out = out.withColumn("dz", F.when(F.col("_down"), -raw).otherwise(raw)).withColumn("limit", F.col("base") + factor * F.abs("z1"))
    change = F.when(F.col("dz") > F.col("limit"), 1).when(F.col("dz") < -F.col("limit"), -1).otherwise(0)
    return out.withColumn("change", change).drop("_p", "_q", "_down", "base")


def sediment_volumes(changed: DataFrame, area: float, opening: bool = True, target: DataFrame | None = None) -> DataFrame:
    """(period, accretion_m3, erosion_m3, net_balance_m3); with ``opening`` only cells of areas that survive a 3 x 3 opening.

    ``target``: cells (r, c) of a region, whose part of the volumes is in target_accretion_m3, target_erosion_m3 and target_net_balance_m3.
    """
    up, down = changed.filter("change = 1"), changed.filter("change = -1")
    if opening:
        keep = lambda side: side.join(binary_opening(side.select("period", "r", "c"), ["period"]), ["period", "r", "c"], "left_semi")
        up, down = keep(up), keep(down)
    parts = up.select("period", "r", "c", F.col("dz").alias("a"), F.lit(0.0).alias("e")).union(down.select("period", "r", "c", F.lit(0.0), F.abs("dz")))
    periods, heads = changed.select("period").distinct(), [""]
    sums = [F.sum("a").alias("accretion_m3"), F.sum("e").alias("erosion_m3")]
    if target is not None:
        heads = ["", "target_"]
        parts = parts.join(target.select("r", "c").distinct().withColumn("_in", F.lit(True)), ["r", "c"], "left")
        sums += [F.sum(F.when(F.col("_in"), F.col(x))).alias(f"target_{n}") for x, n in (("a", "accretion_m3"), ("e", "erosion_m3"))]
    out = periods.join(parts.groupBy("period").agg(*sums), "period", "left")
    for h in heads:
        for n in ("accretion_m3", "erosion_m3"):
            out = out.withColumn(f"{h}{n}", F.coalesce(F.col(f"{h}{n}") * area, F.lit(0.0)))
        out = out.withColumn(f"{h}net_balance_m3", F.col(f"{h}accretion_m3") - F.col(f"{h}erosion_m3"))
    return out


def stability(maps: DataFrame, default_u: float = 0.4) -> DataFrame:
    """(r, c, mean, sigma, msi): the spread of a cell's depths over the years less what its uncertainty explains, as an index from 0 to 1."""
    cells = maps.groupBy("r", "c").agg(
        F.avg("z").alias("mean"), F.var_pop("z").alias("v"), F.min_by("u", "year").alias("u1"), F.max_by("u", "year").alias("u2")
    )
    u = lambda c: F.coalesce(F.col(c), F.lit(default_u))
    sigma = F.sqrt(F.greatest(F.lit(0.0), F.col("v") - (u("u1") * u("u1") + u("u2") * u("u2")) / 2))
    out = cells.withColumn("sigma", sigma)
    msi = F.least(F.greatest(1 - F.col("sigma") / (F.abs("mean") + 0.5), F.lit(0.0)), F.lit(1.0))
    return out.select("r", "c", "mean", "sigma", msi.alias("msi"))


def depth_trend(maps: DataFrame) -> DataFrame:
    """(r, c, slope, total): least-squares change per year and over the whole span; cells with one year have 0."""
    span = maps.agg((F.max("year") - F.min("year")).alias("_span"))
    cells = maps.groupBy("r", "c").agg(F.coalesce(F.nanvl(F.regr_slope("z", F.col("year").cast("double")), F.lit(0.0)), F.lit(0.0)).alias("slope"))
    return cells.crossJoin(F.broadcast(span)).select("r", "c", "slope", (F.col("slope") * F.col("_span")).alias("total"))


def combined_uncertainty(pairs: DataFrame, method: str = "mad") -> DataFrame:
    """``pairs`` with dz set to 0 where it is under the combined uncertainty: classical, mad or quantile."""
    raw = pairs.withColumn("dz", F.col("z2") - F.col("z1"))
    if method == "classical":
        return raw.withColumn("ucomb", 1.96 * F.sqrt(F.col("u1") ** 2 + F.col("u2") ** 2)).withColumn("dz", F.when(F.abs("dz") >= F.col("ucomb"), F.col("dz")).otherwise(0.0))
    if method == "mad":
        middle = exact_median(raw, "dz", "_m")
        one = exact_median(raw.crossJoin(F.broadcast(middle)), F.abs(F.col("dz") - F.col("_m")), "ucomb", scale=1.4826)
    else:
        ends = exact_quantiles(raw, {"a": (F.col("dz"), 0.25), "b": (F.col("dz"), 0.75)})
        one = ends.select(((F.col("b") - F.col("a")) / 1.349).alias("ucomb"))
    return raw.crossJoin(F.broadcast(one)).withColumn("dz", F.when(F.abs("dz") >= F.col("ucomb"), F.col("dz")).otherwise(0.0))


def year_water_mask(maps: DataFrame, shore: float = 0.5) -> DataFrame:
    """(year, r, c, water): depth beyond the shoreline's, by the sign that the year's mean depth has."""
    sign = maps.groupBy(F.col("year").alias("_y")).agg((F.avg("z") > 0).alias("_down"))
    z = F.when(F.col("_down"), F.col("z")).otherwise(-F.col("z"))
    return maps.join(F.broadcast(sign), F.col("year") == F.col("_y")).select("year", "r", "c", (z > shore).alias("water"))


def shoreline_cells(water: DataFrame, periods: DataFrame) -> DataFrame:
    """(period, r, c, change_type): land that became water is erosion, water that became land accretion; no data is land."""
    wet = water.filter("water").select("year", "r", "c")
    p = F.broadcast(periods.select("period", "y1", "y2"))
    a = wet.join(p, wet.year == p.y1).select("period", "r", "c", F.lit(1).alias("w1"))
    b = wet.join(p, wet.year == p.y2).select("period", "r", "c", F.lit(1).alias("w2"))
    both = a.join(b, ["period", "r", "c"], "full").fillna(0, ["w1", "w2"]).filter("w1 <> w2")
    kind = F.when(F.col("w2") > F.col("w1"), "Erosion").otherwise("Accretion")
    return both.select("period", "r", "c", kind.alias("change_type"))


def shoreline_change(water: DataFrame, periods: DataFrame, area: float) -> DataFrame:
    """(period, change_type, cells, area_m2) over all ``shoreline_cells``."""
    return shoreline_cells(water, periods).groupBy("period", "change_type").agg(F.count("*").alias("cells"), (F.count("*") * F.lit(float(area))).alias("area_m2"))


def shoreline_patches(water: DataFrame, periods: DataFrame, area: float, least_m2: float = 1.0, target: DataFrame | None = None) -> DataFrame:
    """(period, year_from, year_to, change_type, label, cells, area_m2, area_ha) of each connected area (by sides) of one change; those under ``least_m2`` are left out.

    ``target``: cells (r, c) that changes count in alone.
    """
    changed = shoreline_cells(water, periods)
    if target is not None:
        changed = changed.join(target.select("r", "c").distinct(), ["r", "c"], "left_semi")
    labels = label(changed, ["period", "change_type"], 4)
    size = F.count("*") * F.lit(float(area))
    out = labels.groupBy("period", "change_type", "label").agg(F.count("*").alias("cells"), size.alias("area_m2"), (size / 10_000).alias("area_ha")).filter(F.col("area_m2") >= least_m2)
    years = F.broadcast(periods.select("period", F.col("y1").alias("year_from"), F.col("y2").alias("year_to")))  # one row for each pair of years
    return out.join(years, "period").select("period", "year_from", "year_to", "change_type", "label", "cells", "area_m2", "area_ha")


def composite(cells: DataFrame, bands: Sequence[str], valid, least: int = 1) -> DataFrame:
    """Per cell the median of each band over the valid scenes (NULL under ``least``), their count, and the first band's deviation."""
    rows = cells.filter(valid)
    first = bands[0]
    out = rows.groupBy("r", "c").agg(F.count(first).alias("valid_count"), *[F.median(b).alias(b) for b in bands], F.when(F.count(first) >= 2, F.stddev_pop(first)).alias("std"))
    return out.select("r", "c", "valid_count", *[F.when(F.col("valid_count") >= least, F.col(b)).alias(b) for b in bands], "std")


def water_occurrence(cells: DataFrame, policy: str = "consensus", threshold: float = 50.0) -> DataFrame:
    """(r, c, occurrence, water) from flags 1, 0 and 255: percent of valid scenes with water, and whether that is enough."""
    valid = F.col("flag") != 255
    out = cells.groupBy("r", "c").agg((100.0 * F.count_if(F.col("flag") == 1) / F.nullif(F.count_if(valid), F.lit(0))).alias("occurrence"))
    enough = {"consensus": 90.0, "threshold": threshold, "hybrid": max(20.0, 0.6 * threshold)}[policy]
    return out.withColumn("water", F.col("occurrence") >= enough)


def aggregate_scenes(maps: DataFrame, method: str) -> DataFrame:
    """(r, c, z) of many scenes' depths: median, mean, deepest, shallowest, weighted_mean or weighted_median (column w).

    On ties of the deepest and shallowest the first scene wins. The weighted median is the first depth at which the
    running weight reaches half; running sums are inside a cell.
    """
    rows = maps.filter("z IS NOT NULL")
    cells = rows.groupBy("r", "c")
    order = F.struct(F.abs("z"), -F.col("scene_id"))
    if method == "median":
        return cells.agg(F.median("z").alias("z"))
    if method == "mean":
        return cells.agg(F.avg("z").alias("z"))
    if method == "deepest":
        return cells.agg(F.max_by("z", order).alias("z"))
    if method == "shallowest":
        return cells.agg(F.min_by("z", F.struct(F.abs("z"), F.col("scene_id"))).alias("z"))
    if method == "weighted_mean":
        return cells.agg(F.when(F.sum("w") > 0, F.sum(F.col("z") * F.col("w")) / F.sum("w")).alias("z"))
    if method == "weighted_median":
        own = Window.partitionBy("r", "c")
        upto = own.orderBy("z", "scene_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        run = rows.withColumn("_u", F.sum("w").over(upto)).withColumn("_t", F.sum("w").over(own))
        return run.filter(F.col("_u") >= F.col("_t") / 2).groupBy("r", "c").agg(F.min("z").alias("z"))
    raise ValueError(f"no way to aggregate called {method!r}")


def fused_depth(maps: DataFrame, method: str = "inverse_variance") -> DataFrame:
    """(r, c, z) over models: mean, median, or weights of 1 / (sigma^2 + 1e-4)."""
    cells = maps.groupBy("r", "c")
    if method == "inverse_variance":
        w = 1 / (F.col("u") * F.col("u") + 1e-4)
        return cells.agg((F.sum(w * F.col("z")) / F.sum(w)).alias("z"))
    return cells.agg({"mean": F.avg, "median": F.median}[method]("z").alias("z"))
