"""Depth from scenes and soundings, end to end: one scene, many scenes, many years."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalgrid.functions import indices
from shoalgrid.functions.geo import scene_weight
from shoalgrid.operators import components, crossfit, fits, focal, metrics, models, points, robust, spatial, temporal
from shoalgrid.operators.selection import DEFAULT_WEIGHTS
from shoalgrid.plans import jobs
from shoalgrid.sources.shared import written

Bounds = tuple[int, int, int, int]
BANDS = ("blue", "green", "red")
MODELS = ("linear", "ridge", "tree")
#: Soundings that a fit needs.
LEAST = 20


def features_of(cells: DataFrame, bounds: Bounds, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """(cells of deep enough water with features, their names): in each scene land and optically shallow water off, glint off, logs of bands and of their ratios."""
    water = jobs.hybrid_water(cells, bounds, by=by)
    wet = written(cells.join(water, [*by, "r", "c"], "left_semi"), "wet")
    shallow = jobs.shallow_by_deep(wet, jobs.nir_percentile(0.4), by)
    deep = wet.join(shallow.select(*by, "r", "c"), [*by, "r", "c"], "left_anti")
    clean = robust.deglint(deep, list(BANDS), F.lit(True), by=by)
    b = {x: F.col(f"{x}_deglint") for x in BANDS}
    named = {**{f"log_{x}": indices.log_band(v) for x, v in b.items()}, "ratio_blue_green": indices.log_ratio(b["blue"], b["green"]), "ratio_green_red": indices.log_ratio(b["green"], b["red"])}
    return written(clean.select(*by, "r", "c", *[v.alias(n) for n, v in named.items()]), "features"), list(named)


def selected(rows: DataFrame, names: Sequence[str], label: str = "depth") -> list[str]:
    """Features whose correlation with depth is at least the mean magnitude less a deviation; a row a feature comes to the driver."""
    found = {r["feature"]: abs(r["pearson"]) for r in metrics.feature_correlations(rows, names, label).collect()}
    mean = sum(found.values()) / len(found)
    spread = (sum((v - mean) ** 2 for v in found.values()) / len(found)) ** 0.5
    return [n for n in names if found[n] >= max(0.0, mean - spread)]


def training_rows(features: DataFrame, names: Sequence[str], soundings: DataFrame) -> DataFrame:
    """Soundings, one a cell by weighted mean, beside the features of their cell; those far from a quadratic in the strongest ratio are left out."""
    one = points.collision_reduce(soundings, 3).withColumnRenamed("value", "depth")
    met = one.join(features, ["r", "c"]).dropna(subset=list(names))
    return robust.filter_least_squares(met, "ratio_blue_green", "depth").filter("accepted").drop("residual", "sigma", "accepted")


def best_model(rows: DataFrame, names: Sequence[str], candidates: Sequence[str] = MODELS) -> str:
    """The model of the best composite score over clusters of places that were left out of its fits."""
    board = crossfit.cross_scores(rows, names, candidates)
    return metrics.composite_score(board, DEFAULT_WEIGHTS).orderBy(F.col("score").desc(), "model").first()["model"]


def cleaned(depths: DataFrame, bounds: Bounds, by: Sequence[str], deepest: float, steepest: float) -> DataFrame:
    """Depths within 1.5 times the deepest allowed, on slopes up to ``steepest`` in patches of 10 cells or more, smoothed by a median with nearest fill, positive ones off."""
    near = depths.filter(F.abs("z") <= 1.5 * abs(deepest))
    flat = focal.horn_slope(near, "z", by, bounds=bounds).filter(F.col("slope") <= steepest)
    kept = components.drop_small(components.label(flat.select(*by, "r", "c"), by), 10, by).select(*by, "r", "c")
    smooth = focal.focal_median(near.join(kept, [*by, "r", "c"], "left_semi"), "z", by, 3, "nearest", bounds)
    return written(smooth.select(*by, "r", "c", F.col("median").alias("z")).filter("z < 0"), "clean")


def with_residuals(depths: DataFrame, rows: DataFrame, k: int = 5) -> DataFrame:
    """(r, c, z, u): depths of one scene moved by the residuals of the nearest soundings, and 1.96 times their size as uncertainty."""
    met = rows.select("r", "c", "depth").join(depths.select("r", "c", "z"), ["r", "c"])
    known = written(met.select("r", "c", (F.col("r").cast("long") * (1 << 31) + F.col("c")).alias("k"), (F.col("depth") - F.col("z")).alias("v")), "residuals")
    if known.limit(k).count() < k:
        return depths.select("r", "c", "z", F.lit(None).cast("double").alias("u"))
    found = written(spatial.knn(depths.select(F.col("r").alias("qr"), F.col("c").alias("qc")), known, k), "nearest")
    w = 1 / (F.sqrt(F.col("d2").cast("double")) + 1)
    moved = found.groupBy(F.col("qr").alias("r"), F.col("qc").alias("c")).agg((F.sum(F.col("v") * w) / F.sum(w)).alias("_v"), (F.sum(1.96 * F.abs("v") * w) / F.sum(w)).alias("u"))
    return depths.join(moved, ["r", "c"]).select("r", "c", (F.col("z") + F.col("_v")).alias("z"), "u")


def scene_depths(cells: DataFrame, soundings: DataFrame, bounds: Bounds, scene: str = "scene_id", deepest: float = 30.0, steepest: float = 60.0) -> DataFrame:
    """(scene, r, c, z, u) of every scene: water, glint, features, outliers, selection, the best model on places left out, cleaning and residuals.

    Masks, glint, features and cleaning take all scenes at once; models and residuals are a scene's own, one after another.
    Scenes with fewer than LEAST soundings on deep water have no depths.
    """
    features, names = features_of(cells, bounds, [scene])
    rows = written(training_rows(features, names, soundings), "training")
    numbers = sorted(r[0] for r in rows.groupBy(scene).count().filter(F.col("count") >= LEAST).select(scene).collect())
    if not numbers:
        return cells.select(scene, "r", "c", F.lit(None).cast("double").alias("z"), F.lit(None).cast("double").alias("u")).limit(0)
    used = selected(rows, names)
    name, raw = best_model(rows, used), None
    for s in numbers:
        fitted = models.fit(rows.filter(F.col(scene) == s), used, [name])[name]
        part = models.predict(fitted, features.filter(F.col(scene) == s), used).select(scene, "r", "c", F.col("y_pred").alias("z"))
        raw = part if raw is None else raw.unionByName(part)
    clean, out = cleaned(raw, bounds, [scene], deepest, steepest), None
    for s in numbers:
        part = with_residuals(clean.filter(F.col(scene) == s), rows.filter(F.col(scene) == s)).select(F.lit(s).cast(dict(cells.dtypes)[scene]).alias(scene), "r", "c", "z", "u")
        out = part if out is None else out.unionByName(part)
    return out


def multi_scene_depth(depths: DataFrame, soundings: DataFrame, scene: str = "scene_id") -> tuple[DataFrame, DataFrame]:
    """((r, c, z), report): scenes' depths weighted by their fit to the soundings, their weighted median, its bias off; errors by stratum before and after."""
    observed = points.collision_reduce(soundings, 3).select("r", "c", F.col("value").alias("y_true"))
    met = depths.join(observed, ["r", "c"]).select(scene, "y_true", F.col("z").alias("y_pred"))
    weights = metrics.regression_metrics(met, [scene]).select(scene, scene_weight(F.col("r2"), F.col("rmse")).alias("w"))
    merged = written(temporal.aggregate_scenes(depths.join(weights, scene).withColumnRenamed(scene, "scene_id"), "weighted_median"), "merged")
    pairs = lambda d: d.join(observed, ["r", "c"]).select("y_true", F.col("z").alias("y_pred"))
    shifted = robust.bias_shift(pairs(merged), merged)
    both = pairs(merged).withColumn("model", F.lit("merged")).unionByName(pairs(shifted).withColumn("model", F.lit("shifted")))
    return shifted, metrics.stratified_errors(both)


def multi_year_depth(cells: DataFrame, soundings: DataFrame, bounds: Bounds, scene: str = "scene_id") -> DataFrame:
    """(year, r, c, z): features of all scenes, their mean in each cell, one model over all years' soundings with the year as a feature, each year's own robust line, and its residuals.

    ``soundings`` have a year. Years with fewer than 10 soundings are not fitted; their lines are left out, too.
    """
    features, names = features_of(cells, bounds, [scene])
    mean = written(features.groupBy("r", "c").agg(*[F.avg(n).alias(n) for n in names]), "mean")
    rows = written(models.year_matrix(soundings.select("r", "c", "year", "depth").join(mean, ["r", "c"]).dropna(subset=names)), "years")
    if rows.limit(LEAST).count() < LEAST:
        return rows.select("year", "r", "c", F.col("depth").alias("z")).limit(0)
    used = [*selected(rows, names), "year_feature"]
    name = best_model(rows, used)
    fitted = models.fit(rows, used, [name])[name]
    years = rows.select("year", "year_feature").distinct()
    maps = models.predict(fitted, mean.crossJoin(F.broadcast(years)), used).select("year", "r", "c", F.col("y_pred").alias("z"))
    learned = models.predict(fitted, rows, used).select("year", F.col("depth").alias("y_true"), "y_pred")
    straight, out = written(fits.huber_by_group(learned, maps, ["year"]), "straight"), None
    for y in sorted(r[0] for r in years.select("year").collect()):
        own = rows.filter(F.col("year") == y).groupBy("r", "c").agg(F.avg("depth").alias("depth"))
        part = with_residuals(straight.filter(F.col("year") == y), own).select(F.lit(y).cast(dict(rows.dtypes)["year"]).alias("year"), "r", "c", "z")
        out = part if out is None else out.unionByName(part)
    return out
