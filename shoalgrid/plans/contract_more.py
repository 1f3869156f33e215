"""Queries over polygons as masks, observations of two phases, sampled features, further models and the remaining jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoalgrid.functions import qa
from shoalgrid.operators import crossfit, fits, metrics, models, points, spatial, temporal
from shoalgrid.plans import depth_jobs, fixtures, jobs
from shoalgrid.plans.contract_cells import REFLECTED, reflected, with_ndwi
from shoalgrid.plans.contract_maps import _INSIDE, _KNN, knn_inputs, maps, polygons
from shoalgrid.plans.contract_points import _FEATURES, _METRICS, _SAMPLED, counted, pts, sampled
from shoalgrid.plans.fixtures import view
from shoalgrid.plans.registry import query, r6


def _inside(spark, sf):
    return spatial.cells_in_polygons(maps(spark, sf).select("r", "c").distinct(), polygons(spark))


@query("water_mask_polygon", f"WITH {_INSIDE} SELECT scene_id, r, c FROM fx_spectra s WHERE EXISTS (SELECT 1 FROM i WHERE i.r = s.r AND i.c = s.c)", "depth", "spectra")
def _(spark, sf):
    return view(spark, sf, "spectra").join(_inside(spark, sf), ["r", "c"], "left_semi").select("scene_id", "r", "c")


@query("osw_polygon", f"WITH {_INSIDE} SELECT scene_id, r, c FROM fx_spectra s WHERE scl = 6 AND EXISTS (SELECT 1 FROM i WHERE poly_id = 2 AND i.r = s.r AND i.c = s.c)", "depth", "spectra")
def _(spark, sf):
    one = view(spark, sf, "spectra").filter("scl = 6")
    return one.join(_inside(spark, sf).filter("poly_id = 2"), ["r", "c"], "left_semi").select("scene_id", "r", "c")


@query("osw_roi_stats", f"WITH {_INSIDE}, {REFLECTED} SELECT scene_id, poly_id, round(avg(blue) + 2 * stddev_pop(blue), 6) + 0.0 AS blue_limit, round(avg(green) + 2 * stddev_pop(green), 6) + 0.0 AS green_limit FROM s JOIN i ON i.r = s.r AND i.c = s.c GROUP BY scene_id, poly_id", "depth", "spectra")
def _(spark, sf):
    s = reflected(spark, sf).join(_inside(spark, sf), ["r", "c"])
    return s.groupBy("scene_id", "poly_id").agg(*[r6(F.avg(b) + 2 * F.stddev_pop(b)).alias(f"{b}_limit") for b in ("blue", "green")])


_OSW = "WITH s AS (SELECT scene_id, r, c, blue_dn/10000.0::DOUBLE AS blue, green_dn/10000.0::DOUBLE AS green, red_dn/10000.0::DOUBLE AS red, nir_dn/10000.0::DOUBLE AS nir FROM fx_spectra)"


@query(
    "osw_turbidity",
    f"""{_OSW}, k AS (SELECT scene_id, quantile_cont(nir, 0.4) AS k FROM s GROUP BY ALL), d AS (SELECT *, (red - green) / (red + green + 1e-6::DOUBLE) AS t FROM s JOIN k USING (scene_id) WHERE nir <= k), q AS (SELECT scene_id, quantile_cont(t, 0.75) AS q FROM d GROUP BY ALL),
        l AS (SELECT scene_id, avg(blue) + 1.5::DOUBLE * stddev_pop(blue) AS tb, avg(green) + 1.5::DOUBLE * stddev_pop(green) AS tg FROM d JOIN q USING (scene_id) WHERE t <= q GROUP BY ALL) SELECT scene_id, r, c FROM s JOIN l USING (scene_id) WHERE blue > tb OR green > tg""",
    "spectra",
)
def _(spark, sf):
    return jobs.shallow_by_clear(reflected(spark, sf), jobs.nir_percentile(0.4), by=["scene_id"], times=1.5).select("scene_id", "r", "c")


@query("valley_otsu", None)
def _(spark, sf):
    return jobs.valley_threshold(with_ndwi(spark, sf), "ndwi")


_OBS = "o AS (SELECT point_id, depth AS observed, depth + 0.5::DOUBLE + dx AS p3, CASE WHEN point_id % 3 <> 0 THEN depth + dy END AS p4 FROM (SELECT point_id, CAST(depth AS DOUBLE) AS depth, dx, dy FROM fx_points) t)"


def observed(spark, sf):
    p = pts(spark, sf)
    first = p.select("point_id", (F.col("depth") + 0.5 + F.col("dx")).alias("y_pred"))
    second = p.filter("point_id % 3 <> 0").select("point_id", (F.col("depth") + F.col("dy")).alias("y_pred"))
    return metrics.against_observed(p.select("point_id", F.col("depth").alias("observed")), first, second)


@query("predictions_vs_observed", f"WITH {_OBS} SELECT point_id, observed, round(p3, 6) + 0.0 AS p3_pred, round(p4, 6) + 0.0 AS p4_pred FROM o WHERE p4 IS NOT NULL", "points")
def _(spark, sf):
    return observed(spark, sf).select("point_id", "observed", r6("p3_pred").alias("p3_pred"), r6("p4_pred").alias("p4_pred"))


@query("validation_raw_export", f"WITH {_OBS} SELECT observed AS Observed, round(p3, 6) + 0.0 AS P3_Pred, round(p3 - observed, 6) + 0.0 AS P3_Error, round(p4, 6) + 0.0 AS P4_Pred, round(p4 - observed, 6) + 0.0 AS P4_Error FROM o WHERE p4 IS NOT NULL", "points")
def _(spark, sf):
    o = observed(spark, sf)
    error = lambda c: r6(F.col(c) - F.col("observed"))
    return o.select(F.col("observed").alias("Observed"), r6("p3_pred").alias("P3_Pred"), error("p3_pred").alias("P3_Error"), r6("p4_pred").alias("P4_Pred"), error("p4_pred").alias("P4_Error"))


@query("valid_sample_filter", f"WITH {REFLECTED} SELECT scene_id, r, c FROM s WHERE scl <> 6 AND blue <> 0.02::DOUBLE", "spectra")
def _(spark, sf):
    x = reflected(spark, sf).select("scene_id", "r", "c", F.when(F.col("scl") != 6, F.col("green")).alias("a"), F.when(F.col("blue") == 0.02, -9999.0).otherwise(F.col("blue")).alias("b"))
    return points.valid_samples(x, ["a", "b"]).select("scene_id", "r", "c")


@query("invalid_feature_mask", f"WITH {REFLECTED} SELECT scene_id, r, c, CASE WHEN scl <> 6 THEN blue + 1 END AS y FROM s", "spectra")
def _(spark, sf):
    x = reflected(spark, sf).withColumn("a", F.when(F.col("scl") != 6, F.col("blue")))
    return points.masked_prediction(x, ["a"], F.coalesce("a", F.lit(0.0)) + 1).select("scene_id", "r", "c", F.col("prediction").alias("y"))


@query("check_depth_fields", "SELECT point_id, CAST(depth AS DOUBLE) AS d FROM fx_points", "points")
def _(spark, sf):
    p = pts(spark, sf)
    return p.select("point_id", F.col(points.check_depth_field(p, "DEPTH")).alias("d"))


@query("filter_huber_variance", None)
def _(spark, sf):
    return fits.huber_variance(sampled(spark, sf), "green", "depth", "point_id").select("point_id", "scene_id", "residual", "sigma", "accepted")


@query("residual_uncertainty", f"WITH {_KNN} SELECT qr, qc, round(sum(1.96::DOUBLE * v / (sqrt(d2) + 1)) / sum(1 / (sqrt(d2) + 1)), 6) + 0.0 AS u FROM n WHERE rank <= 5 GROUP BY qr, qc", "depth", "points")
def _(spark, sf):
    q, t = knn_inputs(spark, sf)
    return spatial.idw(q, t.withColumn("v", 1.96 * F.abs("v")), 5).select("qr", "qc", r6("v").alias("u"))


@query("stack_features", "SELECT d.year, s.scene_id, d.r, d.c, s.blue_dn, d.z FROM fx_depth d JOIN fx_spectra s ON s.r = d.r AND s.c = d.c", "depth", "spectra")
def _(spark, sf):
    return maps(spark, sf).select("year", "r", "c", "z").join(view(spark, sf, "spectra").select("scene_id", "r", "c", "blue_dn"), ["r", "c"]).select("year", "scene_id", "r", "c", "blue_dn", "z")


@query("feature_importance", None)
def _(spark, sf):
    """The mean of what a forest and a line make of each feature."""
    return crossfit.importance(models.fit(counted(spark, sf), _FEATURES, ["forest", "linear"], count="_n"), sampled(spark, sf), _FEATURES, "point_id")


@query("permutation_importance", None)
def _(spark, sf):
    rows = sampled(spark, sf).withColumn("key", F.concat_ws(":", "point_id", "scene_id"))
    return crossfit.permutation_importance(models.fit(rows, _FEATURES, ["boosted"])["boosted"], rows, _FEATURES, "key")


@query("ensemble_stacking", None)
def _(spark, sf):
    return crossfit.stacked(counted(spark, sf), reflected(spark, sf), _FEATURES, ["linear", "tree"], count="_n")[1].select("scene_id", "r", "c", "y_pred")


@query("uncertainty_model", None)
def _(spark, sf):
    return models.uncertainty(counted(spark, sf), reflected(spark, sf), _FEATURES, count="_n").select("scene_id", "r", "c", "u")


@query("benthic_supervised", None)
def _(spark, sf):
    labelled = reflected(spark, sf).join(_inside(spark, sf), ["r", "c"])
    return models.benthic(labelled, reflected(spark, sf), ["blue", "green", "red"], "poly_id").select("scene_id", "r", "c", "benthic_class")


# Jobs

@query("job_composite", f"WITH {REFLECTED} SELECT r, c, count(*) AS valid_count, round(median(green), 6) + 0.0 AS green FROM s WHERE scl NOT IN (0,1,3,8,9,10,11) GROUP BY r, c", "spectra")
def _(spark, sf):
    out = temporal.composite(reflected(spark, sf), ["green"], ~qa.scl_invalid(F.col("scl")))
    return out.select("r", "c", "valid_count", r6("green").alias("green"))


@query("job_multi_scene_depth", f"WITH {_SAMPLED}, l AS (SELECT regr_slope(depth, nir) AS b, regr_intercept(depth, nir) AS a FROM x) SELECT r, c, round(median(a + b * nir), 4) + 0.0 AS z FROM s CROSS JOIN l GROUP BY r, c", "points", "spectra")
def _(spark, sf):
    line = sampled(spark, sf).agg(F.regr_slope("depth", "nir").alias("b"), F.regr_intercept("depth", "nir").alias("a"))
    each = reflected(spark, sf).crossJoin(F.broadcast(line)).select("scene_id", "r", "c", (F.col("a") + F.col("b") * F.col("nir")).alias("z"))
    return temporal.aggregate_scenes(each, "median").select("r", "c", (F.round("z", 4) + 0.0).alias("z"))


@query("job_multi_year_depth", None)
def _(spark, sf):
    return depth_jobs.multi_year_depth(reflected(spark, sf), pts(spark, sf), (0, 0, fixtures.SIDE - 1, fixtures.SIDE - 1))


@query("job_lidar_points_prep", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, CAST(EXTRACT(YEAR FROM ts) AS INT) AS year, CAST(value AS DOUBLE) AS value FROM events WHERE EXTRACT(DAY FROM ts) <= 15")
def _(spark, sf):
    from shoalgrid.sources.tables import sanitize_columns

    e = spark.read.parquet(f"{sf}/events.parquet").filter(F.dayofmonth("ts") <= 15)
    return sanitize_columns(e.select("event_id", "ts", F.year("ts").alias("year"), "value", F.array("event_id").alias("dropped")))


@query("job_evaluate_map", f"WITH p AS (SELECT CAST(p.depth AS DOUBLE) AS y_true, d.z AS y_pred FROM fx_points p JOIN fx_depth d ON d.r = p.r AND d.c = p.c AND d.year = 1997) SELECT {_METRICS} FROM p", "points", "depth")
def _(spark, sf):
    found = points.sample_at_points(pts(spark, sf).drop("year"), maps(spark, sf).filter("year = 1997"), ["z"])
    out = metrics.regression_metrics(found.select(F.col("depth").alias("y_true"), F.col("z").alias("y_pred")))
    return out.select("n", *[r6(m).alias(m) for m in ("r2", "rmse", "mae", "bias", "wmape")])
