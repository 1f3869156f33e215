"""Queries over connected cells, masks that need them, models and whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoalgrid.functions import qa, reflectance
from shoalgrid.operators import components, crossfit, fits, focal, metrics, models, robust, spatial, temporal
from shoalgrid.operators.groups import beside
from shoalgrid.operators.quantiles import exact_median
from shoalgrid.plans import depth_jobs, jobs
from shoalgrid.plans.contract_cells import REFLECTED, reflected
from shoalgrid.plans.contract_maps import SLOPES, grid_bounds, maps
from shoalgrid.plans.contract_points import _FEATURES, _SAMPLED, counted, pts, sampled
from shoalgrid.plans import fixtures
from shoalgrid.plans.fixtures import view
from shoalgrid.plans.registry import query, r6

_M = "m AS (SELECT year, r, c, CAST(r AS BIGINT) * 2147483648 + c AS node FROM fx_depth WHERE z < -14)"


def _reach(src: str, out: str, side: str = "abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1") -> str:
    return f"""{out}(year, node, r, c) AS (SELECT year, node, r, c FROM {src} UNION SELECT a.year, a.node, b.r, b.c FROM {out} a JOIN {src} b ON b.year = a.year AND {side}),
      {out}_l AS (SELECT year, r, c, min(node) AS label FROM {out} GROUP BY year, r, c)"""


_FOUR = "abs(a.r - b.r) + abs(a.c - b.c) <= 1"
_BY, _SCENE = ["year"], ["scene_id"]


def deep_cells(spark, sf):
    return maps(spark, sf).filter("z < -14").select("year", "r", "c")


def _sql(body: str) -> str:
    from shoalgrid.plans.fixtures import with_views

    return with_views("WITH " + body, "depth").replace("WITH fx_depth", "WITH RECURSIVE fx_depth", 1)


_REACHED = f"""{_M}, {_reach('m', 'q')}"""


@query("label_components", _sql(f"{_REACHED} SELECT year, r, c, label FROM q_l"))
def _(spark, sf):
    return components.label(deep_cells(spark, sf), _BY)


@query("label_components_4", _sql(f"{_M}, {_reach('m', 'q', _FOUR)} SELECT year, r, c, label FROM q_l"))
def _(spark, sf):
    return components.label(deep_cells(spark, sf), _BY, connectivity=4)


@query("drop_small_components", _sql(f"{_REACHED}, n AS (SELECT year, label FROM q_l GROUP BY ALL HAVING count(*) >= 6) SELECT year, r, c, label FROM q_l JOIN n USING (year, label)"))
def _(spark, sf):
    return components.drop_small(components.label(deep_cells(spark, sf), _BY), 6, _BY)


@query("largest_component", _sql(f"{_REACHED}, n AS (SELECT year, label, row_number() OVER (PARTITION BY year ORDER BY count(*) DESC, label) AS k FROM q_l GROUP BY year, label) SELECT year, r, c, label FROM q_l JOIN n USING (year, label) WHERE k = 1"))
def _(spark, sf):
    return components.largest(components.label(deep_cells(spark, sf), _BY), _BY)


@query("component_patches", _sql(f"{_M}, {_reach('m', 'q', _FOUR)} SELECT a.year, a.label, count(*) AS cells, count(*) * 100.0::DOUBLE AS area_m2, min(r) AS r0, min(c) AS c0, max(r) AS r1, max(c) AS c1, sum(4 - (SELECT count(*) FROM q_l b WHERE b.year = a.year AND abs(a.r - b.r) + abs(a.c - b.c) = 1))::BIGINT AS edges FROM q_l a GROUP BY a.year, a.label"))
def _(spark, sf):
    return components.patches(components.label(deep_cells(spark, sf), _BY, connectivity=4), 100.0, _BY)


_GROUND = "s0 AS (SELECT year, r, c FROM fx_depth WHERE z < -8), m AS (SELECT year, r, c, CAST(r AS BIGINT) * 2147483648 + c AS node FROM fx_depth WHERE NOT z < -8)"


@query("fill_holes", _sql(f"{_GROUND}, {_reach('m', 'q', _FOUR)}, o AS (SELECT DISTINCT year, label FROM q_l WHERE r IN (0, 31) OR c IN (0, 31)) SELECT year, r, c FROM s0 UNION SELECT year, r, c FROM q_l WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.year = q_l.year AND o.label = q_l.label)"))
def _(spark, sf):
    grid = maps(spark, sf)
    return components.fill_holes(grid.filter("z < -8").select("year", "r", "c"), grid, (0, 0, fixtures.SIDE - 1, fixtures.SIDE - 1), _BY)


@query(
    "sieve",
    _sql(
        f"""v AS (SELECT year, r, c, CASE WHEN z < -14 THEN 1 ELSE 0 END AS v, CAST(r AS BIGINT) * 2147483648 + c AS node FROM fx_depth),
        q(year, node, v, r, c) AS (SELECT year, node, v, r, c FROM v UNION SELECT x.year, x.node, x.v, b.r, b.c FROM q x JOIN v b ON b.year = x.year AND abs(x.r - b.r) <= 1 AND abs(x.c - b.c) <= 1 AND x.v = b.v),
        l AS (SELECT year, r, c, v, min(node) AS label FROM q GROUP BY ALL), n AS (SELECT year, label, any_value(v) AS v, count(*) AS n FROM l GROUP BY year, label),
        k AS (SELECT a.year, a.label, arg_max(b.v, struct_pack(n := nb.n, k := -b.label)) AS v FROM l a JOIN n na ON a.label = na.label AND a.year = na.year JOIN l b ON b.year = a.year AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND a.v <> b.v JOIN n nb ON nb.label = b.label AND nb.year = b.year WHERE na.n < 4 GROUP BY a.year, a.label)
        SELECT l.year, l.r, l.c, coalesce(k.v, l.v) AS v FROM l LEFT JOIN k ON l.label = k.label AND l.year = k.year"""
    ),
)
def _(spark, sf):
    m = maps(spark, sf).select("year", "r", "c", F.when(F.col("z") < -14, 1).otherwise(0).alias("v"))
    return components.sieve(m, "v", 4, _BY)


@query("slope_filter", _sql(f"{SLOPES}, m AS (SELECT year, r, c, CAST(r AS BIGINT) * 2147483648 + c AS node FROM slopes WHERE slope <= 40), {_reach("m", "s")}, n AS (SELECT year, label FROM s_l GROUP BY ALL HAVING count(*) >= 10) SELECT year, r, c FROM s_l JOIN n USING (year, label)"))
def _(spark, sf):
    flat = focal.horn_slope(maps(spark, sf), "z", _BY, bounds=grid_bounds()).filter("slope <= 40")
    return components.drop_small(components.label(flat, _BY), 10, _BY, keep_one=False).select("year", "r", "c")


_PERIODS = "y AS (SELECT DISTINCT year FROM fx_depth), p AS (SELECT lag(year) OVER (ORDER BY year) AS y1, year AS y2 FROM y), w AS (SELECT year, r, c FROM fx_depth WHERE -z > 5)"


@query(
    "shoreline_patches",
    _sql(
        f"""{_PERIODS}, a AS (SELECT y1, y2, w.r, w.c FROM p JOIN w ON w.year = p.y1), b AS (SELECT y1, y2, w.r, w.c FROM p JOIN w ON w.year = p.y2),
        x AS (SELECT y1, y2, r, c, 1 AS kind FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT y1, y2, r, c, 0 FROM (SELECT * FROM a EXCEPT SELECT * FROM b)),
        m AS (SELECT y1 * 2 + kind AS year, r, c, CAST(r AS BIGINT) * 2147483648 + c AS node FROM x WHERE y1 IS NOT NULL), {_reach('m', 'q', _FOUR)}
        SELECT y1 || '-' || y2 AS period, y1 AS year_from, y2 AS year_to, CASE q_l.year % 2 WHEN 1 THEN 'Erosion' ELSE 'Accretion' END AS change_type, label, count(*) AS cells, count(*) * 100.0::DOUBLE AS area_m2, count(*) / 100.0::DOUBLE AS area_ha
        FROM q_l JOIN p ON p.y1 = q_l.year // 2 GROUP BY ALL HAVING count(*) * 100 >= 300"""
    ),
)
def _(spark, sf):
    wet = temporal.year_water_mask(maps(spark, sf), 5.0)
    periods = temporal.change_periods(maps(spark, sf).select("year").distinct()).filter("kind = 'Sequential'")
    return temporal.shoreline_patches(wet, periods, 100.0, 300.0)


@query("water_mask_hybrid", None)
def _(spark, sf):
    return jobs.hybrid_water(reflected(spark, sf), grid_bounds(), by=_SCENE)


@query("combined_mask", f"WITH {REFLECTED} SELECT scene_id, r, c FROM s WHERE scl = 6 AND blue > 0.05::DOUBLE", "spectra")
def _(spark, sf):
    s = reflected(spark, sf)
    shallow = s.filter("blue > 0.05").select("scene_id", "r", "c")
    return s.filter("scl = 6").join(shallow, ["scene_id", "r", "c"], "left_semi").select("scene_id", "r", "c")


_OSW = "WITH s AS (SELECT scene_id, r, c, blue_dn/10000.0::DOUBLE AS blue, green_dn/10000.0::DOUBLE AS green, nir_dn/10000.0::DOUBLE AS nir FROM fx_spectra)"


# The values of a band are spread evenly, so nothing is 2 deviations over the mean; 1.5 are asked for.
_BRIGHT = "t AS (SELECT scene_id, avg(blue) + 1.5::DOUBLE * stddev_pop(blue) AS tb, avg(green) + 1.5::DOUBLE * stddev_pop(green) AS tg FROM s JOIN k USING (scene_id) WHERE nir <= k GROUP BY ALL) SELECT scene_id, r, c FROM s JOIN t USING (scene_id) WHERE blue > tb OR green > tg"


@query("osw_nir_percentile", f"{_OSW}, k AS (SELECT scene_id, quantile_cont(nir, 0.4) AS k FROM s GROUP BY ALL), {_BRIGHT}", "spectra")
def _(spark, sf):
    return jobs.shallow_by_deep(reflected(spark, sf), jobs.nir_percentile(0.4), _SCENE, 1.5).select("scene_id", "r", "c")


@query(
    "osw_knee",
    f"""{_OSW}, v AS (SELECT scene_id, nir, (row_number() OVER (w ORDER BY nir) - 1) / (count(*) OVER w - 1)::DOUBLE AS x, (nir - min(nir) OVER w) / (max(nir) OVER w - min(nir) OVER w) AS y FROM s WHERE nir > 0 WINDOW w AS (PARTITION BY scene_id)),
        k AS (SELECT scene_id, nir AS k FROM v QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY round(abs(x - y), 9) DESC, nir) = 1), {_BRIGHT}""",
    "spectra",
)
def _(spark, sf):
    return jobs.shallow_by_deep(reflected(spark, sf), jobs.nir_knee, _SCENE, 1.5).select("scene_id", "r", "c")


@query("osw_cluster", None)
def _(spark, sf):
    return models.cluster_deep_water(reflected(spark, sf), ["blue", "green", "nir"]).select("scene_id", "r", "c", "deep")


@query("osw_stats", f"{_OSW} SELECT scene_id, count(*) AS n, round(avg(blue), 6) + 0.0 AS blue_mean, round(stddev_pop(blue), 6) + 0.0 AS blue_std, round(avg(blue) + 2 * stddev_pop(blue), 6) + 0.0 AS blue_limit FROM s GROUP BY scene_id", "spectra")
def _(spark, sf):
    s = reflected(spark, sf)
    return s.groupBy("scene_id").agg(F.count("*").alias("n"), r6(F.avg("blue")).alias("blue_mean"), r6(F.stddev_pop("blue")).alias("blue_std"), r6(F.avg("blue") + 2 * F.stddev_pop("blue")).alias("blue_limit"))


_LYZ = """WITH s AS (SELECT f.scene_id, d.year, f.r, f.c, blue_dn/10000.0::DOUBLE AS blue, green_dn/10000.0::DOUBLE AS green, d.z FROM fx_spectra f JOIN fx_depth d ON d.r = f.r AND d.c = f.c),
  k AS (SELECT scene_id, year, CASE WHEN count(*) FILTER (WHERE abs(z) > 15) > 50 THEN quantile_cont(blue, 0.05) FILTER (WHERE abs(z) > 15) ELSE greatest(quantile_cont(blue, 0.01), 0.001) END AS rb, CASE WHEN count(*) FILTER (WHERE abs(z) > 15) > 50 THEN quantile_cont(green, 0.05) FILTER (WHERE abs(z) > 15) ELSE greatest(quantile_cont(green, 0.01), 0.001) END AS rg FROM s GROUP BY scene_id, year),
  x AS (SELECT scene_id, year, r, c, z, ln(greatest(blue - rb, 1e-4::DOUBLE)) - 0.75::DOUBLE * ln(greatest(green - rg, 1e-4::DOUBLE)) AS dii, (green - rg) * exp(0.24::DOUBLE * abs(z)) AS bottom FROM s JOIN k USING (scene_id, year))"""


def lyzenga(spark, sf):
    s = reflected(spark, sf).join(maps(spark, sf).select("year", "r", "c", "z"), ["r", "c"])
    return robust.lyzenga(s, F.col("z"), by=["scene_id", "year"])


@query("dii_bottom_reflectance", f"{_LYZ} SELECT scene_id, year, r, c, round(dii, 6) + 0.0 AS dii, round(bottom, 6) + 0.0 AS bottom FROM x", "spectra", "depth")
def _(spark, sf):
    return lyzenga(spark, sf).select("scene_id", "year", "r", "c", r6("dii").alias("dii"), r6("bottom").alias("bottom"))


@query("benthic_rule", f"{_LYZ}, h AS (SELECT scene_id, year, round(median(dii), 6) AS m FROM x GROUP BY ALL) SELECT scene_id, year, r, c FROM x JOIN h USING (scene_id, year) WHERE round(dii, 6) < m AND abs(z) < 20", "spectra", "depth")
def _(spark, sf):
    x = lyzenga(spark, sf)
    middle = exact_median(x, "dii", "m", ["scene_id", "year"]).withColumn("m", F.round("m", 6))
    return beside(x, middle, ["scene_id", "year"]).filter((F.round("dii", 6) < F.col("m")) & (F.abs("z") < 20)).select("scene_id", "year", "r", "c")


# Models

_LINE = f"WITH {_SAMPLED}, l AS (SELECT regr_slope(depth, nir) AS b, regr_intercept(depth, nir) AS a FROM x)"


@query("predict_cells_linear", f"{_LINE} SELECT s.scene_id, s.r, s.c, round(a + b * s.nir, 4) + 0.0 AS y_pred FROM s CROSS JOIN l", "points", "spectra")
def _(spark, sf):
    line = sampled(spark, sf).agg(F.regr_slope("depth", "nir").alias("b"), F.regr_intercept("depth", "nir").alias("a"))
    return reflected(spark, sf).crossJoin(F.broadcast(line)).select("scene_id", "r", "c", (F.round(F.col("a") + F.col("b") * F.col("nir"), 4) + 0.0).alias("y_pred"))


@query("evaluate_map", f"{_LINE}, p AS (SELECT depth AS t, a + b * nir AS p FROM x CROSS JOIN l) SELECT count(*) AS n, round(sqrt(avg(power(p - t, 2))), 4) + 0.0 AS rmse, round(avg(abs(p - t)), 4) + 0.0 AS mae FROM p", "points", "spectra")
def _(spark, sf):
    x = sampled(spark, sf)
    line = x.agg(F.regr_slope("depth", "nir").alias("b"), F.regr_intercept("depth", "nir").alias("a"))
    p = x.crossJoin(F.broadcast(line)).select(F.col("depth").alias("y_true"), (F.col("a") + F.col("b") * F.col("nir")).alias("y_pred"))
    return metrics.regression_metrics(p).select("n", (F.round("rmse", 4) + 0.0).alias("rmse"), (F.round("mae", 4) + 0.0).alias("mae"))


@query("fit_models", None)
def _(spark, sf):
    return crossfit.cross_scores(counted(spark, sf), _FEATURES, count="_n")


@query("predict_cells_forest", None)
def _(spark, sf):
    model = models.fit(counted(spark, sf), _FEATURES, ["forest"], count="_n")["forest"]
    return models.predict(model, reflected(spark, sf), _FEATURES).select("scene_id", "r", "c", "y_pred")


@query("spatial_folds", f"WITH {_SAMPLED} SELECT point_id, scene_id, CAST((floor(r / 8.0) * 1000003 + floor(c / 8.0))::BIGINT % 5 AS INT) AS fold FROM x", "points", "spectra")
def _(spark, sf):
    return models.tile_folds(sampled(spark, sf)).select("point_id", "scene_id", "fold")


@query("spatial_folds_kmeans", None)
def _(spark, sf):
    return models.kmeans_folds(sampled(spark, sf)).select("point_id", "scene_id", "fold")


@query("grid_search", None)
def _(spark, sf):
    return crossfit.search(counted(spark, sf), _FEATURES, "elastic_net", crossfit.grid({"regParam": [0.01, 0.1, 0.5], "elasticNetParam": [0.0, 1.0]}), folds=2, count="_n")


@query("random_search", None)
def _(spark, sf):
    space = {"maxDepth": [2, 6], "minInstancesPerNode": [1, 20], "minInfoGain": [0.0, 0.1]}
    return crossfit.search(counted(spark, sf), _FEATURES, "tree", crossfit.draws(space, 8), folds=4, kind="kmeans", count="_n", refit=True)[0]


@query("huber_depth_correction", None)
def _(spark, sf):
    """Each year's soundings against that year's map, and the map moved by the year's own robust line."""
    met = pts(spark, sf).select("year", "r", "c", F.col("depth").alias("y_true")).join(maps(spark, sf).select("year", "r", "c", F.col("z").alias("y_pred")), ["year", "r", "c"])
    return fits.huber_by_group(met, maps(spark, sf), ["year"]).select("year", "r", "c", "z")


@query("bias_shift", "WITH b AS (SELECT avg(CAST(y_true AS DOUBLE) - CAST(y_pred AS DOUBLE)) AS b FROM fx_pairs) SELECT year, r, c, round(z + b, 6) + 0.0 AS z FROM fx_depth CROSS JOIN b", "depth", "pairs")
def _(spark, sf):
    from shoalgrid.plans.contract_points import pairs

    return robust.bias_shift(pairs(spark, sf), maps(spark, sf)).select("year", "r", "c", r6("z").alias("z"))


@query("global_year_matrix", "SELECT year, r, c, CAST(year AS DOUBLE) AS year_feature FROM fx_depth WHERE year IN (SELECT year FROM fx_depth GROUP BY year HAVING count(*) >= 10)", "depth")
def _(spark, sf):
    return models.year_matrix(maps(spark, sf)).select("year", "r", "c", "year_feature")


@query("ensemble_fusion", "SELECT r, c, round(median(z), 6) + 0.0 AS z FROM fx_depth GROUP BY r, c", "depth")
def _(spark, sf):
    return temporal.fused_depth(maps(spark, sf), "median").select("r", "c", r6("z").alias("z"))


@query("quantile_sigma", f"WITH {_SAMPLED} SELECT point_id, scene_id, round((quantile_cont(depth, 0.84) OVER w - quantile_cont(depth, 0.16) OVER w) / 2, 6) + 0.0 AS sigma FROM x WINDOW w AS (PARTITION BY CAST(floor(nir / 0.01) AS INT))", "points", "spectra")
def _(spark, sf):
    return jobs.quantile_sigma(sampled(spark, sf), "nir", "depth", 0.01).select("point_id", "scene_id", r6("sigma").alias("sigma"))


# Whole jobs

@query("job_single_scene_depth", None)
def _(spark, sf):
    return depth_jobs.scene_depths(reflected(spark, sf), pts(spark, sf), grid_bounds())


@query("job_multi_scene_chain", None)
def _(spark, sf):
    depths = depth_jobs.written(depth_jobs.scene_depths(reflected(spark, sf), pts(spark, sf), grid_bounds()), "scenes")
    return depth_jobs.multi_scene_depth(depths, pts(spark, sf))[0]


@query("job_coastal_change", None)
def _(spark, sf):
    return jobs.coastal_change(maps(spark, sf), 100.0)


@query("job_scene_prep", "SELECT scene_id, r, c, round(CASE WHEN blue_dn > 0 THEN blue_dn*0.0000275::DOUBLE - 0.2::DOUBLE END, 6) + 0.0 AS blue FROM fx_spectra WHERE scl NOT IN (0,1,3,8,9,10,11)", "spectra")
def _(spark, sf):
    x = view(spark, sf, "spectra").filter(~qa.scl_invalid(F.col("scl")))
    return x.select("scene_id", "r", "c", r6(reflectance.landsat_reflectance(F.col("blue_dn"))).alias("blue"))


@query("job_post_aggregate", None)
def _(spark, sf):
    from shoalgrid.plans.contract_maps import scene_depths

    return spatial.remove_positive(temporal.aggregate_scenes(scene_depths(spark, sf), "weighted_median"))
