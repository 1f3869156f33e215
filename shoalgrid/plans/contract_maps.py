"""Queries over yearly depth maps and over scenes of cells: composites, change, neighbourhoods and joins of cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoalgrid.functions import qa
from shoalgrid.operators import focal, masks, spatial, temporal
from shoalgrid.plans.contract_cells import REFLECTED, reflected
from shoalgrid.plans import fixtures
from shoalgrid.plans.fixtures import view
from shoalgrid.plans.registry import query, r6

AREA = 100.0
BASE = 0.16
_ALL = "z AS (SELECT * FROM fx_depth WHERE abs(z) > 0.1 AND abs(z) < 15000)"
_YEARS = "y AS (SELECT year AS y2, lag(year) OVER (ORDER BY year) AS y1 FROM (SELECT DISTINCT year FROM fx_depth) q)"
_SEQ = f"{_YEARS}, p AS (SELECT y1 || '-' || y2 AS period, 'Sequential' AS kind, y1, y2 FROM y WHERE y1 IS NOT NULL)"
_SPAN = f"{_YEARS}, p AS (SELECT y1 || '-' || y2 AS period, 'Sequential' AS kind, y1, y2 FROM y WHERE y1 IS NOT NULL UNION ALL SELECT min(year) || '-' || max(year), 'Long-term Trend', min(year), max(year) FROM fx_depth HAVING count(DISTINCT year) > 2)"
_PAIRS = f"{_ALL}, {_SEQ}, m AS (SELECT p.period, p.y1, p.y2, a.r, a.c, a.z AS z1, b.z AS z2, a.u AS u1, b.u AS u2 FROM p JOIN z a ON a.year = p.y1 JOIN z b ON b.year = p.y2 AND a.r = b.r AND a.c = b.c)"
_CHANGE = _PAIRS + f", g AS (SELECT period, avg(z1) > 0 AS down FROM m GROUP BY period), k AS (SELECT m.*, CASE WHEN down THEN z1 - z2 ELSE z2 - z1 END AS dz, {BASE}::DOUBLE + 0.1::DOUBLE * abs(z1) AS lim FROM m JOIN g ON m.period = g.period), x AS (SELECT *, CASE WHEN dz > lim THEN 1 WHEN dz < -lim THEN -1 ELSE 0 END AS change FROM k)"


def maps(spark, sf):
    return view(spark, sf, "depth")


def periods(spark, sf, kind="sequential"):
    return temporal.change_periods(maps(spark, sf).select("year").distinct(), kind)


def pairs(spark, sf):
    return temporal.aligned_pairs(maps(spark, sf), periods(spark, sf).filter("kind = 'Sequential'"))


def changed(spark, sf, base=BASE):
    return temporal.significant_change(pairs(spark, sf), base)


_VOLUME = "round(coalesce(sum(dz) FILTER (WHERE change = 1), 0) * 100, 6) + 0.0 AS accretion_m3, round(coalesce(sum(-dz) FILTER (WHERE change = -1), 0) * 100, 6) + 0.0 AS erosion_m3, round((coalesce(sum(dz) FILTER (WHERE change = 1), 0) - coalesce(sum(-dz) FILTER (WHERE change = -1), 0)) * 100, 6) + 0.0 AS net_balance_m3"


@query("sediment_volumes_manual", f"WITH {_CHANGE} SELECT period, {_VOLUME} FROM x GROUP BY period", "depth")
def _(spark, sf):
    out = temporal.sediment_volumes(changed(spark, sf), AREA, opening=False)
    return out.select("period", *[r6(c).alias(c) for c in ("accretion_m3", "erosion_m3", "net_balance_m3")])


_TARGET = "r BETWEEN 4 AND 20 AND c < 16"


@query("sediment_volumes_target", f"WITH {_CHANGE} SELECT period, {_VOLUME}, {_VOLUME.replace('accretion_m3', 'target_accretion_m3').replace('erosion_m3', 'target_erosion_m3').replace('net_balance_m3', 'target_net_balance_m3').replace('WHERE ', f'WHERE {_TARGET} AND ')} FROM x GROUP BY period", "depth")
def _(spark, sf):
    target = maps(spark, sf).filter(_TARGET).select("r", "c")
    out = temporal.sediment_volumes(changed(spark, sf), AREA, opening=False, target=target)
    return out.select("period", *[r6(c).alias(c) for c in out.columns if c != "period"])


def _window(src, by, extra=""):
    """Erosion then dilation of the cells of ``src`` in SQL."""
    return f"""{src}e AS (SELECT {by}, a.r, a.c FROM {src} a WHERE (SELECT count(*) FROM {src} b WHERE b.{by} = a.{by} AND b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1) = 9),
      {src}o AS (SELECT DISTINCT {by}, r + i AS r, c + j AS c FROM {src}e, range(-1, 2) q(i), range(-1, 2) w(j))"""


@query(
    "sediment_volumes",
    f"""WITH {_CHANGE}, up AS (SELECT period, r, c FROM x WHERE change = 1), dn AS (SELECT period, r, c FROM x WHERE change = -1), {_window('up', 'period')}, {_window('dn', 'period')},
        v AS (SELECT x.period, CASE WHEN u.r IS NULL AND d.r IS NULL THEN 0 ELSE change END AS change, dz FROM x LEFT JOIN upo u ON change = 1 AND x.period = u.period AND x.r = u.r AND x.c = u.c LEFT JOIN dno d ON change = -1 AND x.period = d.period AND x.r = d.r AND x.c = d.c)
        SELECT period, {_VOLUME} FROM v GROUP BY period""",
    "depth",
)
def _(spark, sf):
    out = temporal.sediment_volumes(changed(spark, sf), AREA)
    return out.select("period", *[r6(c).alias(c) for c in ("accretion_m3", "erosion_m3", "net_balance_m3")])


@query("sediment_balance_report", f"WITH {_CHANGE} SELECT period AS Period, 'Sequential' AS Type, round(coalesce(sum(dz) FILTER (WHERE change = 1), 0) * 100, 2) + 0.0 AS accretion_m3, round(coalesce(sum(-dz) FILTER (WHERE change = -1), 0) * 100, 2) + 0.0 AS erosion_m3 FROM x GROUP BY period", "depth")
def _(spark, sf):
    out = temporal.sediment_volumes(changed(spark, sf), AREA, opening=False)
    return out.select(F.col("period").alias("Period"), F.lit("Sequential").alias("Type"), *[(F.round(c, 2) + 0.0).alias(c) for c in ("accretion_m3", "erosion_m3")])


@query("change_periods", f"WITH {_SPAN} SELECT period, kind, y1, y2 FROM p", "depth")
def _(spark, sf):
    return periods(spark, sf)


@query("change_periods_baseline", "WITH y AS (SELECT DISTINCT year AS y2, min(year) OVER () AS y1 FROM fx_depth) SELECT y1 || '-' || y2 AS period, 'Baseline' AS kind, y1, y2 FROM y WHERE y1 < y2", "depth")
def _(spark, sf):
    return periods(spark, sf, "baseline")


@query("align_years", f"WITH {_PAIRS} SELECT period, r, c, z1, z2, u1, u2 FROM m", "depth")
def _(spark, sf):
    return pairs(spark, sf).select("period", "r", "c", "z1", "z2", "u1", "u2")


@query("temporal_valid_mask", f"WITH {_ALL} SELECT year, count(*) AS n FROM z GROUP BY year", "depth")
def _(spark, sf):
    return maps(spark, sf).filter((F.abs("z") > 0.1) & (F.abs("z") < 15000)).groupBy("year").agg(F.count("*").alias("n"))


@query("depth_of_closure", f"WITH {_PAIRS} SELECT period, r, c FROM m WHERE -z1 <= 15 AND -z2 <= 15", "depth")
def _(spark, sf):
    return temporal.depth_of_closure(pairs(spark, sf), 15.0).select("period", "r", "c")


@query("change_significance", f"WITH {_CHANGE} SELECT period, r, c, dz, round(lim, 6) + 0.0 AS lim, change FROM x", "depth")
def _(spark, sf):
    return changed(spark, sf).select("period", "r", "c", "dz", r6("limit").alias("lim"), "change")


_OTSU = """d AS (SELECT period, abs(z2 - z1) AS d FROM m), sp AS (SELECT period, min(d) AS lo, max(d) AS hi FROM d GROUP BY period),
  h AS (SELECT d.period, CAST(least(floor((d - lo) / (hi - lo) * 256), 255) AS INT) AS b, count(*) AS n FROM d JOIN sp ON d.period = sp.period WHERE hi > lo GROUP BY ALL),
  kk AS (SELECT *, sum(n) OVER w AS wb, sum(n * (b + 0.5)) OVER w AS mb, sum(n) OVER t AS wt, sum(n * (b + 0.5)) OVER t AS mt FROM h WINDOW w AS (PARTITION BY period ORDER BY b), t AS (PARTITION BY period)),
  vv AS (SELECT period, b, round(wb * (wt - wb) * pow(mb / wb - (mt - mb) / (wt - wb), 2), 6) AS var FROM kk WHERE wt > wb),
  bb AS (SELECT period, min(b) AS b FROM vv WHERE var = (SELECT max(var) FROM vv w WHERE w.period = vv.period) GROUP BY period)"""


@query("change_threshold_otsu", f"WITH {_PAIRS}, {_OTSU} SELECT sp.period, round(lo + (b + 0.5) / 256 * (hi - lo), 6) + 0.0 AS base FROM sp JOIN bb ON sp.period = bb.period", "depth")
def _(spark, sf):
    return temporal.change_threshold(pairs(spark, sf), None).select("period", r6("base").alias("base"))


@query(
    "msi",
    "WITH a AS (SELECT r, c, avg(z) AS mean, var_pop(z) AS v, arg_min(u, year) AS u1, arg_max(u, year) AS u2 FROM fx_depth GROUP BY r, c), b AS (SELECT *, sqrt(greatest(0, v - (u1*u1 + u2*u2) / 2)) AS sigma FROM a) SELECT r, c, round(sigma, 6) + 0.0 AS sigma, round(least(greatest(1 - sigma / (abs(mean) + 0.5), 0), 1), 6) + 0.0 AS msi FROM b",
    "depth",
)
def _(spark, sf):
    return temporal.stability(maps(spark, sf)).select("r", "c", r6("sigma").alias("sigma"), r6("msi").alias("msi"))


@query("depth_trend", "WITH k AS (SELECT r, c, CASE WHEN count(DISTINCT year) > 1 THEN regr_slope(z, year) ELSE 0 END AS k FROM fx_depth GROUP BY r, c) SELECT r, c, round(k, 6) + 0.0 AS slope, round(k * (SELECT max(year) - min(year) FROM fx_depth), 6) + 0.0 AS total FROM k", "depth")
def _(spark, sf):
    return temporal.depth_trend(maps(spark, sf)).select("r", "c", r6("slope").alias("slope"), r6("total").alias("total"))


@query("statcd_ucomb_classical", f"WITH {_PAIRS} SELECT period, r, c, CASE WHEN abs(z2 - z1) >= 1.96::DOUBLE * sqrt(u1*u1 + u2*u2) THEN z2 - z1 ELSE 0 END AS dz FROM m", "depth")
def _(spark, sf):
    return temporal.combined_uncertainty(pairs(spark, sf), "classical").select("period", "r", "c", "dz")


@query("statcd_ucomb_mad", f"WITH {_PAIRS}, t AS (SELECT 1.4826::DOUBLE * median(abs(z2 - z1 - (SELECT median(z2 - z1) FROM m))) AS u FROM m) SELECT period, r, c, CASE WHEN abs(z2 - z1) >= u THEN z2 - z1 ELSE 0 END AS dz FROM m CROSS JOIN t", "depth")
def _(spark, sf):
    return temporal.combined_uncertainty(pairs(spark, sf), "mad").select("period", "r", "c", "dz")


@query("statcd_ucomb_quantile", f"WITH {_PAIRS}, t AS (SELECT (quantile_cont(z2 - z1, 0.75) - quantile_cont(z2 - z1, 0.25)) / 1.349::DOUBLE AS u FROM m) SELECT period, r, c, CASE WHEN abs(z2 - z1) >= u THEN z2 - z1 ELSE 0 END AS dz FROM m CROSS JOIN t", "depth")
def _(spark, sf):
    return temporal.combined_uncertainty(pairs(spark, sf), "quantile").select("period", "r", "c", "dz")


@query("raster_health", "SELECT year FROM fx_depth WHERE abs(z) > 1e-4 AND abs(z) < 15000 GROUP BY year HAVING count(*) > 10", "depth")
def _(spark, sf):
    return temporal.healthy_years(maps(spark, sf))


@query("year_water_mask", "SELECT year, r, c, -z > 5 AS water FROM fx_depth", "depth")
def _(spark, sf):
    return temporal.year_water_mask(maps(spark, sf), 5.0)


@query(
    "shoreline_change_area",
    f"""WITH {_SEQ}, w AS (SELECT year, r, c FROM fx_depth WHERE -z > 5), a AS (SELECT p.period, w.r, w.c FROM p JOIN w ON w.year = p.y1), b AS (SELECT p.period, w.r, w.c FROM p JOIN w ON w.year = p.y2)
        SELECT period, change_type, count(*) AS cells, count(*) * 100.0::DOUBLE AS area_m2 FROM (SELECT period, 'Erosion' AS change_type FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT period, 'Accretion' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) t GROUP BY ALL""",
    "depth",
)
def _(spark, sf):
    wet = temporal.year_water_mask(maps(spark, sf), 5.0)
    return temporal.shoreline_change(wet, periods(spark, sf).filter("kind = 'Sequential'"), AREA)


@query("remove_positive_cells", "WITH m AS (SELECT median(z + 8) AS m FROM fx_depth) SELECT year, r, c, z + 8 AS z FROM fx_depth CROSS JOIN m WHERE m >= 0 OR z + 8 < 0", "depth")
def _(spark, sf):
    return spatial.remove_positive(maps(spark, sf).withColumn("z", F.col("z") + 8)).select("year", "r", "c", "z")


@query("clean_depth_map", "SELECT d.year, d.r, d.c, d.z FROM fx_depth d JOIN (SELECT r, c FROM fx_spectra WHERE scene_id = 1 AND scl > 2) m ON d.r = m.r AND d.c = m.c WHERE abs(d.z) <= 1.5 * 12", "depth", "spectra")
def _(spark, sf):
    mask = view(spark, sf, "spectra").filter("scene_id = 1").select("r", "c", F.when(F.col("scl") > 2, 1.0).otherwise(0.0).alias("m"))
    return spatial.clean_depth(maps(spark, sf), mask, "m", 12.0).select("year", "r", "c", "z")


@query("mask_cells", "SELECT year, r, c FROM fx_depth d WHERE NOT EXISTS (SELECT 1 FROM fx_spectra s WHERE s.scene_id = 2 AND s.scl < 6 AND s.r = d.r AND s.c = d.c)", "depth", "spectra")
def _(spark, sf):
    m = view(spark, sf, "spectra").filter("scene_id = 2 AND scl < 6").select("r", "c")
    return maps(spark, sf).join(m, ["r", "c"], "left_anti").select("year", "r", "c")


@query("raster_min_max", "WITH s AS (SELECT count(*) FILTER (WHERE z < 0) >= count(*) FILTER (WHERE z > 0) AS neg FROM fx_depth) SELECT min(z) AS z_min, max(z) AS z_max FROM fx_depth CROSS JOIN s WHERE CASE WHEN neg THEN z < 0 ELSE z > 0 END", "depth")
def _(spark, sf):
    return spatial.dominant_range(maps(spark, sf), "z")


@query("symmetric_color_bounds", f"WITH {_PAIRS} SELECT round(CASE WHEN b < 0.1 THEN 0.5 ELSE b END, 6) + 0.0 AS bound FROM (SELECT greatest(abs(avg(z2 - z1) - 2.5::DOUBLE * stddev_pop(z2 - z1)), abs(avg(z2 - z1) + 2.5::DOUBLE * stddev_pop(z2 - z1))) AS b FROM m) t", "depth")
def _(spark, sf):
    return spatial.symmetric_bounds(pairs(spark, sf).withColumn("dz", F.col("z2") - F.col("z1")), "dz").select(r6("bound").alias("bound"))


@query("bbox_of_valid", "SELECT year, min(r) - 1 AS r0, min(c) - 1 AS c0, max(r) + 1 AS r1, max(c) + 1 AS c1 FROM fx_depth WHERE z < -20 GROUP BY year", "depth")
def _(spark, sf):
    return spatial.bbox(maps(spark, sf).filter("z < -20"), 1, ["year"])


for _kind in ("float32", "double", "uint16"):
    _cast = {"float32": "CAST(-z AS FLOAT)", "double": "-z", "uint16": "CAST(floor(least(greatest(-z, 0), 65534)) AS INT)"}[_kind]

    def _product(spark, sf, kind=_kind):
        from shoalgrid.sources.tables import depth_product

        return depth_product(maps(spark, sf).select("year", "r", "c", (-F.col("z")).alias("z")), kind)

    query(f"write_depth_product_{_kind}", f"SELECT year, r, c, {_cast} AS z FROM fx_depth", "depth")(_product)

# Scenes of depths

_SC = "s AS (SELECT scene_id, r, c, CASE WHEN scl <> 3 THEN -(blue_dn / 100.0::DOUBLE) * (CASE WHEN nir_dn > 300 THEN -1 ELSE 1 END) END AS z, CAST(swir_dn AS DOUBLE) AS w FROM fx_spectra)"
_AGG = {
    "median": "median(z)",
    "mean": "avg(z)",
    "deepest": "arg_max(z, struct_pack(a := abs(z), k := -scene_id))",
    "shallowest": "arg_min(z, struct_pack(a := abs(z), k := scene_id))",
    "weighted_mean": "CASE WHEN sum(w) > 0 THEN sum(z * w) / sum(w) END",
}


def scene_depths(spark, sf):
    z = -(F.col("blue_dn") / F.lit(100.0)) * F.when(F.col("nir_dn") > 300, -1).otherwise(1)
    return view(spark, sf, "spectra").select("scene_id", "r", "c", F.when(F.col("scl") != 3, z).alias("z"), F.col("swir_dn").cast("double").alias("w"))


for _method in (*_AGG, "weighted_median"):
    _body = f"SELECT r, c, round({_AGG[_method]}, 6) + 0.0 AS z FROM s WHERE z IS NOT NULL GROUP BY r, c" if _method in _AGG else "SELECT r, c, round(min(z), 6) + 0.0 AS z FROM (SELECT r, c, z, sum(w) OVER (PARTITION BY r, c ORDER BY z, scene_id ROWS UNBOUNDED PRECEDING) AS u, sum(w) OVER (PARTITION BY r, c) AS t FROM s WHERE z IS NOT NULL) q WHERE u >= t / 2 GROUP BY r, c"

    def _aggregate(spark, sf, method=_method):
        return temporal.aggregate_scenes(scene_depths(spark, sf), method).select("r", "c", r6("z").alias("z"))

    query(f"agg_{_method}", f"WITH {_SC} {_body}", "spectra")(_aggregate)


@query("select_best_scene", f"WITH {_SC}, q AS (SELECT scene_id, greatest(0.001::DOUBLE, count(z) / count(*)::DOUBLE) / (greatest(0.001::DOUBLE, stddev_pop(z)) + 0.001::DOUBLE) AS w FROM s GROUP BY scene_id), b AS (SELECT scene_id FROM q ORDER BY round(w, 9) DESC, scene_id LIMIT 1) SELECT s.scene_id, r, c, z FROM s JOIN b ON s.scene_id = b.scene_id", "spectra")
def _(spark, sf):
    from shoalgrid.functions.geo import scene_weight

    s = scene_depths(spark, sf)
    weights = s.groupBy("scene_id").agg(scene_weight(F.count("z") / F.count("*"), F.stddev_pop("z")).alias("w"))
    best = weights.agg(F.max_by("scene_id", F.struct(F.round("w", 9), -F.col("scene_id"))).alias("scene_id"))
    return s.join(F.broadcast(best), "scene_id", "left_semi").select("scene_id", "r", "c", "z")


@query("attach_scene_weights", f"WITH {_SC}, q AS (SELECT scene_id, count(z) AS w FROM s GROUP BY scene_id) SELECT s.scene_id, r, c, q.w FROM s JOIN q ON s.scene_id = q.scene_id WHERE z IS NOT NULL", "spectra")
def _(spark, sf):
    s = scene_depths(spark, sf).drop("w")
    weights = s.groupBy("scene_id").agg(F.count("z").alias("w"))
    return s.filter("z IS NOT NULL").join(weights, "scene_id").select("scene_id", "r", "c", "w")


@query("mask_intersection", f"WITH {_SC} SELECT r, c FROM s WHERE z IS NOT NULL GROUP BY r, c HAVING count(*) = (SELECT count(DISTINCT scene_id) FROM s)", "spectra")
def _(spark, sf):
    s = scene_depths(spark, sf)
    n = s.agg(F.count_distinct("scene_id").alias("n"))
    return s.filter("z IS NOT NULL").groupBy("r", "c").agg(F.count("*").alias("k")).crossJoin(F.broadcast(n)).filter("k = n").select("r", "c")


@query("temporal_median_composite", f"WITH {REFLECTED}, q AS (SELECT r, c, count(*) AS valid_count, median(blue) AS blue, median(green) AS green, stddev_pop(blue) AS std FROM s WHERE scl NOT IN (0,1,3,8,9,10,11) GROUP BY r, c) SELECT r, c, valid_count, CASE WHEN valid_count >= 2 THEN round(blue, 6) + 0.0 END AS blue, CASE WHEN valid_count >= 2 THEN round(green, 6) + 0.0 END AS green, CASE WHEN valid_count >= 2 THEN round(std, 6) + 0.0 END AS std FROM q", "spectra")
def _(spark, sf):
    out = temporal.composite(reflected(spark, sf), ["blue", "green"], ~qa.scl_invalid(F.col("scl")), 2)
    return out.select("r", "c", "valid_count", *[r6(b).alias(b) for b in ("blue", "green", "std")])


@query("water_occurrence", "SELECT r, c, round(100.0::DOUBLE * count(*) FILTER (WHERE scl = 6) / nullif(count(*) FILTER (WHERE scl NOT IN (0,1,3,8,9,10,11)), 0), 6) + 0.0 AS occurrence, 100.0::DOUBLE * count(*) FILTER (WHERE scl = 6) / nullif(count(*) FILTER (WHERE scl NOT IN (0,1,3,8,9,10,11)), 0) >= 30 AS water FROM fx_spectra GROUP BY r, c", "spectra")
def _(spark, sf):
    flagged = view(spark, sf, "spectra").withColumn("flag", masks.water_flag(qa.scl_invalid(F.col("scl")), qa.scl_water(F.col("scl"))))
    return temporal.water_occurrence(flagged, "hybrid", 50.0).select("r", "c", r6("occurrence").alias("occurrence"), "water")


@query("fused_depth", "SELECT r, c, round(sum(z / (u*u + 1e-4::DOUBLE)) / sum(1 / (u*u + 1e-4::DOUBLE)), 6) + 0.0 AS z FROM fx_depth GROUP BY r, c", "depth")
def _(spark, sf):
    return temporal.fused_depth(maps(spark, sf)).select("r", "c", r6("z").alias("z"))


# Neighbourhoods

_NEAR = "b.year = a.year AND b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1"


@query("focal_median", f"SELECT a.year, a.r, a.c, median(b.z) AS median FROM fx_depth a JOIN fx_depth b ON {_NEAR} GROUP BY a.year, a.r, a.c", "depth")
def _(spark, sf):
    return focal.focal_median(maps(spark, sf), "z", ["year"])


def grid_bounds():
    return 0, 0, fixtures.SIDE - 1, fixtures.SIDE - 1


# Places of every cell's 3 x 3 window, those beyond the border as the border's (for this width its mirror image, too), and what is there: of a missing cell the nearest one with a value.
_WINDOWS = "o AS (SELECT i, j FROM range(-1, 2) a(i), range(-1, 2) b(j)), q AS (SELECT year, r, c, i, j, least(greatest(r + i, 0), 31) AS rr, least(greatest(c + j, 0), 31) AS cc FROM {src}, o)"
_FILLED = f"""{_WINDOWS}, p AS (SELECT DISTINCT year, rr, cc FROM q),
  f AS (SELECT p.year, rr, cc, arg_min(d.z, ((d.r - rr) * (d.r - rr) + (d.c - cc) * (d.c - cc)) * 1000000 + d.r * 1000 + d.c) AS v FROM p JOIN {{src}} d ON d.year = p.year AND d.r BETWEEN rr - 1 AND rr + 1 AND d.c BETWEEN cc - 1 AND cc + 1 GROUP BY ALL)"""
_SLOPE = "slopes AS (SELECT year, r, c, degrees(atan(sqrt(power(sum(v * j * CASE i WHEN 0 THEN 2 ELSE 1 END) / 80.0::DOUBLE, 2) + power(sum(v * -i * CASE j WHEN 0 THEN 2 ELSE 1 END) / 80.0::DOUBLE, 2)))) AS slope FROM q JOIN f USING (year, rr, cc) GROUP BY ALL)"
SLOPES = f"{_FILLED.replace('{src}', 'fx_depth')}, {_SLOPE}"
_GAPS = "x AS (SELECT * FROM fx_depth WHERE z < -6)"


@query("focal_median_zero_fill", f"WITH {_GAPS}, {_WINDOWS.replace('{src}', 'x')} SELECT q.year, q.r, q.c, median(coalesce(d.z, 0)) AS median FROM q LEFT JOIN x d ON d.year = q.year AND d.r = rr AND d.c = cc GROUP BY ALL", "depth")
def _(spark, sf):
    return focal.focal_median(maps(spark, sf).filter("z < -6"), "z", ["year"], fill=0.0, bounds=grid_bounds())


@query("focal_median_nearest_fill", f"WITH {_GAPS}, {_FILLED.replace('{src}', 'x')} SELECT year, r, c, median(v) AS median FROM q JOIN f USING (year, rr, cc) GROUP BY ALL", "depth")
def _(spark, sf):
    return focal.focal_median(maps(spark, sf).filter("z < -6"), "z", ["year"], fill="nearest", bounds=grid_bounds())


_M = "m AS (SELECT year, r, c FROM fx_depth WHERE z < -6)"


def deep(spark, sf):
    return maps(spark, sf).filter("z < -6").select("year", "r", "c")


@query("mask_median", f"WITH {_M} SELECT year, r, c FROM (SELECT year, r + i AS r, c + j AS c, count(*) AS n FROM m, range(-1, 2) q(i), range(-1, 2) w(j) GROUP BY ALL) t WHERE n > 4", "depth")
def _(spark, sf):
    return focal.mask_majority(deep(spark, sf), ["year"])


@query("horn_slope", f"WITH {SLOPES} SELECT year, r, c, round(slope, 6) + 0.0 AS slope FROM slopes", "depth")
def _(spark, sf):
    return focal.horn_slope(maps(spark, sf), "z", ["year"], bounds=grid_bounds()).select("year", "r", "c", r6("slope").alias("slope"))


@query("horn_slope_gaps", f"WITH {_GAPS}, {_FILLED.replace('{src}', 'x')}, {_SLOPE} SELECT year, r, c, round(slope, 6) + 0.0 AS slope FROM slopes", "depth")
def _(spark, sf):
    return focal.horn_slope(maps(spark, sf).filter("z < -6"), "z", ["year"], bounds=grid_bounds()).select("year", "r", "c", r6("slope").alias("slope"))


@query("dilate", f"WITH {_M} SELECT DISTINCT year, r + i AS r, c + j AS c FROM m, range(-1, 2) q(i), range(-1, 2) w(j)", "depth")
def _(spark, sf):
    return focal.dilate(deep(spark, sf), ["year"])


@query("erode", f"WITH {_M} SELECT year, r, c FROM (SELECT year, r + i AS r, c + j AS c, count(*) AS n FROM m, range(-1, 2) q(i), range(-1, 2) w(j) GROUP BY ALL) t WHERE n = 9", "depth")
def _(spark, sf):
    return focal.erode(deep(spark, sf), ["year"])


@query("binary_opening", f"WITH {_M}, e AS (SELECT year, r, c FROM (SELECT year, r + i AS r, c + j AS c, count(*) AS n FROM m, range(-1, 2) q(i), range(-1, 2) w(j) GROUP BY ALL) t WHERE n = 9) SELECT DISTINCT year, r + i AS r, c + j AS c FROM e, range(-1, 2) q(i), range(-1, 2) w(j)", "depth")
def _(spark, sf):
    return focal.binary_opening(deep(spark, sf), ["year"])


@query("binary_closing", f"WITH {_M}, e AS (SELECT DISTINCT year, r + i AS r, c + j AS c FROM m, range(-1, 2) q(i), range(-1, 2) w(j)) SELECT year, r, c FROM (SELECT year, r + i AS r, c + j AS c, count(*) AS n FROM e, range(-1, 2) q(i), range(-1, 2) w(j) GROUP BY ALL) t WHERE n = 9", "depth")
def _(spark, sf):
    return focal.binary_closing(deep(spark, sf), ["year"])


@query("shrink_mask", f"WITH {_M}, o AS (SELECT i, j FROM range(-2, 3) q(i), range(-2, 3) w(j) WHERE i*i + j*j <= 4) SELECT year, r, c FROM m a WHERE NOT EXISTS (SELECT 1 FROM o WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.year = a.year AND b.r = a.r + i AND b.c = a.c + j))", "depth")
def _(spark, sf):
    return focal.shrink(deep(spark, sf), 2.0, ["year"])


# Joins in space

_POLYGONS = {1: [(3.0, 3.0), (20.2, 5.1), (14.3, 25.7)], 2: [(8.1, 20.3), (28.4, 20.2), (28.3, 30.6), (18.2, 24.4), (8.3, 30.1)]}


def _edges_sql():
    rows = [f"({k}, {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for k, v in _POLYGONS.items() for a, b in zip(v, v[1:] + v[:1])]
    return f"e(poly_id, x0, y0, x1, y1) AS (VALUES {', '.join(rows)})"


_INSIDE = f"{_edges_sql()}, g AS (SELECT DISTINCT r, c, c + 0.5::DOUBLE AS x, r + 0.5::DOUBLE AS y FROM fx_depth), i AS (SELECT poly_id, r, c FROM g JOIN e ON (y0 <= y) <> (y1 <= y) AND x0 + (y - y0) * (x1 - x0) / (y1 - y0) > x GROUP BY poly_id, r, c HAVING count(*) % 2 = 1)"


def polygons(spark):
    return spark.createDataFrame([(k, v) for k, v in _POLYGONS.items()], "poly_id int, vertices array<struct<x:double,y:double>>")


@query("cells_in_polygon", f"WITH {_INSIDE} SELECT poly_id, r, c FROM i", "depth")
def _(spark, sf):
    return spatial.cells_in_polygons(maps(spark, sf).select("r", "c").distinct(), polygons(spark))


@query("zonal_stats", f"WITH {_INSIDE} SELECT poly_id, count(*) AS n, round(avg(z), 6) + 0.0 AS mean, round(stddev_pop(z), 6) + 0.0 AS std FROM i JOIN fx_depth d ON d.r = i.r AND d.c = i.c WHERE d.year = 1997 GROUP BY poly_id", "depth")
def _(spark, sf):
    m = maps(spark, sf).filter("year = 1997")
    cells = spatial.cells_in_polygons(maps(spark, sf).select("r", "c").distinct(), polygons(spark))
    return cells.join(m, ["r", "c"]).groupBy("poly_id").agg(F.count("*").alias("n"), r6(F.avg("z")).alias("mean"), r6(F.stddev_pop("z")).alias("std"))


@query("clip_to_polygon", f"WITH {_INSIDE} SELECT year, r, c, z FROM fx_depth d WHERE EXISTS (SELECT 1 FROM i WHERE i.r = d.r AND i.c = d.c)", "depth")
def _(spark, sf):
    inside = spatial.cells_in_polygons(maps(spark, sf).select("r", "c").distinct(), polygons(spark))
    return maps(spark, sf).join(inside, ["r", "c"], "left_semi").select("year", "r", "c", "z")


@query("resample_nearest", "SELECT d.year, t.r, t.c, d.z FROM (SELECT a.r, b.c FROM range(0, 16) a(r), range(0, 16) b(c)) t JOIN fx_depth d ON d.r = floor((t.r + 0.5::DOUBLE) * 2) AND d.c = floor((t.c + 0.5::DOUBLE) * 2)", "depth")
def _(spark, sf):
    return spatial.resample_nearest(maps(spark, sf), spatial.grid_of(spark, fixtures.SIDE // 2), 2.0, ["year"], "z")


@query(
    "resample_bilinear",
    """WITH t AS (SELECT a.r, b.c, (a.r + 0.5::DOUBLE) * 1.6::DOUBLE - 0.5::DOUBLE AS y, (b.c + 0.5::DOUBLE) * 1.6::DOUBLE - 0.5::DOUBLE AS x FROM range(0, 20) a(r), range(0, 20) b(c)),
       n AS (SELECT t.r, t.c, floor(y) + i AS sr, floor(x) + j AS sc, abs(1 - i - (y - floor(y))) * abs(1 - j - (x - floor(x))) AS w FROM t, range(0, 2) p(i), range(0, 2) q(j))
       SELECT year, n.r, n.c, round(sum(z * w) / sum(w), 6) + 0.0 AS z FROM n JOIN fx_depth d ON d.r = n.sr AND d.c = n.sc WHERE w > 1e-9 GROUP BY year, n.r, n.c""",
    "depth",
)
def _(spark, sf):
    out = spatial.resample_bilinear(maps(spark, sf), spatial.grid_of(spark, 20), 1.6, ["year"], "z")
    return out.select("year", "r", "c", r6("z").alias("z"))


_KNN = "q AS (SELECT DISTINCT r AS qr, c AS qc FROM fx_depth), t AS (SELECT DISTINCT r, c, r * 1000 + c AS k, CAST((r * 7 + c * 3) % 11 AS DOUBLE) AS v FROM fx_points), n AS (SELECT qr, qc, k, v, (qr - r) * (qr - r) + (qc - c) * (qc - c) AS d2, row_number() OVER (PARTITION BY qr, qc ORDER BY (qr - r) * (qr - r) + (qc - c) * (qc - c), k) AS rank FROM q, t)"


def knn_inputs(spark, sf):
    q = maps(spark, sf).select(F.col("r").alias("qr"), F.col("c").alias("qc")).distinct()
    t = view(spark, sf, "points").select("r", "c").distinct()
    return q, t.select("r", "c", (F.col("r") * 1000 + F.col("c")).alias("k"), ((F.col("r") * 7 + F.col("c") * 3) % 11).cast("double").alias("v"))


@query("knn_join", f"WITH {_KNN} SELECT qr, qc, k, d2, rank FROM n WHERE rank <= 4", "depth", "points")
def _(spark, sf):
    q, t = knn_inputs(spark, sf)
    return spatial.knn(q, t, 4).select("qr", "qc", "k", "d2", "rank")


@query("nearest_fill", f"WITH {_KNN} SELECT qr, qc, v FROM n WHERE rank = 1", "depth", "points")
def _(spark, sf):
    q, t = knn_inputs(spark, sf)
    return spatial.knn(q, t, 1).select("qr", "qc", "v")


@query("idw_knn_residual", f"WITH {_KNN} SELECT qr, qc, round(sum(v / (sqrt(d2) + 1)) / sum(1 / (sqrt(d2) + 1)), 6) + 0.0 AS v FROM n WHERE rank <= 5 GROUP BY qr, qc", "depth", "points")
def _(spark, sf):
    q, t = knn_inputs(spark, sf)
    return spatial.idw(q, t, 5).select("qr", "qc", r6("v").alias("v"))


_ROBUST = f"""{_KNN}, l AS (SELECT a.k, a.v, b.v AS w, (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) AS d2, row_number() OVER (PARTITION BY a.k ORDER BY (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c), b.k) AS rank FROM t a, t b WHERE a.k <> b.k),
  e AS (SELECT k, any_value(v) - sum(w / (sqrt(d2) + 1)) / sum(1 / (sqrt(d2) + 1)) AS e FROM l WHERE rank <= 5 GROUP BY k), m AS (SELECT 1.4826::DOUBLE * median(abs(e)) AS s FROM e),
  u AS (SELECT k, CASE WHEN e = 0 THEN 1 ELSE least(greatest(1.35::DOUBLE * s / abs(e), 0), 1) END AS u FROM e CROSS JOIN m)"""


@query("robust_knn_residual", f"WITH {_ROBUST} SELECT qr, qc, round(sum(v * u / (sqrt(d2) + 1)) / CASE WHEN sum(u / (sqrt(d2) + 1)) = 0 THEN 1 ELSE sum(u / (sqrt(d2) + 1)) END, 6) + 0.0 AS v FROM n JOIN u ON n.k = u.k WHERE rank <= 5 GROUP BY qr, qc", "depth", "points")
def _(spark, sf):
    q, t = knn_inputs(spark, sf)
    return spatial.robust_idw(q, t, 5).select("qr", "qc", r6("v").alias("v"))


@query("residual_map", f"WITH {_KNN}, i AS (SELECT qr, qc, sum(v / (sqrt(d2) + 1)) / sum(1 / (sqrt(d2) + 1)) AS v FROM n WHERE rank <= 5 GROUP BY qr, qc) SELECT year, r, c, round(z + v, 6) + 0.0 AS z FROM fx_depth JOIN i ON r = qr AND c = qc", "depth", "points")
def _(spark, sf):
    q, t = knn_inputs(spark, sf)
    return spatial.add_residual(maps(spark, sf), spatial.idw(q, t, 5)).select("year", "r", "c", r6("z").alias("z"))


# Tides

_TIDE = "a AS (SELECT con_id, lat_i, lon_i, CASE WHEN (SELECT max(amp_cm) FROM fx_tide) > 15 THEN amp_cm / 100 ELSE amp_cm END AS amp FROM fx_tide)"


@query("read_tide_grid", f"WITH {_TIDE} SELECT * FROM a", "tide")
def _(spark, sf):
    return spatial.tide_in_metres(view(spark, sf, "tide"))


_AT = f"{_TIDE}, ax AS (SELECT max(lat_i) AS la, max(lon_i) AS lo FROM fx_tide), pt AS (SELECT point_id, CAST(least(greatest(ceil(r * 0.3::DOUBLE), 0), la) AS INT) AS lat_i, CAST(least(greatest(ceil(c * 0.25::DOUBLE), 0), lo) AS INT) AS lon_i, depth FROM fx_points CROSS JOIN ax), s AS (SELECT point_id, any_value(depth) AS depth, sum(amp) AS total, coalesce(max(amp) FILTER (WHERE con_id = 0), 0) AS m2, coalesce(max(amp) FILTER (WHERE con_id = 1), 0) AS s2, coalesce(max(amp) FILTER (WHERE con_id = 2), 0) AS k1, coalesce(max(amp) FILTER (WHERE con_id = 3), 0) AS o1 FROM pt JOIN a ON pt.lat_i = a.lat_i AND pt.lon_i = a.lon_i GROUP BY point_id)"


def tide_at(spark, sf):
    p = view(spark, sf, "points").select("point_id", F.col("depth").cast("double").alias("depth"), (F.col("r") * F.lit(0.3)).alias("lat"), (F.col("c") * F.lit(0.25)).alias("lon"))
    return spatial.harmonic_sums(spatial.tide_lookup(p, spatial.tide_in_metres(view(spark, sf, "tide"))))


@query("tide_cell_lookup", f"WITH {_AT} SELECT point_id, lat_i, lon_i FROM pt", "points", "tide")
def _(spark, sf):
    p = view(spark, sf, "points").select("point_id", (F.col("r") * F.lit(0.3)).alias("lat"), (F.col("c") * F.lit(0.25)).alias("lon"))
    return spatial.tide_cell(p, view(spark, sf, "tide")).select("point_id", "lat_i", "lon_i")


@query("harmonic_offset_sum", f"WITH {_AT} SELECT point_id, round(total, 6) + 0.0 AS total, round(m2, 6) + 0.0 AS m2, round(s2, 6) + 0.0 AS s2 FROM s", "points", "tide")
def _(spark, sf):
    return tide_at(spark, sf).select("point_id", *[r6(x).alias(x) for x in ("total", "m2", "s2")])


@query("tidal_datum_shift", f"WITH {_AT} SELECT point_id, round(CAST(depth AS DOUBLE) + total - (-(m2 + s2)), 6) + 0.0 AS depth FROM s", "points", "tide")
def _(spark, sf):
    return spatial.datum_shift(tide_at(spark, sf), "MHWS", "LAT").select("point_id", r6("depth").alias("depth"))


@query(
    "coastal_fix",
    f"""WITH {_TIDE}, n AS (SELECT a.con_id, a.lat_i, a.lon_i, greatest(abs(a.lat_i - b.lat_i), abs(a.lon_i - b.lon_i)) AS d, b.amp FROM a JOIN a b ON a.con_id = b.con_id AND abs(a.lat_i - b.lat_i) <= 4 AND abs(a.lon_i - b.lon_i) <= 4 WHERE a.amp <= 0 AND b.amp > 0),
        f AS (SELECT con_id, lat_i, lon_i, min(d) AS d FROM n GROUP BY ALL), m AS (SELECT n.con_id, n.lat_i, n.lon_i, avg(amp) AS amp FROM n JOIN f ON n.con_id = f.con_id AND n.lat_i = f.lat_i AND n.lon_i = f.lon_i AND n.d <= f.d GROUP BY ALL)
        SELECT a.con_id, a.lat_i, a.lon_i, round(CASE WHEN a.amp > 0 THEN a.amp ELSE coalesce(m.amp, 0) END, 6) + 0.0 AS amp FROM a LEFT JOIN m ON a.con_id = m.con_id AND a.lat_i = m.lat_i AND a.lon_i = m.lon_i""",
    "tide",
)
def _(spark, sf):
    return spatial.coastal_fix(spatial.tide_in_metres(view(spark, sf, "tide"))).select("con_id", "lat_i", "lon_i", r6("amp").alias("amp"))
