"""Queries over spectra: reflectance, quality masks, indices, features and thresholds."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shoalgrid.functions import geo, indices, qa, reflectance
from shoalgrid.operators import masks, thresholds
from shoalgrid.sources import tables
from shoalgrid.sources.shared import shared_dir
from shoalgrid.plans.fixtures import view
from shoalgrid.plans.registry import query, r6

REFL = "SELECT scene_id, r, c, {} FROM fx_spectra"
#: Reflectance bands of the fixture in SQL.
BANDS = ", ".join(f"{b}_dn/10000.0::DOUBLE AS {b}" for b in ("blue", "green", "red", "nir", "swir"))
REFLECTED = f"s AS (SELECT scene_id, r, c, scl, qa_pixel, {BANDS} FROM fx_spectra)"


def reflected(spark, sf):
    """The spectra as reflectance, one column per band."""
    x = view(spark, sf, "spectra")
    return x.select("scene_id", "r", "c", "scl", "qa_pixel", *[(F.col(f"{b}_dn") / F.lit(10000.0)).alias(b) for b in ("blue", "green", "red", "nir", "swir")])


@query("read_cells", "SELECT * FROM fx_spectra", "spectra")
def _(spark, sf):
    return view(spark, sf, "spectra")


@query("read_cells_in_box", "SELECT * FROM fx_spectra WHERE scene_id IN (1, 3) AND r BETWEEN 5 AND 20 AND c BETWEEN 3 AND 9", "spectra")
def _(spark, sf):
    """The cells written by scene and tile, and a box of two scenes read back."""
    path = f"{shared_dir(spark)}/tiles-{uuid.uuid4().hex}"
    tables.write_cells(view(spark, sf, "spectra"), path, tile=8)
    return tables.read_cells(spark, path, (5, 3, 20, 9), (1, 3), tile=8)


@query(
    "null_if_nodata",
    "SELECT r, c, scene_id, CASE WHEN v <> -9999 AND v > -9000 AND abs(v) <= 15000 THEN v END AS value FROM (SELECT r, c, scene_id, CAST(CASE blue_dn % 4 WHEN 0 THEN -9999 WHEN 1 THEN -9500 ELSE blue_dn * (CASE WHEN blue_dn > 600 THEN 20 ELSE 1 END) END AS DOUBLE) AS v FROM fx_spectra) t",
    "spectra",
)
def _(spark, sf):
    b = F.col("blue_dn")
    v = F.when(b % 4 == 0, -9999).when(b % 4 == 1, -9500).otherwise(b * F.when(b > 600, 20).otherwise(1)).cast("double")
    return view(spark, sf, "spectra").select("r", "c", "scene_id", reflectance.null_if_nodata(v).alias("value"))


_BASELINE = "CASE scene_key % 4 WHEN 0 THEN 'V04.00' WHEN 1 THEN '05.13' WHEN 2 THEN 'N/A' ELSE '02.14' END"


@query("parse_baseline", f"SELECT scene_key, TRY_CAST(regexp_replace(trim({_BASELINE}), '^[vV]', '') AS DOUBLE) AS baseline FROM fx_scenes", "scenes")
def _(spark, sf):
    return view(spark, sf, "scenes").select("scene_key", reflectance.parse_baseline(F.expr(_BASELINE)).alias("baseline"))


@query(
    "resolve_reflectance_transform",
    f"""SELECT scene_key, CASE WHEN applied THEN 0.0::DOUBLE
          WHEN baseline >= 4 THEN CASE WHEN abs(off) > 1e-6 THEN off ELSE -0.1::DOUBLE END
          WHEN baseline < 4 THEN 0.0::DOUBLE WHEN abs(off) > 1e-6 THEN off ELSE -0.1::DOUBLE END AS offset_used
        FROM (SELECT scene_key, scene_key % 5 = 0 AS applied, TRY_CAST(regexp_replace(trim({_BASELINE}), '^[vV]', '') AS DOUBLE) AS baseline,
                     CASE WHEN scene_key % 3 = 0 THEN -0.08::DOUBLE ELSE 0.0::DOUBLE END AS off FROM fx_scenes) t""",
    "scenes",
)
def _(spark, sf):
    k = F.col("scene_key")
    used = reflectance.reflectance_offset(k % 5 == 0, reflectance.parse_baseline(F.expr(_BASELINE)), F.when(k % 3 == 0, -0.08).otherwise(0.0))
    return view(spark, sf, "scenes").select("scene_key", used.alias("offset_used"))


@query(
    "reflectance_s2",
    """WITH v AS (SELECT scene_id, r, c, CASE WHEN green_dn > 0 THEN green_dn*0.0001::DOUBLE - 0.1::DOUBLE END AS x, green_dn AS dn FROM fx_spectra),
       l AS (SELECT scene_id, avg(CASE WHEN x < -0.02 THEN 1.0 WHEN x IS NOT NULL THEN 0.0 END) AS low FROM v GROUP BY scene_id)
       SELECT v.scene_id, r, c, round(CASE WHEN dn > 0 THEN dn*0.0001::DOUBLE + CASE WHEN coalesce(low, 0) > 0.7 THEN 0.0::DOUBLE ELSE -0.1::DOUBLE END END, 6) + 0.0 AS green_dn_refl
       FROM v JOIN l ON v.scene_id = l.scene_id""",
    "spectra",
)
def _(spark, sf):
    out = reflectance.sentinel_reflectance(view(spark, sf, "spectra"), "green_dn")
    return out.select("scene_id", "r", "c", r6("green_dn_refl").alias("green_dn_refl"))


@query("reflectance_landsat", "SELECT scene_id, r, c, round(CASE WHEN nir_dn > 0 THEN nir_dn*0.0000275::DOUBLE - 0.2::DOUBLE END, 6) + 0.0 AS nir FROM fx_spectra", "spectra")
def _(spark, sf):
    return view(spark, sf, "spectra").select("scene_id", "r", "c", r6(reflectance.landsat_reflectance(F.col("nir_dn"))).alias("nir"))


@query("already_scaled_guard", "SELECT scene_id, quantile_cont(blue_dn/400.0::DOUBLE, 0.95) <= 2.5 AND min(blue_dn/400.0::DOUBLE) >= -0.5 AS scaled FROM fx_spectra GROUP BY scene_id", "spectra")
def _(spark, sf):
    return reflectance.already_scaled(view(spark, sf, "spectra").withColumn("x", F.col("blue_dn") / F.lit(400.0)), "x")


@query(
    "reflectance_by_sensor",
    """SELECT scene_key, round(CASE WHEN platform LIKE 'landsat%' THEN CASE WHEN dn > 0 THEN dn*0.0000275::DOUBLE - 0.2::DOUBLE END
       WHEN platform LIKE 'sentinel-2%' THEN CASE WHEN dn > 0 THEN dn*0.0001::DOUBLE - 0.1::DOUBLE END END, 6) + 0.0 AS value
       FROM (SELECT scene_key, platform, cloud_cover*100 AS dn FROM fx_scenes) t""",
    "scenes",
)
def _(spark, sf):
    x = reflectance.reflectance_by_sensor(F.col("platform"), F.col("cloud_cover") * 100)
    return view(spark, sf, "scenes").select("scene_key", r6(x).alias("value"))


_QA = ", ".join([f"(qa_pixel >> {b}) & 1 = 1 AS {k}" for k, b in qa.FLAGS.items()] + [f"(qa_pixel >> {b}) & 3 AS {k}" for k, b in qa.CONFIDENCES.items()])


@query(
    "qa_pixel_decode",
    f"SELECT scene_id, r, c, {_QA}, (qa_pixel & 63) > 0 OR (qa_pixel >> 8) & 3 >= 2 OR (qa_pixel >> 10) & 3 >= 2 OR (qa_pixel >> 12) & 3 >= 2 OR (qa_pixel >> 14) & 3 >= 2 AS invalid FROM fx_spectra",
    "spectra",
)
def _(spark, sf):
    return view(spark, sf, "spectra").select("scene_id", "r", "c", *[x.alias(k) for k, x in qa.qa_pixel(F.col("qa_pixel")).items()])


@query("qa_radsat_saturated", "SELECT scene_id, r, c, (qa_pixel % 256) & 127 > 0 AS saturated FROM fx_spectra", "spectra")
def _(spark, sf):
    return view(spark, sf, "spectra").select("scene_id", "r", "c", qa.radsat_saturated(F.col("qa_pixel") % 256).alias("saturated"))


@query("qa_aerosol_decode", "SELECT scene_id, r, c, q & 1 = 1 AS fill, (q >> 1) & 1 = 1 AS valid, (q >> 6) & 3 AS level, (q >> 6) & 3 = 3 AS high FROM (SELECT scene_id, r, c, qa_pixel % 256 AS q FROM fx_spectra) t", "spectra")
def _(spark, sf):
    return view(spark, sf, "spectra").select("scene_id", "r", "c", *[x.alias(k) for k, x in qa.aerosol(F.col("qa_pixel") % 256).items()])


@query("scl_invalid", "SELECT scene_id, r, c, scl IN (0, 1, 3, 8, 9, 10, 11) AS invalid, scl = 6 AS water FROM fx_spectra", "spectra")
def _(spark, sf):
    return view(spark, sf, "spectra").select("scene_id", "r", "c", qa.scl_invalid(F.col("scl")).alias("invalid"), qa.scl_water(F.col("scl")).alias("water"))


@query("normalized_difference", f"WITH {REFLECTED} SELECT scene_id, r, c, round(CASE WHEN abs(green + nir) > 1e-6 THEN (green - nir) / (green + nir) END, 6) + 0.0 AS nd FROM s", "spectra")
def _(spark, sf):
    return reflected(spark, sf).select("scene_id", "r", "c", r6(indices.normalized_difference(F.col("green"), F.col("nir"))).alias("nd"))


def _gd(a, b):
    return f"round(({a} - {b}) / CASE WHEN {a} + {b} = 0 THEN 1e-6::DOUBLE ELSE {a} + {b} END, 6) + 0.0"


@query("ndvi_ndwi_mndwi", f"WITH {REFLECTED} SELECT scene_id, r, c, {_gd('nir', 'red')} AS ndvi, {_gd('green', 'nir')} AS ndwi, {_gd('green', 'swir')} AS mndwi FROM s", "spectra")
def _(spark, sf):
    b = F.col
    return reflected(spark, sf).select("scene_id", "r", "c", r6(indices.ndvi(b("nir"), b("red"))).alias("ndvi"), r6(indices.ndwi(b("green"), b("nir"))).alias("ndwi"), r6(indices.mndwi(b("green"), b("swir"))).alias("mndwi"))


@query(
    "nwi",
    f"WITH {REFLECTED}, t AS (SELECT scene_id, r, c, (blue + green + red) / 3.0::DOUBLE AS v, (nir + swir) / 2.0::DOUBLE AS i FROM s) SELECT scene_id, r, c, {_gd('v', 'i')} AS nwi FROM t",
    "spectra",
)
def _(spark, sf):
    return reflected(spark, sf).select("scene_id", "r", "c", r6(indices.nwi(*[F.col(b) for b in ("blue", "green", "red", "nir", "swir")])).alias("nwi"))


@query("ndti", f"WITH {REFLECTED} SELECT scene_id, r, c, round((red - green) / (red + green + 1e-6::DOUBLE), 6) + 0.0 AS ndti FROM s", "spectra")
def _(spark, sf):
    return reflected(spark, sf).select("scene_id", "r", "c", r6(indices.ndti(F.col("red"), F.col("green"))).alias("ndti"))


def _lb(b):
    return f"ln(greatest({b} * 1000.0::DOUBLE, 1e-4::DOUBLE))"


@query("log_band", f"WITH {REFLECTED} SELECT scene_id, r, c, " + ", ".join(f"round({_lb(b)}, 6) + 0.0 AS log_{b}" for b in ("blue", "green", "nir")) + " FROM s", "spectra")
def _(spark, sf):
    return reflected(spark, sf).select("scene_id", "r", "c", *[r6(indices.log_band(F.col(b))).alias(f"log_{b}") for b in ("blue", "green", "nir")])


_RATIOS = (("blue", "green"), ("blue", "red"), ("green", "nir"), ("red", "nir"))


@query(
    "log_ratio_features",
    f"WITH {REFLECTED} SELECT scene_id, r, c, " + ", ".join(f"round(CASE WHEN {_lb(b)} <> 0 THEN {_lb(a)} / {_lb(b)} ELSE 0.0::DOUBLE END, 6) + 0.0 AS ratio_{a}_{b}" for a, b in _RATIOS) + f", {_gd('green', 'nir')} AS ndwi FROM s",
    "spectra",
)
def _(spark, sf):
    ratios = [r6(indices.log_ratio(F.col(a), F.col(b))).alias(f"ratio_{a}_{b}") for a, b in _RATIOS]
    return reflected(spark, sf).select("scene_id", "r", "c", *ratios, r6(indices.ndwi(F.col("green"), F.col("nir"))).alias("ndwi"))


@query("raw_band_feature", f"WITH {REFLECTED} SELECT scene_id, r, c, CASE WHEN scl = 6 THEN blue END AS raw_blue FROM s", "spectra")
def _(spark, sf):
    return reflected(spark, sf).select("scene_id", "r", "c", F.when(qa.scl_water(F.col("scl")), indices.finite_or_zero(F.col("blue"))).alias("raw_blue"))


@query(
    "band_math",
    f"WITH {REFLECTED} SELECT scene_id, r, c, round(coalesce(log(2 + blue) * 0 + ln(2 + blue) * sqrt(green) / nullif(nir - 0.3, 0) + power(red, 2), 0), 6) + 0.0 AS value FROM s",
    "spectra",
)
def _(spark, sf):
    names = {"B1": "blue", "B2": "green", "B3": "red", "B4": "nir"}
    x = indices.band_math("log(2 + B1) * sqrt(B2) / (B4 - 0.3) + B3**2", names)
    return reflected(spark, sf).select("scene_id", "r", "c", r6(x).alias("value"))


@query(
    "robust_log_ratio",
    f"""WITH {REFLECTED}, p AS (SELECT 10.0::DOUBLE / greatest(least(quantile_cont(blue, 0.05), quantile_cont(green, 0.05)), 1e-4::DOUBLE) AS k FROM s),
        t AS (SELECT scene_id, r, c, ln(greatest(blue * k, 1.1::DOUBLE)) / ln(greatest(green * k, 1.1::DOUBLE)) AS x FROM s CROSS JOIN p)
        SELECT scene_id, r, c, round(x, 6) + 0.0 AS ratio FROM t WHERE x > 0.1 AND x < 5""",
    "spectra",
)
def _(spark, sf):
    from shoalgrid.operators.robust import robust_log_ratio

    return robust_log_ratio(reflected(spark, sf)).select("scene_id", "r", "c", r6("ratio").alias("ratio"))


@query("utm_epsg", "SELECT scene_key, CAST(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + least(floor((lon + 180) / 6) + 1, 60) AS INT) AS epsg FROM (SELECT scene_key, minx * 18 - 180 AS lon, miny * 8 - 80 AS lat FROM fx_scenes) t", "scenes")
def _(spark, sf):
    return view(spark, sf, "scenes").select("scene_key", geo.utm_epsg(F.col("minx") * 18 - 180, F.col("miny") * 8 - 80).alias("epsg"))


@query("snap_to_grid", "SELECT scene_key, floor((minx * 1.7::DOUBLE) / 2.5::DOUBLE) * 2.5::DOUBLE AS x_low, ceil((minx * 1.7::DOUBLE) / 2.5::DOUBLE) * 2.5::DOUBLE AS x_high FROM fx_scenes", "scenes")
def _(spark, sf):
    x = F.col("minx") * F.lit(1.7)
    return view(spark, sf, "scenes").select("scene_key", geo.snap_down(x, 2.5).alias("x_low"), geo.snap_up(x, 2.5).alias("x_high"))


_GRID = geo.Grid(500000.0, 4000000.0, 10.0)


@query("cell_of_point", "SELECT point_id, CAST(floor((4000000.0::DOUBLE - y) / 10.0::DOUBLE) AS INT) AS r, CAST(floor((x - 500000.0::DOUBLE) / 10.0::DOUBLE) AS INT) AS c FROM (SELECT point_id, 500000.0::DOUBLE + (c + 0.5::DOUBLE + dx / 2) * 10.0::DOUBLE AS x, 4000000.0::DOUBLE - (r + 0.5::DOUBLE + dy / 2) * 10.0::DOUBLE AS y FROM fx_points) t", "points")
def _(spark, sf):
    p = view(spark, sf, "points").select("point_id", (500000.0 + (F.col("c") + 0.5 + F.col("dx") / 2) * 10.0).alias("x"), (4000000.0 - (F.col("r") + 0.5 + F.col("dy") / 2) * 10.0).alias("y"))
    return p.select("point_id", _GRID.row(F.col("y")).alias("r"), _GRID.col(F.col("x")).alias("c"))


@query("cell_centre", "SELECT DISTINCT r, c, 500000.0::DOUBLE + (c + 0.5::DOUBLE) * 10.0::DOUBLE AS x, 4000000.0::DOUBLE - (r + 0.5::DOUBLE) * 10.0::DOUBLE AS y FROM fx_depth", "depth")
def _(spark, sf):
    cells = view(spark, sf, "depth").select("r", "c").distinct()
    return cells.select("r", "c", _GRID.x(F.col("c")).alias("x"), _GRID.y(F.col("r")).alias("y"))


@query(
    "project_wgs84_utm",
    """WITH p AS (SELECT scene_key, minx * 0.3::DOUBLE + 9 AS lon, miny * 0.5::DOUBLE + 40 AS lat FROM fx_scenes),
       q AS (SELECT scene_key, radians(lat) AS phi, lon, least(floor((lon + 180) / 6) + 1, 60) AS zone, 0.00669437999014::DOUBLE AS e2 FROM p),
       w AS (SELECT *, e2 / (1 - e2) AS ep2, 6378137.0::DOUBLE / sqrt(1 - e2 * sin(phi) * sin(phi)) AS n, tan(phi) * tan(phi) AS t,
                    e2 / (1 - e2) * cos(phi) * cos(phi) AS c, cos(phi) * radians(lon - (zone * 6 - 183)) AS d,
                    6378137.0::DOUBLE * ((1 - e2/4 - 3*e2*e2/64 - 5*e2*e2*e2/256) * phi - (3*e2/8 + 3*e2*e2/32 + 45*e2*e2*e2/1024) * sin(2*phi)
                      + (15*e2*e2/256 + 45*e2*e2*e2/1024) * sin(4*phi) - (35*e2*e2*e2/3072) * sin(6*phi)) AS m FROM q)
       SELECT scene_key, round(0.9996::DOUBLE * n * (d + (1 - t + c) * pow(d, 3) / 6 + (5 - 18*t + t*t + 72*c - 58*ep2) * pow(d, 5) / 120) + 500000.0::DOUBLE, 3) + 0.0 AS x,
              round(0.9996::DOUBLE * (m + n * tan(phi) * (d*d/2 + (5 - t + 9*c + 4*c*c) * pow(d, 4) / 24 + (61 - 58*t + t*t + 600*c - 330*ep2) * pow(d, 6) / 720)), 3) + 0.0 AS y FROM w""",
    "scenes",
)
def _(spark, sf):
    x, y = geo.utm_xy(F.col("minx") * F.lit(0.3) + 9, F.col("miny") * F.lit(0.5) + 40)
    return view(spark, sf, "scenes").select("scene_key", (F.round(x, 3) + 0.0).alias("x"), (F.round(y, 3) + 0.0).alias("y"))


@query("detect_geographic_coords", "SELECT min(minx) >= -180 AND max(minx) <= 180 AND min(miny) >= -90 AND max(miny) <= 90 AS geographic FROM fx_scenes", "scenes")
def _(spark, sf):
    from shoalgrid.operators.points import looks_geographic

    return looks_geographic(view(spark, sf, "scenes"), "minx", "miny")


@query("pixel_area_m2", "SELECT scene_key, round(abs(0.0001::DOUBLE * -0.0001::DOUBLE) * 111132.92::DOUBLE * 111412.84::DOUBLE * cos(radians(miny)), 6) + 0.0 AS area FROM fx_scenes", "scenes")
def _(spark, sf):
    return view(spark, sf, "scenes").select("scene_key", r6(geo.pixel_area(F.lit(0.0001), F.lit(-0.0001), F.col("miny"))).alias("area"))


_IHO = """CASE WHEN 1.96::DOUBLE*e <= sqrt(0.25*0.25::DOUBLE + pow(0.0075::DOUBLE*d, 2)) THEN 'Special Order' WHEN 1.96::DOUBLE*e <= sqrt(0.5*0.5::DOUBLE + pow(0.013::DOUBLE*d, 2)) THEN 'Order 1a/1b'
  WHEN 1.96::DOUBLE*e <= sqrt(1.0*1.0::DOUBLE + pow(0.023::DOUBLE*d, 2)) THEN 'Order 2' ELSE 'Out of Spec' END"""


@query("iho_tvu_order", f"SELECT point_id, {_IHO} AS iho_order FROM (SELECT point_id, confidence / 100.0::DOUBLE AS e, abs(depth) AS d FROM fx_points) t", "points")
def _(spark, sf):
    return view(spark, sf, "points").select("point_id", geo.iho_order(F.col("confidence") / F.lit(100.0), F.abs("depth")).alias("iho_order"))


@query(
    "suggested_use",
    f"""SELECT point_id, CASE iho_order WHEN 'Special Order' THEN 'Harbours and channels' WHEN 'Order 1a/1b' THEN 'Coastal charting' WHEN 'Order 2' THEN 'Reconnaissance' ELSE 'Research only' END AS suggested_use
        FROM (SELECT point_id, {_IHO} AS iho_order FROM (SELECT point_id, confidence / 100.0::DOUBLE AS e, abs(depth) AS d FROM fx_points) t) o""",
    "points",
)
def _(spark, sf):
    from shoalgrid.operators.metrics import suggested_use

    orders = view(spark, sf, "points").select("point_id", geo.iho_order(F.col("confidence") / F.lit(100.0), F.abs("depth")).alias("iho_order"))
    return suggested_use(orders).select("point_id", "suggested_use")


@query("scene_weight", "SELECT scene_key, round(greatest(0.001::DOUBLE, minx / 20) / (greatest(0.001::DOUBLE, miny / 10) + 0.001::DOUBLE), 6) + 0.0 AS weight FROM fx_scenes", "scenes")
def _(spark, sf):
    return view(spark, sf, "scenes").select("scene_key", r6(geo.scene_weight(F.col("minx") / 20, F.col("miny") / 10)).alias("weight"))


@query("water_flag_code", "SELECT scene_id, r, c, CAST(CASE WHEN scl IN (0,1,3,8,9,10,11) THEN 255 WHEN scl = 6 THEN 1 ELSE 0 END AS INT) AS flag FROM fx_spectra", "spectra")
def _(spark, sf):
    return view(spark, sf, "spectra").select("scene_id", "r", "c", masks.water_flag(qa.scl_invalid(F.col("scl")), qa.scl_water(F.col("scl"))).alias("flag"))


@query("acq_year_date", "SELECT scene_key, CAST(EXTRACT(YEAR FROM acq_ts) AS INT) AS acq_year, strftime(acq_ts, '%Y-%m-%d') AS acq_date FROM fx_scenes", "scenes")
def _(spark, sf):
    return view(spark, sf, "scenes").select("scene_key", F.year("acq_ts").alias("acq_year"), F.date_format("acq_ts", "yyyy-MM-dd").alias("acq_date"))


# Thresholds and masks

_NDWI = "s AS (SELECT scene_id, r, c, scl, qa_pixel, blue, green, red, nir, swir, CASE WHEN abs(green + nir) > 1e-6 THEN (green - nir) / (green + nir) END AS ndwi FROM s0)"
_S0 = REFLECTED.replace("s AS", "s0 AS", 1)


def _otsu(lo: str, hi: str, where: str, place: str, by: str = "scene_id", x: str = "ndwi", src: str = "s") -> str:
    return f"""h AS (SELECT {by}, CAST(least(greatest(floor(({x} - {lo}) / ({hi} - {lo}) * 256), 0), 255) AS INT) AS b, count(*) AS n FROM {src} WHERE {where} GROUP BY ALL),
      k AS (SELECT *, sum(n) OVER w AS wb, sum(n * (b + 0.5)) OVER w AS mb, sum(n) OVER t AS wt, sum(n * (b + 0.5)) OVER t AS mt FROM h
            WINDOW w AS (PARTITION BY {by} ORDER BY b), t AS (PARTITION BY {by})),
      v AS (SELECT {by}, b, wb * (wt - wb) * pow(mb / wb - (mt - mb) / (wt - wb), 2) AS var FROM k WHERE wt > wb),
      o AS (SELECT {by}, max(round(var, 6)) AS best FROM v GROUP BY {by}),
      thr AS (SELECT v.{by}, {place} AS threshold FROM v JOIN o ON v.{by} = o.{by} AND round(v.var, 6) = o.best GROUP BY v.{by})"""


_RANGE = ("-1.0::DOUBLE", "1.0::DOUBLE")


@query("otsu_threshold", f"WITH {_S0}, {_NDWI}, {_otsu(*_RANGE, 'ndwi BETWEEN -1 AND 1', '-1 + (min(b) + 1) * 2.0::DOUBLE / 256')} SELECT scene_id, threshold FROM thr", "spectra")
def _(spark, sf):
    return thresholds.otsu(with_ndwi(spark, sf), "ndwi", by=["scene_id"], low=-1.0, high=1.0)


@query("otsu_threshold_midpoint", f"WITH {_S0}, {_NDWI}, {_otsu(*_RANGE, 'ndwi IS NOT NULL', '-1 + (min(b) + 0.5) * 2.0::DOUBLE / 256')} SELECT scene_id, threshold FROM thr", "spectra")
def _(spark, sf):
    return thresholds.otsu(with_ndwi(spark, sf), "ndwi", by=["scene_id"], low=-1.0, high=1.0, place="middle", clip=True)


def with_ndwi(spark, sf):
    return reflected(spark, sf).withColumn("ndwi", indices.normalized_difference(F.col("green"), F.col("nir")))


@query(
    "water_mask_otsu",
    f"WITH {_S0}, {_NDWI}, {_otsu(*_RANGE, 'ndwi BETWEEN -1 AND 1', '-1 + (min(b) + 1) * 2.0::DOUBLE / 256')}, n AS (SELECT scene_id, count(ndwi) AS n FROM s GROUP BY 1) SELECT s.scene_id, r, c, ndwi > CASE WHEN n.n > 100 THEN threshold ELSE 0 END + 0.05::DOUBLE AS water FROM s JOIN thr ON s.scene_id = thr.scene_id JOIN n ON n.scene_id = s.scene_id WHERE ndwi IS NOT NULL",
    "spectra",
)
def _(spark, sf):
    return masks.water_by_otsu(with_ndwi(spark, sf), adjust=0.05).select("scene_id", "r", "c", "water")


@query("water_mask_manual", f"WITH {_S0}, {_NDWI} SELECT scene_id, r, c FROM s WHERE ndwi > 0.1::DOUBLE", "spectra")
def _(spark, sf):
    return with_ndwi(spark, sf).filter(F.col("ndwi") > 0.1).select("scene_id", "r", "c")


def _g(a, b):
    return f"(({a} - {b}) / CASE WHEN {a} + {b} = 0 THEN 1e-6::DOUBLE ELSE {a} + {b} END)"


@query(
    "water_mask_three_index",
    f"WITH {REFLECTED}, t AS (SELECT *, (blue + green + red) / 3.0::DOUBLE AS v, (nir + swir) / 2.0::DOUBLE AS i FROM s) SELECT scene_id, r, c, {_g('green', 'swir')} > 0 AND {_g('v', 'i')} > 0 AND {_g('nir', 'red')} < 0.1 AS water FROM t",
    "spectra",
)
def _(spark, sf):
    return reflected(spark, sf).select("scene_id", "r", "c", masks.water_by_three_indices().alias("water"))


# Bits of the pixel quality: fill, dilated, cirrus, cloud, shadow and snow, and four confidences of two bits.
_BAD = "((qa_pixel & 63) <> 0 OR ((qa_pixel >> 8) & 3) >= 2 OR ((qa_pixel >> 10) & 3) >= 2 OR ((qa_pixel >> 12) & 3) >= 2 OR ((qa_pixel >> 14) & 3) >= 2)"
_WET = "((qa_pixel >> 7) & 1) = 1"


@query(
    "water_mask_methods",
    f"""WITH {REFLECTED}, i AS (SELECT *, {_BAD} AS bad, {_WET} AS wet, {_g('green', 'nir')} > 0.05 AS n, {_g('green', 'swir')} > 0.05 AS m FROM s)
        SELECT scene_id, r, c, CAST(CASE WHEN bad THEN 255 WHEN wet THEN 1 ELSE 0 END AS INT) AS qa, CAST(CASE WHEN bad THEN 255 WHEN coalesce(m, false) THEN 1 ELSE 0 END AS INT) AS mndwi,
               CAST(CASE WHEN bad THEN 255 WHEN wet AND coalesce(n, false) THEN 1 ELSE 0 END AS INT) AS strict, CAST(CASE WHEN bad THEN 255 WHEN wet OR (coalesce(n, false) AND green > 0.005::DOUBLE) THEN 1 ELSE 0 END AS INT) AS permissive FROM i""",
    "spectra",
)
def _(spark, sf):
    """Landsat's pixel quality with either index: flags side by side."""
    out = reflected(spark, sf)
    for name, method, mode in (("qa", "qa", "strict"), ("mndwi", "mndwi", "strict"), ("strict", "hybrid", "strict"), ("permissive", "hybrid", "permissive")):
        out = masks.water_mask(out, method, mode, "qa_pixel", 0.05).withColumnRenamed("flag", name)
    return out.select("scene_id", "r", "c", "qa", "mndwi", "strict", "permissive")


@query(
    "water_mask_qa",
    f"""WITH {_S0}, {_NDWI}, q AS (SELECT * FROM s WHERE scl NOT IN (0,1,3,8,9,10,11)), {_otsu(*_RANGE, 'ndwi IS NOT NULL', '-1 + (min(b) + 0.5) * 2.0::DOUBLE / 256', src='q')}
        SELECT s.scene_id, r, c, CAST(CASE WHEN scl IN (0,1,3,8,9,10,11) THEN 255 WHEN scl = 6 OR (coalesce(ndwi > threshold, false) AND green > 0.005::DOUBLE) THEN 1 ELSE 0 END AS INT) AS permissive,
               CAST(CASE WHEN scl IN (0,1,3,8,9,10,11) THEN 255 WHEN scl = 6 AND coalesce(ndwi > threshold, false) THEN 1 ELSE 0 END AS INT) AS strict
        FROM s JOIN thr ON s.scene_id = thr.scene_id""",
    "spectra",
)
def _(spark, sf):
    return masks.water_by_quality(with_ndwi(spark, sf)).select("scene_id", "r", "c", "permissive", "strict")


@query(
    "water_stats",
    "SELECT scene_id, count(*) AS total, count(*) FILTER (WHERE f <> 255) AS valid, count(*) FILTER (WHERE f = 1) AS water, count(*) FILTER (WHERE f = 0) AS land, count(*) FILTER (WHERE f = 255) AS invalid, round(100.0::DOUBLE * count(*) FILTER (WHERE f = 1) / count(*), 6) + 0.0 AS water_pct FROM (SELECT scene_id, CASE WHEN scl IN (0,1,3,8,9,10,11) THEN 255 WHEN scl = 6 THEN 1 ELSE 0 END AS f FROM fx_spectra) t GROUP BY scene_id",
    "spectra",
)
def _(spark, sf):
    flagged = view(spark, sf, "spectra").withColumn("flag", masks.water_flag(qa.scl_invalid(F.col("scl")), qa.scl_water(F.col("scl"))))
    return masks.water_stats(flagged, by=["scene_id"]).withColumn("water_pct", r6("water_pct"))
