"""Queries over points, scenes and pairs: filters, sampling, metrics, scores and catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoalgrid.operators import metrics, models, points, ranks, robust, scenes
from shoalgrid.plans.contract_cells import REFLECTED, reflected
from shoalgrid.plans.fixtures import view
from shoalgrid.plans.registry import query, r6

P = "SELECT point_id, r, c, year, depth, confidence FROM fx_points"
COLUMNS = ("point_id", "r", "c", "year", "depth", "confidence")


def pts(spark, sf):
    """Points with a weight, and depth as a double."""
    x = view(spark, sf, "points")
    return x.withColumn("depth", F.col("depth").cast("double")).withColumn("weight", F.col("confidence").cast("double"))


_D = "d AS (SELECT point_id, r, c, year, CAST(depth AS DOUBLE) AS depth, confidence, CAST(confidence AS DOUBLE) AS weight, dx, dy FROM fx_points)"


@query("read_points", f"WITH {_D} SELECT point_id, r, c, year, depth, confidence FROM d", "points")
def _(spark, sf):
    return pts(spark, sf).select(*COLUMNS)


@query("filter_by_depth", f"WITH {_D} SELECT point_id, depth FROM d WHERE depth <> 0 AND abs(depth) <= 20", "points")
def _(spark, sf):
    return points.filter_by_depth(pts(spark, sf), "depth", -20).select("point_id", "depth")


@query("resolve_depth_field", f"WITH {_D} SELECT count(*) AS n, round(avg(depth), 6) + 0.0 AS mean FROM d", "points")
def _(spark, sf):
    p = pts(spark, sf).withColumnRenamed("depth", "Depth_m")
    return p.agg(F.count("*").alias("n"), r6(F.avg(points.resolve_depth_field(p, "elev"))).alias("mean"))


@query("filter_points_by_year", f"WITH {_D} SELECT point_id FROM d WHERE year = 1996", "points")
def _(spark, sf):
    return points.filter_by_year(pts(spark, sf), "year", 1996).select("point_id")


@query("filter_points_by_year_text", f"WITH {_D} SELECT point_id FROM d WHERE list_contains(regexp_extract_all('survey ' || year || '-' || (year + 1), '(?:19|20)[0-9]{{2}}'), '1997')", "points")
def _(spark, sf):
    named = pts(spark, sf).withColumn("label", F.concat(F.lit("survey "), "year", F.lit("-"), F.col("year") + 1))
    return points.filter_by_year(named, "label", 1997).select("point_id")


@query("filter_any_attribute", f"WITH {_D} SELECT point_id FROM d WHERE CAST(year AS VARCHAR) LIKE '%1999%' OR CAST(confidence AS VARCHAR) LIKE '%1999%' OR CAST(point_id AS VARCHAR) LIKE '%1999%'", "points")
def _(spark, sf):
    return points.filter_any_attribute(pts(spark, sf), ["year", "confidence", "point_id"], "1999").select("point_id")


@query("filter_time_range", "SELECT scene_key FROM fx_scenes WHERE acq_ts >= DATE '1995-03-01' AND acq_ts < DATE '1995-07-01'", "scenes")
def _(spark, sf):
    return points.filter_time_range(view(spark, sf, "scenes"), "acq_ts", "1995-03-01", "1995-06-30").select("scene_key")


@query("filter_track", "SELECT point_id FROM fx_points WHERE confidence >= 40 AND r IN (1, 3, 5) AND year BETWEEN 1995 AND 1998", "points")
def _(spark, sf):
    return pts(spark, sf).filter((F.col("confidence") >= 40) & F.col("r").isin(1, 3, 5) & F.col("year").between(1995, 1998)).select("point_id")


@query("annual_chunks", "SELECT greatest(DATE '1995-03-10', make_date(y, 1, 1)) AS chunk_start, least(DATE '1998-05-02', make_date(y, 12, 31)) AS chunk_end FROM (SELECT DISTINCT CAST(extract(year FROM o_orderdate) AS INT) AS y FROM orders) t WHERE y BETWEEN 1995 AND 1998")
def _(spark, sf):
    years = spark.read.parquet(f"{sf}/orders.parquet").select(F.year("o_orderdate").alias("y")).distinct()
    chunks = points.annual_chunks(spark, "1995-03-10", "1998-05-02")
    return chunks.join(years, F.year("chunk_start") == F.col("y"), "left_semi")


@query("union_chunks", f"WITH {_D} SELECT point_id, depth, CASE WHEN year <= 1996 THEN weight END AS weight FROM d WHERE year <= 1996 OR year >= 2000", "points")
def _(spark, sf):
    p = pts(spark, sf)
    a, b = p.filter("year <= 1996").select("point_id", "depth", "weight"), p.filter("year >= 2000").select("point_id", "depth")
    return a.unionByName(b, allowMissingColumns=True)


@query(
    "filter_scenes",
    "SELECT scene_key, platform, cloud_cover FROM fx_scenes WHERE cloud_cover <= 30 AND platform IN ('sentinel-2a', 'landsat-8') AND acq_ts BETWEEN DATE '1995-01-01' AND DATE '1997-12-31' ORDER BY acq_ts DESC, scene_key LIMIT 200",
    "scenes",
)
def _(spark, sf):
    found = scenes.filter_scenes(view(spark, sf, "scenes"), 30, ["sentinel-2a", "landsat-8"], "1995-01-01", "1997-12-31", 200)
    return found.select("scene_key", "platform", "cloud_cover")


@query("newest_scenes", "SELECT scene_key FROM fx_scenes ORDER BY acq_ts DESC, scene_key LIMIT 25", "scenes")
def _(spark, sf):
    return view(spark, sf, "scenes").orderBy(F.desc("acq_ts"), "scene_key").limit(25).select("scene_key")


@query("sensor_mix_guard", "SELECT platform, count(*) AS n FROM fx_scenes WHERE platform LIKE 'sentinel%' GROUP BY platform", "scenes")
def _(spark, sf):
    one = view(spark, sf, "scenes").filter(F.col("platform").startswith("sentinel"))
    return scenes.same_sensor(one).groupBy("platform").agg(F.count("*").alias("n"))


@query(
    "scene_aoi_coverage",
    "SELECT scene_key, round(100.0::DOUBLE * greatest(0, least(minx + 3, 8) - greatest(minx, 2)) * greatest(0, least(miny + 3, 9) - greatest(miny, 4)) / 30.0::DOUBLE, 6) + 0.0 AS coverage FROM fx_scenes",
    "scenes",
)
def _(spark, sf):
    s = view(spark, sf, "scenes").withColumns({"maxx": F.col("minx") + 3, "maxy": F.col("miny") + 3})
    return scenes.aoi_coverage(s, (2.0, 4.0, 8.0, 9.0)).select("scene_key", r6("coverage").alias("coverage"))


@query(
    "resolve_band_asset",
    "SELECT scene_key, CASE WHEN scene_key % 4 = 0 THEN 'a/B03.tif' WHEN scene_key % 4 = 1 THEN 'a/green.tif' WHEN scene_key % 4 = 2 THEN 'a/b03.TIF' ELSE 'a/x_B03.tif' END AS href FROM fx_scenes",
    "scenes",
)
def _(spark, sf):
    k = F.col("scene_key") % 4
    names = F.when(k == 0, F.array(F.lit("B03"), F.lit("green"))).when(k == 1, F.array(F.lit("green"), F.lit("other"))).when(k == 2, F.array(F.lit("b03"), F.lit("z"))).otherwise(F.array(F.lit("q"), F.lit("w")))
    hrefs = F.when(k == 0, F.array(F.lit("a/B03.tif"), F.lit("a/green.tif"))).when(k == 1, F.array(F.lit("a/green.tif"), F.lit("a/o.tif"))).when(k == 2, F.array(F.lit("a/b03.TIF"), F.lit("a/z.tif"))).otherwise(F.array(F.lit("a/x_B03.tif"), F.lit("a/w.tif")))
    assets = view(spark, sf, "scenes").select("scene_key", F.map_from_arrays(names, hrefs).alias("assets"))
    return assets.select("scene_key", scenes.resolve_band_asset(F.col("assets"), "B03", ["green"]).alias("href"))


@query(
    "discover_year_datasets",
    """SELECT year, role, path FROM (SELECT year, role, path, row_number() OVER (PARTITION BY year, role ORDER BY priority, path) AS k FROM
       (SELECT path, CAST(regexp_extract(path, '(19|20)[0-9][0-9]', 0) AS INT) AS year,
               CASE WHEN path LIKE '%control%' OR path LIKE '%check%' THEN 'control' WHEN path LIKE '%train%' OR path LIKE '%lidar%' THEN 'train' ELSE 'image' END AS role,
               CASE WHEN path LIKE '%control%' OR path LIKE '%train%' THEN 0 ELSE 1 END AS priority
        FROM (SELECT extract(year FROM o_orderdate) || CASE o_orderkey % 5 WHEN 0 THEN '_train' WHEN 1 THEN '_control' WHEN 2 THEN '_lidar' WHEN 3 THEN '_check' ELSE '_image' END || '_' || o_custkey % 7 || '.tif' AS path FROM orders) a) b) c WHERE k = 1""",
)
def _(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    word = F.expr("CASE o_orderkey % 5 WHEN 0 THEN '_train' WHEN 1 THEN '_control' WHEN 2 THEN '_lidar' WHEN 3 THEN '_check' ELSE '_image' END")
    return scenes.discover(o.select(F.concat(F.year("o_orderdate"), word, F.lit("_"), F.col("o_custkey") % 7, F.lit(".tif")).alias("path")))


@query("natural_scene_order", "SELECT path, row_number() OVER (ORDER BY CAST(regexp_extract(path, '[0-9]+', 0) AS INT), path) AS place FROM (SELECT DISTINCT 'scene_' || (p_partkey % 120) AS path FROM part) t")
def _(spark, sf):
    paths = spark.read.parquet(f"{sf}/part.parquet").select(F.concat(F.lit("scene_"), F.col("p_partkey") % 120).alias("path")).distinct()
    return scenes.natural_order(paths, "path")


# Sampling and joins

@query("sample_at_points", f"WITH {_D}, {REFLECTED} SELECT d.point_id, s.scene_id, s.blue, s.green, s.nir FROM d JOIN s ON d.r = s.r AND d.c = s.c", "points", "spectra")
def _(spark, sf):
    cells = reflected(spark, sf)
    return points.sample_at_points(pts(spark, sf), cells.select("r", "c", "scene_id", "blue", "green", "nir"), ["scene_id", "blue", "green", "nir"]).select("point_id", "scene_id", "blue", "green", "nir")


@query("overlap_check", f"WITH {_D} SELECT (SELECT min(c) FROM d) <= (SELECT max(c) FROM fx_depth) AND (SELECT min(c) FROM fx_depth) <= (SELECT max(c) FROM d) AND (SELECT min(r) FROM d) <= (SELECT max(r) FROM fx_depth) AND (SELECT min(r) FROM fx_depth) <= (SELECT max(r) FROM d) AS overlap", "points", "depth")
def _(spark, sf):
    return points.overlaps(pts(spark, sf), view(spark, sf, "depth"))


for _mode, _sql in {
    0: "SELECT r, c, depth AS value, weight FROM d",
    1: "SELECT r, c, arg_max(depth, struct_pack(w := weight, k := -point_id)) AS value, max(weight) AS weight FROM d GROUP BY r, c",
    2: "SELECT r, c, arg_min(depth, struct_pack(d2 := dx*dx + dy*dy, k := point_id)) AS value, arg_min(weight, struct_pack(d2 := dx*dx + dy*dy, k := point_id)) AS weight FROM d GROUP BY r, c",
    3: "g AS (SELECT r, c, count(*) FILTER (WHERE n) AS k, sum(depth*weight) FILTER (WHERE n) / nullif(sum(weight) FILTER (WHERE n), 0) AS a, avg(depth) FILTER (WHERE n) AS b, avg(weight) FILTER (WHERE n) AS w, sum(depth*weight) / nullif(sum(weight), 0) AS a0, avg(depth) AS b0, avg(weight) AS w0 FROM (SELECT *, dx*dx + dy*dy <= 0.25 AS n FROM d) t GROUP BY r, c) SELECT r, c, CASE WHEN k > 0 THEN coalesce(a, b) ELSE coalesce(a0, b0) END AS value, CASE WHEN k > 0 THEN w ELSE w0 END AS weight FROM g",
    4: "SELECT r, c, coalesce(sum(depth*weight) / nullif(sum(weight), 0), avg(depth)) AS value, avg(weight) AS weight FROM d WHERE dx*dx + dy*dy <= 0.25 GROUP BY r, c",
}.items():
    _sep = ", " if _sql.startswith("g AS") else " "

    def _collide(spark, sf, mode=_mode):
        out = points.collision_reduce(pts(spark, sf), mode)
        return out.select("r", "c", r6("value").alias("value"), r6("weight").alias("weight"))

    query(f"collision_reduce_{_mode}", f"WITH {_D}{_sep}" + f"SELECT r, c, round(value, 6) + 0.0 AS value, round(weight, 6) + 0.0 AS weight FROM ({_sql}) q" if _sep == " " else f"WITH {_D}, " + _sql.replace("SELECT r, c, CASE WHEN k > 0 THEN coalesce(a, b) ELSE coalesce(a0, b0) END AS value, CASE WHEN k > 0 THEN w ELSE w0 END AS weight", "SELECT r, c, round(CASE WHEN k > 0 THEN coalesce(a, b) ELSE coalesce(a0, b0) END, 6) + 0.0 AS value, round(CASE WHEN k > 0 THEN w ELSE w0 END, 6) + 0.0 AS weight"), "points")(_collide)


@query("training_summary", f"WITH {_D} SELECT count(*) AS n, min(depth) AS depth_min, max(depth) AS depth_max, min(weight) AS weight_min, max(weight) AS weight_max, count(*) FILTER (WHERE abs(depth) < 10) AS n_used FROM d", "points")
def _(spark, sf):
    return points.training_summary(pts(spark, sf), F.abs("depth") < 10)


@query("write_training_points", f"WITH {_D} SELECT point_id, depth AS depth_used, weight AS weight_used, r AS row_idx, c AS col_idx, (c + 0.5::DOUBLE) * 10 AS x, -(r + 0.5::DOUBLE) * 10 AS y FROM d", "points")
def _(spark, sf):
    from shoalgrid.functions.geo import Grid
    from shoalgrid.sources.tables import training_points

    return training_points(pts(spark, sf), Grid(0.0, 0.0, 10.0))


@query("write_subset_with_uncert", f"WITH {_D} SELECT point_id, depth, 0.1::DOUBLE + abs(depth) * 0.02::DOUBLE AS sdb_uncert, abs(depth) <= 15 AS accepted FROM d", "points")
def _(spark, sf):
    from shoalgrid.sources.tables import with_uncertainty

    return with_uncertainty(pts(spark, sf), 0.1 + F.abs("depth") * 0.02, F.abs("depth") <= 15).select("point_id", "depth", "sdb_uncert", "accepted")


@query("sanitize_columns", "SELECT event_id, user_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, event_type, CAST(value AS DOUBLE) AS value, props FROM events")
def _(spark, sf):
    from shoalgrid.sources.tables import sanitize_columns

    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "ts", "event_type", "value", "props")
    return sanitize_columns(e.withColumn("tags", F.array("event_type")))


@query("accepted_and_rejected", f"WITH {_D} SELECT point_id FROM d EXCEPT ALL SELECT point_id FROM d WHERE depth < -5", "points")
def _(spark, sf):
    p = pts(spark, sf)
    return p.select("point_id").exceptAll(p.filter("depth < -5").select("point_id"))


# Metrics

_METRICS = """count(*) AS n, round(1 - sum(power(y_pred - y_true, 2)) / nullif(sum(y_true*y_true) - sum(y_true)*sum(y_true)/count(*), 0), 6) + 0.0 AS r2, round(sqrt(avg(power(y_pred - y_true, 2))), 6) + 0.0 AS rmse,
  round(avg(abs(y_pred - y_true)), 6) + 0.0 AS mae, round(avg(y_pred - y_true), 6) + 0.0 AS bias, round(100.0::DOUBLE * sum(abs(y_pred - y_true)) / sum(abs(y_true)), 6) + 0.0 AS wmape"""
_PAIRS = "p AS (SELECT model, CAST(y_true AS DOUBLE) AS y_true, CAST(y_pred AS DOUBLE) AS y_pred FROM fx_pairs)"
_NAMES = ("r2", "rmse", "mae", "bias", "wmape")


def pairs(spark, sf):
    return view(spark, sf, "pairs").select("model", F.col("y_true").cast("double").alias("y_true"), F.col("y_pred").cast("double").alias("y_pred"))


@query("regression_metrics", f"WITH {_PAIRS} SELECT model, {_METRICS} FROM p GROUP BY model", "pairs")
def _(spark, sf):
    return metrics.regression_metrics(pairs(spark, sf), ["model"]).select("model", "n", *[r6(m).alias(m) for m in _NAMES])


_BIN = "CASE " + " ".join(f"WHEN abs(y_true) >= {a} AND abs(y_true) < {b} THEN '{a}-{b}'" for a, b in zip(metrics.DEPTH_BINS, metrics.DEPTH_BINS[1:])) + " END"


@query(
    "stratified_errors",
    f"""WITH {_PAIRS}, q AS (SELECT model, 'GLOBAL' AS stratum, y_true, y_pred FROM p UNION ALL SELECT model, {_BIN}, y_true, y_pred FROM p),
        m AS (SELECT model, stratum, {_METRICS}, sqrt(avg(power(y_pred - y_true, 2))) AS e, avg(abs(y_true)) AS d FROM q WHERE stratum IS NOT NULL GROUP BY model, stratum HAVING stratum = 'GLOBAL' OR count(*) >= 5)
        SELECT model, stratum, n, r2, rmse, mae, bias, wmape, CASE WHEN 1.96::DOUBLE*e <= sqrt(0.0625::DOUBLE + pow(0.0075::DOUBLE*d, 2)) THEN 'Special Order' WHEN 1.96::DOUBLE*e <= sqrt(0.25::DOUBLE + pow(0.013::DOUBLE*d, 2)) THEN 'Order 1a/1b' WHEN 1.96::DOUBLE*e <= sqrt(1.0::DOUBLE + pow(0.023::DOUBLE*d, 2)) THEN 'Order 2' ELSE 'Out of Spec' END AS iho_order FROM m""",
    "pairs",
)
def _(spark, sf):
    return metrics.stratified_errors(pairs(spark, sf)).select("model", "stratum", "n", *[r6(m).alias(m) for m in _NAMES], "iho_order")


@query(
    "phase_verdict",
    f"""WITH {_PAIRS}, m AS (SELECT model, sqrt(avg(power(y_pred - y_true, 2))) AS e, 100.0::DOUBLE * sum(abs(y_pred - y_true)) / sum(abs(y_true)) AS w FROM p GROUP BY model)
        SELECT round(100 * (a.e - b.e) / a.e, 6) + 0.0 AS rmse_gain, round(100 * (a.w - b.w) / a.w, 6) + 0.0 AS wmape_gain, CASE WHEN abs(a.e - b.e) <= 0.01 THEN 'tie' WHEN b.e < a.e THEN 'after' ELSE 'before' END AS verdict
        FROM m a, m b WHERE a.model = 'm1' AND b.model = 'm2'""",
    "pairs",
)
def _(spark, sf):
    out = metrics.phase_verdict(metrics.regression_metrics(pairs(spark, sf), ["model"]), "m1", "m2")
    return out.select(r6("rmse_gain").alias("rmse_gain"), r6("wmape_gain").alias("wmape_gain"), "verdict")


_FEATURES = ("blue", "green", "red", "nir")
_SAMPLED = f"{_D}, {REFLECTED}, x AS (SELECT d.point_id, d.depth, s.* FROM d JOIN s ON d.r = s.r AND d.c = s.c )"


def sampled(spark, sf):
    """Soundings beside the bands of their cell in every scene."""
    return points.sample_at_points(pts(spark, sf), reflected(spark, sf), ["scene_id", *_FEATURES])


def counted(spark, sf):
    """``sampled`` soundings of one cell and depth as a row with ``_n``, how many they are."""
    return points.sample_at_points(models.tally(pts(spark, sf), ["r", "c", "depth"]), reflected(spark, sf), ["scene_id", *_FEATURES])


@query("feature_corr_pearson", f"WITH {_SAMPLED} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, round(coalesce(corr({f}, depth), 0), 6) + 0.0 AS pearson FROM x" for f in _FEATURES), "points", "spectra")
def _(spark, sf):
    return metrics.feature_correlations(sampled(spark, sf), _FEATURES, "depth").select("feature", r6("pearson").alias("pearson"))


def _rank(f):
    return f"rank() OVER (ORDER BY {f}) + (count(*) OVER (PARTITION BY {f}) - 1) / 2.0::DOUBLE AS k_{f}"


@query("feature_corr_spearman", f"WITH {_SAMPLED}, k AS (SELECT {', '.join(_rank(f) for f in (*_FEATURES, 'depth'))} FROM x) " + " UNION ALL ".join(f"SELECT '{f}' AS feature, round(coalesce(corr(k_{f}, k_depth), 0), 6) + 0.0 AS spearman FROM k" for f in _FEATURES), "points", "spectra")
def _(spark, sf):
    return metrics.spearman(sampled(spark, sf).select("point_id", "scene_id", "depth", *_FEATURES), list(_FEATURES), "depth", ["point_id", "scene_id"]).select("feature", r6("spearman").alias("spearman"))


@query("feature_select", f"WITH {_SAMPLED}, f AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, coalesce(corr({f}, depth), 0) AS pearson FROM x" for f in _FEATURES) + "), t AS (SELECT greatest(0.0::DOUBLE, avg(abs(pearson)) - stddev_pop(abs(pearson))) AS t FROM f) SELECT feature FROM f, t WHERE abs(pearson) >= t", "points", "spectra")
def _(spark, sf):
    found = metrics.feature_correlations(sampled(spark, sf), _FEATURES, "depth")
    limit = found.agg(F.greatest(F.lit(0.0), F.avg(F.abs("pearson")) - F.stddev_pop(F.abs("pearson"))).alias("t"))
    return found.crossJoin(F.broadcast(limit)).filter(F.abs("pearson") >= F.col("t")).select("feature")


_WEIGHTS = {"r2": 40.0, "rmse": 30.0, "wmape": 15.0, "bias": 10.0, "mae": 5.0}


def _score(table: str, weights: str | None = None, part: str = "") -> str:
    over = f"OVER ({part})"
    out = []
    for m in _WEIGHTS:
        x = "abs(bias)" if m == "bias" else m
        up = f"({x} - min({x}) {over}) / (max({x}) {over} - min({x}) {over})" if m == "r2" else f"(max({x}) {over} - {x}) / (max({x}) {over} - min({x}) {over})"
        w = f"{_WEIGHTS[m] / sum(_WEIGHTS.values())}::DOUBLE" if weights is None else f"w_{m} / (w_r2 + w_rmse + w_wmape + w_bias + w_mae)"
        out.append(f"{w} * CASE WHEN max({x}) {over} = min({x}) {over} THEN 1.0::DOUBLE ELSE {up} END")
    return f"100 * ({' + '.join(out)})"


_BOARD = f"{_PAIRS}, b AS (SELECT model, 1 - sum(power(y_pred - y_true, 2)) / (sum(y_true*y_true) - sum(y_true)*sum(y_true)/count(*)) AS r2, sqrt(avg(power(y_pred - y_true, 2))) AS rmse, avg(abs(y_pred - y_true)) AS mae, avg(y_pred - y_true) AS bias, 100.0::DOUBLE * sum(abs(y_pred - y_true)) / sum(abs(y_true)) AS wmape FROM p GROUP BY model)"


@query("composite_score", f"WITH {_BOARD} SELECT model, round({_score('b')}, 4) + 0.0 AS score FROM b", "pairs")
def _(spark, sf):
    board = metrics.regression_metrics(pairs(spark, sf), ["model"])
    return metrics.composite_score(board, _WEIGHTS).select("model", (F.round("score", 4) + 0.0).alias("score"))


@query("leaderboard", f"WITH {_BOARD} SELECT model, row_number() OVER (ORDER BY score DESC, r2 DESC, model) AS place FROM (SELECT model, r2, round({_score('b')}, 4) AS score FROM b) t", "pairs")
def _(spark, sf):
    from pyspark.sql import Window

    board = metrics.composite_score(metrics.regression_metrics(pairs(spark, sf), ["model"]), _WEIGHTS)
    place = F.row_number().over(Window.orderBy(F.round("score", 4).desc(), F.desc("r2"), "model"))
    return board.select("model", place.alias("place"))


_DRAW = "1 + ((k * {m} + {a}) % 71 - 35) / 100.0::DOUBLE"


@query(
    "winner_stability",
    f"""WITH {_BOARD}, w AS (SELECT k AS round, {', '.join(f"{x}::DOUBLE * ({_DRAW.format(m=7 + 6 * i, a=i)}) AS w_{m}" for i, (m, x) in enumerate(_WEIGHTS.items()))} FROM range(0, 20) t(k)),
        x AS (SELECT *, {_score('b', 'w', 'PARTITION BY w.round')} AS score FROM b CROSS JOIN w),
        y AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY round(score, 6) DESC, model) AS p FROM x)
        SELECT model, count(*) FILTER (WHERE p = 1) / 20.0::DOUBLE AS wins, round(avg(score), 4) + 0.0 AS mean_score FROM y GROUP BY model""",
    "pairs",
)
def _(spark, sf):
    k = F.col("id")
    draws = [(F.lit(x) * (1 + ((k * (7 + 6 * i) + i) % 71 - 35) / F.lit(100.0))).alias(f"w_{m}") for i, (m, x) in enumerate(_WEIGHTS.items())]
    rounds = spark.range(20).select(k.alias("round"), *draws)
    board = metrics.regression_metrics(pairs(spark, sf), ["model"])
    return metrics.winner_stability(board, rounds, list(_WEIGHTS)).select("model", "wins", (F.round("mean_score", 4) + 0.0).alias("mean_score"))


@query("top_models", f"WITH {_BOARD} SELECT model FROM b ORDER BY rmse, model LIMIT 2", "pairs")
def _(spark, sf):
    return metrics.regression_metrics(pairs(spark, sf), ["model"]).orderBy("rmse", "model").limit(2).select("model")


@query("scene_algorithm_matrix", f"WITH {_PAIRS}, s AS (SELECT CAST(floor(y_true) AS INT) % 3 AS scene, * FROM p), m AS (SELECT scene, model, 1 - sum(power(y_pred - y_true, 2)) / (sum(y_true*y_true) - sum(y_true)*sum(y_true)/count(*)) AS r2 FROM s GROUP BY ALL) SELECT scene, " + ", ".join(f"round(max(r2) FILTER (WHERE model = '{m}'), 6) + 0.0 AS {m}" for m in ("m1", "m2", "m3")) + ", round(max(r2), 6) + 0.0 AS best_r2 FROM m GROUP BY scene", "pairs")
def _(spark, sf):
    rows = metrics.regression_metrics(pairs(spark, sf).withColumn("scene", F.floor("y_true").cast("int") % 3), ["scene", "model"])
    wide = rows.groupBy("scene").pivot("model", ["m1", "m2", "m3"]).agg(F.max("r2"))
    return wide.select("scene", *[r6(m).alias(m) for m in ("m1", "m2", "m3")], r6(F.greatest("m1", "m2", "m3")).alias("best_r2"))


@query("filter_summary", f"WITH {_D} SELECT count(*) AS candidates, count(*) FILTER (WHERE abs(depth) <= 20) AS accepted, count(*) FILTER (WHERE abs(depth) > 20) AS rejected, round(100.0::DOUBLE * count(*) FILTER (WHERE abs(depth) <= 20) / count(*), 6) + 0.0 AS accepted_pct FROM d", "points")
def _(spark, sf):
    ok = F.abs("depth") <= 20
    return pts(spark, sf).agg(F.count("*").alias("candidates"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"), r6(100.0 * F.count_if(ok) / F.count("*")).alias("accepted_pct"))


@query(
    "deglint_hedley",
    f"""WITH {REFLECTED}, w AS (SELECT * FROM s WHERE scl = 6), k AS (SELECT quantile_cont(nir, 0.05) AS low, covar_samp(blue, nir) / var_pop(nir) AS kb, covar_samp(green, nir) / var_pop(nir) AS kg FROM w)
        SELECT scene_id, r, c, round(greatest(blue - kb * (nir - low), 1e-4::DOUBLE), 6) + 0.0 AS blue_deglint, round(greatest(green - kg * (nir - low), 1e-4::DOUBLE), 6) + 0.0 AS green_deglint FROM s CROSS JOIN k""",
    "spectra",
)
def _(spark, sf):
    out = robust.deglint(reflected(spark, sf), ["blue", "green"], F.col("scl") == 6)
    return out.select("scene_id", "r", "c", r6("blue_deglint").alias("blue_deglint"), r6("green_deglint").alias("green_deglint"))


_LS = f"""{_SAMPLED}, q AS (SELECT *, blue * 10 AS t FROM x), m AS (SELECT count(*)::DOUBLE AS s0, sum(t) AS s1, sum(t*t) AS s2, sum(t*t*t) AS s3, sum(t*t*t*t) AS s4, sum(depth) AS t0, sum(depth*t) AS t1, sum(depth*t*t) AS t2 FROM q),
   e AS (SELECT *, s0*(s2*s4 - s3*s3) - s1*(s1*s4 - s2*s3) + s2*(s1*s3 - s2*s2) AS det FROM m),
   k AS (SELECT (t0*(s2*s4 - s3*s3) - s1*(t1*s4 - t2*s3) + s2*(t1*s3 - t2*s2)) / det AS c0,
                (s0*(t1*s4 - t2*s3) - t0*(s1*s4 - s2*s3) + s2*(s1*t2 - s2*t1)) / det AS c1,
                (s0*(s2*t2 - s3*t1) - s1*(s1*t2 - s2*t1) + t0*(s1*s3 - s2*s2)) / det AS c2 FROM e),
   f AS (SELECT point_id, depth - (c0 + c1*t + c2*t*t) AS residual FROM q CROSS JOIN k)"""


@query("filter_ls_variance", f"WITH {_LS} SELECT point_id, round(residual, 4) + 0.0 AS residual, abs(residual) <= 3 * (SELECT 1.4826::DOUBLE * median(abs(residual)) FROM f) AS accepted FROM f", "points", "spectra")
def _(spark, sf):
    out = robust.filter_least_squares(sampled(spark, sf).withColumn("t", F.col("blue") * 10), "t", "depth")
    return out.select("point_id", (F.round("residual", 4) + 0.0).alias("residual"), "accepted")


def _ransac_sql():
    h = "CAST('0x' || substr(md5(point_id || ':' || t), 1, 8) AS BIGINT)"
    return f"""WITH {_SAMPLED}, l AS (SELECT regr_slope(depth, blue) AS b, regr_intercept(depth, blue) AS a FROM x), thr AS (SELECT 2.5::DOUBLE * median(abs(depth - a - b * blue)) AS t FROM x, l),
      f AS (SELECT t AS trial, regr_slope(depth, blue) AS b, regr_intercept(depth, blue) AS a FROM x, range(0, 20) r(t) WHERE {h} % 10 = 0 GROUP BY t),
      n AS (SELECT trial, a, b, count(*) FILTER (WHERE abs(depth - a - b * blue) <= thr.t) AS n FROM x, f, thr WHERE b IS NOT NULL GROUP BY trial, a, b),
      w AS (SELECT a, b FROM n ORDER BY n DESC, trial LIMIT 1), g AS (SELECT regr_slope(depth, blue) AS b, regr_intercept(depth, blue) AS a FROM x, w, thr WHERE abs(depth - w.a - w.b * blue) <= thr.t)
      SELECT point_id, round(depth - g.a - g.b * blue, 4) + 0.0 AS residual, abs(depth - g.a - g.b * blue) <= thr.t AS accepted FROM x, g, thr"""


@query("filter_ransac_linear", _ransac_sql(), "points", "spectra")
def _(spark, sf):
    out = robust.filter_ransac(sampled(spark, sf), "blue", "depth", "point_id")
    return out.select("point_id", (F.round("residual", 4) + 0.0).alias("residual"), "accepted")


@query(
    "knee_point",
    """WITH v AS (SELECT CAST(confidence AS DOUBLE) + dx + 0.5 AS value FROM fx_points WHERE CAST(confidence AS DOUBLE) + dx + 0.5 > 0),
    a AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER () AS n FROM v),
    i AS (SELECT CASE WHEN n < 10000 THEN i ELSE i * (n - 1) // 4999 END AS k, i, CASE WHEN n < 10000 THEN n ELSE 5000 END AS m
          FROM (SELECT any_value(n) AS n FROM a) t, range(10000) r(i) WHERE i < CASE WHEN n < 10000 THEN n ELSE 5000 END),
    b AS (SELECT value, i / (m - 1)::DOUBLE AS x, (value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()) AS y FROM a JOIN i ON a.k = i.k)
    SELECT value AS knee FROM b ORDER BY round(abs(x - y), 9) DESC, value LIMIT 1""",
    "points",
)
def _(spark, sf):
    p = pts(spark, sf).withColumn("v", F.col("weight") + F.col("dx") + 0.5)
    return ranks.knee_point(p, "v")
